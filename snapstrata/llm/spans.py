"""Rows with a stable key, and the removal of byte spans from their texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapstrata.llm.common import flat, fresh, sliced

#: Order of a row without id: after all others.
LAST_ID = 2**63 - 1


def row_key(id_col: str, text_col: str) -> F.Column:
    """16 bytes of the SHA-256 of id and text: what equal rows share, and no others."""
    id_ = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    # the id's length and whether it is null come first, so that no other id and text give the same string
    head = F.concat(F.col(id_col).isNull().cast("string"), F.char_length(id_).cast("string"), F.lit(":"), id_)
    return F.substring(F.unhex(F.sha2(F.concat(head, F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 256)), 1, 16)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ord (long), rk (binary; of id and text), text (null: empty). Rows with one id and text share rk: their
    spans are the same."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("ord"), row_key(id_col, text_col).alias("rk"), text.alias("text"))


def one_of_each(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, with all its columns, for each row key in keys (one column). Rows that share a key are first combined in
    their own tasks, so that a row which is repeated any number of times sends one copy a task to the join."""
    rk = fresh("__rk", docs.columns)
    keep = keys.select(F.col(keys.columns[0]).alias(rk))
    return docs.withColumn(rk, row_key(id_col, text_col)).dropDuplicates([rk]).join(keep, rk, "left_semi").drop(rk)


def covered(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as disjoint maximal ones."""
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > stops[:-1]
    first = np.flatnonzero(new)
    return starts[first], stops[np.append(first[1:], len(starts)) - 1]


def _apply(batches, keep_text: bool, least: int = 0):
    for batch in batches:
        for part in sliced(batch):
            data, offsets = flat(part.column("text"))
            raw, spans = data.tobytes(), part.column("spans")
            rows, removed, count, shas, texts = [], [], [], [], []
            for k in range(part.num_rows):
                text = raw[offsets[k] : offsets[k + 1]]
                own = spans[k].values
                gone = n = 0
                if own is not None and len(own):
                    a, b = covered(own.field("start").to_numpy(), own.field("stop").to_numpy())
                    a, b = a[b - a >= least], b[b - a >= least]
                    edges = [0, *np.ravel(np.column_stack([a, b])).tolist(), len(text)]
                    if keep_text:  # whole characters only
                        pieces, at = [], 0
                        for i in range(0, len(edges), 2):
                            x, y = edges[i], edges[i + 1]
                            while x < y and text[x] & 0xC0 == 0x80:
                                x += 1
                            while y > x and y < len(text) and text[y] & 0xC0 == 0x80:
                                y -= 1
                            pieces.append(text[x:y])
                        text_out = b"".join(pieces)
                    gone, n = int((b - a).sum()), len(a)
                    left = b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))
                else:
                    left = text_out = text
                rows.append(len(text))
                removed.append(gone)
                count.append(n)
                shas.append(hashlib.sha256(left).hexdigest())
                if keep_text:
                    texts.append(text_out.decode("utf-8", "ignore"))
            cols = [part.column("doc_id"), part.column("rk"), pa.array(rows, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(shas, pa.string())]
            names = ["doc_id", "rk", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string())] if keep_text else cols, names=[*names, "kept_text"] if keep_text else names)


def remove_spans(rows: DataFrame, spans: DataFrame, keep_text: bool = False, least: int = 0) -> DataFrame:
    """doc_id, rk, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text, cut at whole characters) for every row.

    spans: rk, start, stop in bytes of the row's text; they may overlap and repeat. Of their unions those of fewer than
    ``least`` bytes stay."""
    lists = spans.groupBy("rk").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    joined = rows.select("doc_id", "rk", "text").join(lists, "rk", "left")
    return joined.mapInArrow(lambda b: _apply(b, keep_text, least), f"doc_id {dict(rows.dtypes)['doc_id']}, rk binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text string" if keep_text else ""))


def _cut(batches, columns: list[str], spans: str, chars: str | None):
    for batch in batches:
        for part in sliced(batch):
            rows = pa.RecordBatch.from_arrays([part.column("text"), part.column(spans), pa.nulls(part.num_rows), pa.nulls(part.num_rows)], names=["text", "spans", "doc_id", "rk"])
            done = next(_apply([rows], True))
            removed = done.column("n_removed").to_numpy()
            texts, kept = part.column("text").to_pylist(), done.column("kept_text").to_pylist()
            keep = np.asarray([n == 0 or bool(t) for n, t in zip(removed, kept, strict=True)], bool)
            cols = []
            for name in columns:
                col = part.column(name)
                if name == "text":
                    col = pa.array([k if n else t for n, t, k in zip(removed, texts, kept, strict=True)], pa.string())
                elif name == chars:
                    col = pa.array([len(k) if n else c for n, k, c in zip(removed, kept, col.to_pylist(), strict=True)], col.type)
                cols.append(col)
            yield pa.RecordBatch.from_arrays(cols, names=columns).filter(pa.array(keep))


def cut_spans(docs: DataFrame, spans: DataFrame, chars: str | None = None) -> DataFrame:
    """docs (with a column text) without these spans of their texts, cut at whole characters; other columns stay, but for
    ``chars``, which holds a changed text's length. A text of which nothing is left goes; untouched rows stay as they are."""
    names = docs.columns
    rk, own = fresh("__rk", names), fresh("__spans", names)
    lists = spans.groupBy(F.col("rk").alias(rk)).agg(F.collect_list(F.struct("start", "stop")).alias(own))
    joined = docs.withColumn(rk, row_key("doc_id", "text")).join(lists, rk, "left").select(*names, own)
    return joined.mapInArrow(lambda b: _cut(b, names, own, chars if chars in names else None), docs.schema)
