"""Substring deduplication by content-defined chunks (gear rolling hash)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapstrata.llm.common import flat, sliced
from snapstrata.llm.op4_bpe import gear
from snapstrata.llm.spans import keyed, remove_spans

#: Chunk lengths in bytes: cuts come at the rate 1 / RATE once a chunk has MIN bytes; a chunk of MAX is cut anyway.
MIN_CHUNK, RATE, MAX_CHUNK = 32, 24, 1024
#: Bytes that the gear hash looks back.
WINDOW = 32
#: Repeated chunks go where they stand in runs of so many bytes; shorter ones are ordinary phrases.
LEAST_RUN = 160


def chunk_ends(data: np.ndarray, offsets: np.ndarray, rate: int, least: int, most: int) -> list[list[int]]:
    """For each text the ends of its chunks, relative to its start."""
    cuts = np.flatnonzero(gear(data) < np.uint32(2**32 // rate)) + 1
    own = offsets[np.searchsorted(offsets, cuts, "left") - 1]
    cuts = cuts[cuts - own >= WINDOW]
    where = np.searchsorted(cuts, offsets, "right")
    out = []
    for k in range(len(offsets) - 1):
        base, n, last, ends = int(offsets[k]), int(offsets[k + 1] - offsets[k]), 0, []
        for c in (cuts[where[k] : where[k + 1]] - base).tolist():
            while c - last > most:
                last += most
                ends.append(last)
            if c - last >= least:
                ends.append(c)
                last = c
        while n - last > most:
            last += most
            ends.append(last)
        if n > last:
            ends.append(n)
        out.append(ends)
    return out


def _chunks(batches, rate: int, least: int, most: int):
    for batch in batches:
        for part in sliced(batch):
            data, offsets = flat(part.column("text"))
            raw, row, start, stop, digest = data.tobytes(), [], [], [], []
            for k, ends in enumerate(chunk_ends(data, offsets, rate, least, most)):
                base, a = int(offsets[k]), 0
                for b in ends:
                    if b - a >= least:
                        row.append(k)
                        start.append(a)
                        stop.append(b)
                        digest.append(hashlib.blake2b(raw[base + a : base + b], digest_size=16).digest())
                    a = b
            rows = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("ord").take(rows), part.column("rk").take(rows), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(digest, pa.binary())], names=["ord", "rk", "start", "stop", "digest"])


def cdc_dedup(docs: DataFrame, rate: int = RATE, least: int = MIN_CHUNK, most: int = MAX_CHUNK, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, least_run: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text): chunks that occur earlier are removed, where such
    chunks stand side by side over ``least_run`` bytes or more (0: wherever they are; LEAST_RUN leaves ordinary phrases alone).

    Texts are bytes in UTF-8 (null: empty). Chunk ends depend on the last 32 bytes alone, so an insertion moves only
    the chunks around it. Of equal chunks the one with the smallest id, then the smallest start stays; those shorter
    than ``least`` (a text's end) always stay. Rows with one id are not compared at equal starts; a null
    id comes last. Repeated rows are judged alike; empty texts have no chunks; long texts are cut in full; an empty table
    gives an empty result; extra columns are ignored. The smallest occurrence of each digest is pre-aggregated before its shuffle, so a
    hot chunk costs one row a task; the join that brings it back is split by adaptive execution where hot."""
    rows = keyed(docs, id_col, text_col)
    chunks = rows.select("ord", "rk", "text").mapInArrow(lambda b: _chunks(b, rate, least, most), "ord long, rk binary, start int, stop int, digest binary")
    first = chunks.groupBy("digest").agg(F.min(F.struct("ord", "start")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = chunks.join(first, "digest").where("first.ord < ord or first.ord = ord and first.start < start")
    return remove_spans(rows, again.select("rk", "start", "stop"), keep_text, least_run).drop("rk")
