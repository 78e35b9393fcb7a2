"""Near-duplicate embeddings by Euclidean p-stable hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapstrata.llm.common import components, mix, table

#: Tables, projections in each, and the width of a quantisation step for unit vectors: of pairs at cosine 0.93 (distance
#: 0.374) a projection keeps 0.70 together, a table 0.17, sixteen tables 0.95; of nearer pairs more.
TABLES, PROJECTIONS, WIDTH, SEED = 16, 5, 1.0, 20240607
#: Vectors of one bucket compared at a time: larger buckets are dealt to pairs of blocks.
BLOCK = 512


def _codes(batches, tables: int, projections: int, width: float):
    made: dict[int, tuple] = {}
    for batch in batches:
        lists, labels = batch.column("embedding"), batch.column("label")
        codes, units = [None] * batch.num_rows, [None] * batch.num_rows
        groups: dict[int, tuple[list, list]] = {}
        for k in range(batch.num_rows):
            if not lists[k].is_valid or not labels[k].is_valid or not len(lists[k]) or lists[k].values.null_count:
                continue
            v = lists[k].values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(v).all() or not v.any():
                continue
            v = v / np.abs(v).max()  # neither overflow nor underflow in the norm
            rows, vectors = groups.setdefault(len(v), ([], []))
            rows.append(k)
            vectors.append(v / np.sqrt(v @ v))
        for d, (rows, vectors) in groups.items():
            if d not in made:
                rng = np.random.default_rng([SEED, d])
                made[d] = rng.standard_normal((d, tables * projections)), rng.uniform(0, width, tables * projections), rng.integers(0, 2**64, tables * projections, np.uint64) | np.uint64(1)
            a, b, odd = made[d]
            x = np.asarray(vectors)
            cell = np.floor((x @ a + b) / width).astype(np.int64).view(np.uint64) + np.uint64(d)
            code = mix((mix(cell * odd) * odd).reshape(len(x), tables, projections).sum(2, dtype=np.uint64))
            for i, k in enumerate(rows):
                codes[k], units[k] = code[i].view(np.int64), x[i].tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), labels, pa.array(codes, pa.list_(pa.int64())), pa.array(units, pa.binary())], names=["vec_id", "label", "codes", "unit"])


def _compare(rows: list[tuple], cosine: float):
    """Counts of links first met here, and for each vector the smallest row linked to it through vectors of this cell.
    rows: rid, table, block, i, j, codes, unit, label, copies; each stands for its copies."""
    rid = np.asarray([r[0] for r in rows], np.int64)
    where, block, i, j = rows[0][1], np.asarray([r[2] for r in rows]), rows[0][3], rows[0][4]
    codes = np.asarray([r[5] for r in rows])
    x = np.frombuffer(b"".join(r[6] for r in rows), np.float64).reshape(len(rows), -1)
    label, copies = np.asarray([r[7] for r in rows]), np.asarray([r[8] for r in rows], np.int64)
    link = (x @ x.T >= cosine) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    if i != j:
        link &= (block[:, None] == i) != (block[None, :] == i)
    if not link.any():
        return None
    first = link.copy()
    for t in range(where):
        first &= codes[:, None, t] != codes[None, :, t]
    order = np.argsort(rid, kind="stable")
    rank = np.empty(len(rid), np.int64)
    rank[order] = np.arange(len(rid))
    root = rank.copy()
    while True:
        low = np.where(link, root[None, :], len(rid)).min(1)
        new = np.minimum(root, low)
        new = np.minimum(new, new[order[new]])
        if (new == root).all():
            break
        root = new
    some = link.any(1)
    return rid[some], (first @ copies)[some], rid[order[root]][some]


def _cell(held: list[tuple], cosine: float) -> list:
    """Results of one cell; where cells of other tables, blocks or vector lengths have its hash, each of them apart."""
    parts: dict[tuple, list] = {}
    for r in held:
        parts.setdefault((r[1], r[3], r[4], len(r[6])), []).append(r)
    found = [_compare(rows, cosine) for rows in parts.values() if len(rows) > 1]
    return [x for x in found if x is not None]


def _links(batches, cosine: float):
    """Rows sorted by cell."""
    held: list[tuple] = []
    last = None
    for batch in batches:
        out = []
        cols = [batch.column(c).to_pylist() for c in ("cell", "rid", "t", "block", "i", "j", "codes", "unit", "label", "copies")]
        for cell, *row in zip(*cols, strict=True):
            if cell != last:
                out += _cell(held, cosine)
                held, last = [], cell
            held.append(tuple(row))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[c] for x in out])) for c in range(3)], names=["rid", "n", "root"])
    for x in _cell(held, cosine):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in x], names=["rid", "n", "root"])


def embedding_components(vectors: DataFrame, cosine: float = 0.93, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept; one row per row of vectors (vec_id, embedding, label).

    Rows link when their labels are equal, their vectors of one length share a bucket in some table, and their cosine in
    double precision is at least ``cosine``. Equal vectors (once normalised) of one label go through as one with a count. A pair counts in the first table where its codes agree, so n_links needs no list of
    pairs. A bucket of more than ``block`` rows is dealt to pairs of blocks: no task holds more than two
    blocks at a time, and only counts and a spanning star of each block pair leave it. All cosines of a bucket are computed,
    however large it is. Vectors that are null, empty, zero, or hold null or non-finite components, and null labels,
    link with nothing. Repeated rows are rows of their own and link with each other. An empty table gives an empty result; extra
    columns are ignored."""
    kinds = dict(vectors.dtypes)
    numbered = vectors.select("vec_id", "label", "embedding")
    coded = numbered.mapInArrow(lambda b: _codes(b, tables, projections, width), f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<long>, unit binary")
    coded = table(coded.withColumn("rid", F.monotonically_increasing_id()).withColumn("sha", F.unhex(F.sha2("unit", 256))), "embedding-codes")
    # equal vectors of one label become one row with a count: they are links of cosine 1, whatever their number
    same = coded.where("codes is not null").groupBy("label", "sha").agg(F.min("rid").alias("rid"), F.count(F.lit(1)).alias("copies"), F.min_by("codes", "rid").alias("codes"), F.min_by("unit", "rid").alias("unit"))
    same = table(same, "embedding-same")
    slots = same.select("rid", F.posexplode("codes").alias("t", "code"), "label").select("rid", "t", F.xxhash64("label", "t", "code").alias("bucket"))
    size = slots.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks"))
    dealt = slots.join(size, "bucket").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    pairs = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("rid", "t", "bucket", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    cells = pairs.withColumn("cell", F.xxhash64("bucket", "i", "j")).join(same, "rid")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.select("cell", "rid", "t", "block", "i", "j", "codes", "unit", "label", "copies").repartition(n, "cell").sortWithinPartitions("cell")
    found = table(cells.mapInArrow(lambda b: _links(b, cosine), "rid long, n long, root long"), "embedding-links")
    counts = found.groupBy("rid").agg(F.sum("n").alias("n"))
    named = table(components(same.select(F.col("rid").alias("id")), found.select(F.col("rid").alias("a"), F.col("root").alias("b")), "embedding-cc"), "embedding-named")
    each = same.join(named, F.col("rid") == F.col("id")).join(counts, "rid", "left").select("label", "sha", "component", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    each = table(each, "embedding-each")
    ids = coded.select("vec_id", "label", "sha")
    full = ids.where("sha is not null").join(each, ["label", "sha"])
    least = table(full.groupBy("component").agg(F.min("vec_id").alias("component_id")), "embedding-least")
    linked = full.join(least, "component").select("vec_id", "n_links", "component_id")
    alone = ids.where("sha is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", F.col("n_links").cast("long").alias("n_links"), F.col("component_id").cast("long").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
