"""Helpers shared by the training-data operators: shared-folder tables, byte views of
Arrow string columns, word hashing and distributed connected components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at a time inside a Python worker; bounds its memory whatever the batch holds.
SLICE_BYTES = 2 << 20

_OWN_DIR: list[str] = []
_TABLES: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where the session names none, an own temporary one, but only on a local master, whose
    tasks all run on this machine; on a cluster it is an error, as executors would write to disks of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        holder = tempfile.TemporaryDirectory(prefix="snapstrata-")
        atexit.register(holder.cleanup)
        _OWN_DIR.append(holder.name)
    return f"file://{_OWN_DIR[0]}"


def table(df: DataFrame, tag: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet in the shared folder and reads it back.

    The files outlive lost executors. ``dropped`` deletes one's files, ``release`` all that a session has written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables that nothing reads any more."""
    for t in tables:
        release(t.sparkSession, [t.table_path])


def forget(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of plans that nobody holds any more. It does so when the driver collects garbage, which
    an idle driver puts off while executors' disks fill; to be called where a table has cut a large lineage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(name: str, columns: list[str]) -> str:
    """A column name that none of these columns has, however they are written."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(spark: SparkSession) -> list[str]:
    """Paths of the tables that ``table`` has written for a session and that are still there."""
    return [path for owner, path in _TABLES if owner is spark]


def release(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes these tables (all of the session's by default); frames that still read them become unusable."""
    jvm = spark.sparkContext._jvm
    gone = set(written(spark) if paths is None else paths)
    for path in gone:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _TABLES[:] = [x for x in _TABLES if x[1] not in gone]


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary()
    column = column.cast(pa.large_string()).cast(kind) if pa.types.is_string(column.type) else column.cast(kind)
    column = column.fill_null(b"") if column.null_count else column
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Consecutive row slices of a batch with about ``limit`` bytes of text each (a longer text alone)."""
    _, offsets = flat(batch.column(column))
    start, n = 0, batch.num_rows
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), n)
        yield batch.slice(start, stop - start)
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a hash depends on every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Random 64-bit value of each byte and the odd base of polynomial hashes, from fixed seeds.
BYTE_VALUE = np.random.default_rng(20240501).integers(0, 2**64, 256, np.uint64)
BASE = np.uint64(0x2545F4914F6CDD1D)
_POWERS = [np.ones(1, np.uint64)]


def powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        steps = np.full(max(n, 256), BASE, np.uint64)
        steps[0] = 1
        _POWERS[0] = np.multiply.accumulate(steps)
    return _POWERS[0][:n]


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray | None = None):
    """Maximal runs of word bytes that do not cross texts: (starts, lengths, hashes, text index)."""
    keep = is_word[data]
    prev = np.empty_like(keep)
    prev[:1] = False
    prev[1:] = keep[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    prev[edges] = False
    starts = np.flatnonzero(keep & ~prev)
    if not len(starts):
        return starts, starts, np.zeros(0, np.uint64), starts
    counts = np.add.reduceat(keep, starts, dtype=np.int64)
    body = data[keep]
    begin = np.cumsum(counts) - counts
    within = np.arange(len(body)) - np.repeat(begin, counts)
    values = (BYTE_VALUE if fold is None else BYTE_VALUE[fold])[body]
    hashes = mix(np.add.reduceat(values * powers(int(counts.max()))[within], begin) + counts.astype(np.uint64))
    return starts, counts, hashes, np.searchsorted(offsets, starts, "right") - 1


def lower_table() -> np.ndarray:
    """Byte table that lower-cases A-Z only."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def components(nodes: DataFrame, edges: DataFrame, tag: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(id, component) with the smallest id reachable over edges (a, b); nodes without edges keep themselves.

    Minimum labels spread along the edges, then labels jump to their label's label, so that the
    number of rounds grows with the logarithm of a chain's length. Hubs are harmless: the minimum is
    pre-aggregated before its shuffle, and the joins' hot side is split by adaptive execution.
    Every round is written to the shared folder; nothing is gathered on the driver but one count."""
    both = table(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b"), F.col("a"))).distinct(), f"{tag}-edges")
    now = table(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")), f"{tag}-0")
    for k in range(1, max_rounds):
        label = now.select("id", "label")
        near = both.join(label, both.b == label.id).groupBy("a").agg(F.min("label").alias("m"))
        spread = label.join(near, label.id == near.a).select("id", "label", F.least("label", "m").alias("step"))
        # where a better label was found for a node, its former label (a root) learns of it as well
        hooks = spread.where("step < label").groupBy(F.col("label").alias("root")).agg(F.min("step").alias("hook"))
        spread = table(spread.join(hooks, spread.id == hooks.root, "left").select("id", F.least("step", "hook").alias("step"), "label"), f"{tag}-{k}s")
        up = spread.select(F.col("id").alias("p"), F.col("step").alias("pp"))
        new = spread.join(up, spread.step == up.p, "left").select("id", F.least("step", "pp").alias("label"), F.col("label").alias("old"))
        new = table(new, f"{tag}-{k}")
        changed = new.where("label <> old").limit(1).count()
        dropped(now, spread)
        now = new
        if not changed:
            break
    else:
        raise RuntimeError("connected components did not settle")
    dropped(both)
    return nodes.join(now.select("id", "label"), "id", "left").select("id", F.coalesce("label", "id").alias("component"))
