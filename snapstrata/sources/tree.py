"""A local file tree as a source.

The driver lists (ignored directories are not entered), executors read. Zero-length files and names that start with
a dot or an underscore are kept, which Spark's binaryFile source does not do. ``read_tree`` and the data source give
whole files, one a cell (2 GB at most); ``scan_objects``, ``read_pieces`` and ``hash_files`` read by pieces, whatever the size."""

from __future__ import annotations

import hashlib
import os

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from snapstrata.schema import CONTENT_TYPE, FILES, PAYLOADS, SCANNED

#: Bytes read at a time, bytes of payloads held before they are handed on, and pieces of a file in one unit of work.
READ_BYTES, HELD_BYTES, UNIT = 4 << 20, 32 << 20, 64


def list_files(root: str, ignore: list[str] = ()) -> list[str]:
    """Absolute paths of files, links to files included; names equal to a pattern are left out with all below them."""
    skip = set(ignore)
    if os.path.basename(os.path.normpath(root)) in skip:
        return []
    found = []
    for folder, dirs, names in os.walk(root):
        dirs[:] = sorted(d for d in dirs if d not in skip)
        found += [p for n in sorted(names) if n not in skip and os.path.isfile(p := os.path.join(folder, n))]
    return found


def list_storage(root: str) -> list[str]:
    """Relative paths of regular files (links are not followed); a missing folder is empty."""
    return sorted(os.path.relpath(os.path.join(f, n), root).replace(os.sep, "/") for f, _, names in os.walk(root) for n in names if not os.path.islink(os.path.join(f, n)) and os.path.isfile(os.path.join(f, n)))


def relative(path: str, root: str) -> str:
    cut = path[len(root) :] if path.startswith(root) else path
    cut = cut.replace("\\", "/")
    return cut[1:] if cut.startswith("/") else cut


def read_tree(spark: SparkSession, root: str, ignore: list[str] = (), parts: int | None = None) -> DataFrame:
    """path, content, permissions. For trees that all executors can reach."""
    paths = list_files(root, ignore)
    listed = spark.createDataFrame([(p,) for p in paths], "full string").repartition(parts or max(1, min(len(paths), 200)))

    def run(batches):
        for pdf in batches:
            for full in pdf.full:
                with open(full, "rb") as f:
                    yield pd.DataFrame({"path": [relative(full, root)], "content": [f.read()], "permissions": [os.stat(full).st_mode & 0o777]})

    return listed.mapInPandas(run, FILES)


def listing(spark: SparkSession, root: str, ignore: list[str] = ()) -> DataFrame:
    """full, path of a tree's files; names only."""
    rows = [(p, relative(p, root)) for p in list_files(root, ignore)]
    return spark.createDataFrame(rows, "full string, path string")


def _spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Names are few bytes but much work: dealt out by number, which adaptive execution does not merge."""
    return df.repartition(tasks or max(4 * df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _scan(batches, size: int):
    for batch in batches:
        for full, path in zip(batch.column("full").to_pylist(), batch.column("path").to_pylist(), strict=True):
            whole, chunks, n = hashlib.sha256(), [], 0
            with open(full, "rb") as f:
                while piece := f.read(size):
                    whole.update(piece)
                    chunks.append(hashlib.sha256(piece).hexdigest())
                    n += len(piece)
                mode = os.fstat(f.fileno()).st_mode & 0o777
            yield pa.RecordBatch.from_pylist([{"path": path, "hash": whole.hexdigest(), "size": n, "content_type": CONTENT_TYPE, "permissions": mode, "chunks": chunks}], schema=pa.schema([("path", pa.string()), ("hash", pa.string()), ("size", pa.int64()), ("content_type", pa.string()), ("permissions", pa.int32()), ("chunks", pa.list_(pa.string()))]))


def scan_objects(files: DataFrame, size: int) -> DataFrame:
    """path, hash, size, content_type, permissions, chunks of listed files (full, path); a worker holds one chunk."""
    return _spread(files.select("full", "path")).mapInArrow(lambda b: _scan(b, size), SCANNED)


def _pieces(batches, size: int, level: int):
    import zstandard

    pack, hashes, payloads, held = zstandard.ZstdCompressor(level=level), [], [], 0
    kinds = [("chunk_hash", pa.string()), ("payload", pa.binary())]
    for batch in batches:
        for full, pieces in zip(batch.column("full").to_pylist(), batch.column("pieces").to_pylist(), strict=True):
            if not os.path.isfile(full):
                continue
            with open(full, "rb") as f:
                for p in pieces:
                    f.seek(p["seq"] * size)
                    data = f.read(size)
                    if hashlib.sha256(data).hexdigest() == p["chunk_hash"]:
                        hashes.append(p["chunk_hash"])
                        payloads.append(pack.compress(data))
                        held += len(payloads[-1])
                    if held >= HELD_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(payloads, pa.binary())], schema=pa.schema(kinds))
                        hashes, payloads, held = [], [], 0
    yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.string()), pa.array(payloads, pa.binary())], schema=pa.schema(kinds))


def read_pieces(units: DataFrame, size: int, level: int) -> DataFrame:
    """chunk_hash, payload (compressed) of units (full, pieces: seq and chunk_hash); pieces whose bytes are not (or no longer)
    those of their hash, and files that are gone, are left out."""
    return units.select("full", "pieces").mapInArrow(lambda b: _pieces(b, size, level), PAYLOADS)


def file_hash(full: str) -> str | None:
    """None for what cannot be read."""
    whole = hashlib.sha256()
    try:
        with open(full, "rb") as f:
            while piece := f.read(READ_BYTES):
                whole.update(piece)
    except OSError:
        return None
    return whole.hexdigest()


def hash_files(files: DataFrame) -> DataFrame:
    """path, hash of listed files (full, path)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array([file_hash(x) for x in b.column("full").to_pylist()], pa.string())], names=["path", "hash"])

    return _spread(files.select("full", "path")).mapInArrow(run, "path string, hash string")


def units_of(wanted: DataFrame) -> DataFrame:
    """path, pieces: at most UNIT pieces (path, seq, chunk_hash) in a row, so that a huge file is many rows."""
    block = F.floor(F.col("seq") / UNIT).alias("block")
    return wanted.groupBy("path", block).agg(F.sort_array(F.collect_list(F.struct("seq", "chunk_hash"))).alias("pieces")).select("path", "pieces")


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.ignore = [x for x in options.get("ignore", "").split(",") if x]
        self.files = int(options.get("filesPerPartition", "64"))

    def partitions(self):
        paths = list_files(self.root, self.ignore)
        return [_Part(paths[i : i + self.files]) for i in range(0, len(paths), self.files)] or [_Part([])]

    def read(self, partition):
        for full in partition.paths:
            with open(full, "rb") as f:
                yield relative(full, self.root), f.read(), os.stat(full).st_mode & 0o777


class TreeSource(DataSource):
    """spark.read.format("filetree").option("ignore", "a,b").load(root), once registered."""

    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return FILES

    def reader(self, schema):
        return TreeReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TreeSource)
