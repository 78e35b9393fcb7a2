"""Running chunk state with Structured Streaming."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from snapstrata.functions.scalars import sha256


def scratch(spark: SparkSession, tag: str = "stream") -> str:
    """A new folder in the shared folder that the session names, else in the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def mounted(url: str) -> str:
    """The plain path of a shared folder that all machines have mounted; an error for one that only Spark reads."""
    if re.match(r"(?!file:)\w+:", url):
        raise ValueError(f"a shared folder is needed that is mounted as files, not {url}")
    return re.sub("^file:/*", "/", url)


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table (a file or a folder of files) as a stream."""
    schema = spark.read.parquet(path).schema
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    folder = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path) if folder else reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())


def first_seen(chunks: DataFrame) -> DataFrame:
    """Each chunk_hash once, when it first arrives."""
    return chunks.select("chunk_hash").dropDuplicates(["chunk_hash"])


def run_first_seen(spark: SparkSession, chunks: DataFrame, folder: str | None = None) -> DataFrame:
    """Runs over what is there and returns all hashes seen; started again on one folder, it goes on where it stopped."""
    folder = folder or scratch(spark)
    query = first_seen(chunks).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("chunk_hash string").parquet(f"{folder}/out")


def run_refcount(spark: SparkSession, chunks: DataFrame, folder: str | None = None) -> DataFrame:
    """Running reference counts; each batch writes the changed counts, the newest of a hash holds."""
    folder = folder or scratch(spark)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    counts = chunks.groupBy("chunk_hash").agg(F.count(F.lit(1)).cast("bigint").alias("refcount"))
    query = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    seen = spark.read.schema("chunk_hash string, refcount bigint, epoch int").parquet(f"{folder}/out")
    return seen.groupBy("chunk_hash").agg(F.max_by("refcount", "epoch").alias("refcount"))


def as_chunks(df: DataFrame, column: str) -> DataFrame:
    return df.select(sha256(F.encode(F.col(column), "UTF-8")).alias("chunk_hash"))


class ProgressListener(StreamingQueryListener):
    """Hands a whole percent of ``total`` rows to ``report`` after every batch; spark.streams.addListener(...)."""

    def __init__(self, total: int, report):
        self.total, self.report, self.processed = total, report, 0

    def onQueryStarted(self, event):
        self.report({"percent": 0, "total": self.total, "processed": 0})

    def onQueryProgress(self, event):
        self.processed += event.progress.numInputRows
        self.report({"percent": self.processed * 100 // self.total if self.total else 0, "total": self.total, "processed": self.processed})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
