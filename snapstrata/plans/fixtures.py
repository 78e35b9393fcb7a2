"""The driver's tables seen as trees, versions, references, summaries, pending logs and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_path() -> F.Column:
    return F.concat_ws("/", F.col("source"), F.col("lang"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path; the texts are not read."""
    return read(spark, sf_dir, "documents").select("doc_id", doc_path().alias("path"))


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, content, permissions. A one-row-group file is dealt out before its bytes are cut and hashed."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    if docs.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        docs = docs.repartition(spark.sparkContext.defaultParallelism)
    return docs.select("doc_id", doc_path().alias("path"), F.encode("text", "UTF-8").alias("content"), F.lit(420).alias("permissions"))


SNAPSHOTS = 8


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """snap, path, content, permissions: conversation files as they stand after each turn."""
    c = read(spark, sf_dir, "conversations").where(F.col("turn") < SNAPSHOTS)
    rows = c.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), F.explode(F.sequence(F.col("turn"), F.lit(SNAPSHOTS - 1).cast("bigint"))).alias("snap"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return rows.groupBy("conv_id", "snap").agg(F.array_join(texts, "\n").alias("text")).select("snap", conv_path().alias("path"), "conv_id", F.encode("text", "UTF-8").alias("content"), F.lit(420).alias("permissions"))


def conv_path() -> F.Column:
    return F.concat(F.lit("conv/"), F.col("conv_id").cast("string"), F.lit(".txt"))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """backup, chunk (text)."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("backup"), F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("chunk"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, hash, message, timestamp, size; ord grows with (date, key)."""
    o = read(spark, sf_dir, "orders")
    seconds = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return o.select(F.struct(seconds.alias("ts"), F.col("o_orderkey").alias("k")).alias("ord"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("hash"), F.col("o_orderpriority").alias("message"), seconds.alias("timestamp"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("size"))


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hash, uploaded: one log per user of the event table; each event is one uploaded chunk."""
    e = read(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.count(F.lit(1)).cast("bigint").alias("uploaded")).select(F.sha2(F.col("user_id").cast("string"), 256).alias("hash"), "uploaded")
