"""Index algebra: reference counts, new against stored chunks, deletion and pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def refcount(refs: DataFrame, key: str = "chunk_hash") -> DataFrame:
    """Every occurrence counts, repeats inside one file as well."""
    return refs.groupBy(key).agg(F.count(F.lit(1)).cast("bigint").alias("refcount"))


def backup_totals(files: DataFrame, refs: DataFrame) -> DataFrame:
    """One row: files_total, distinct_chunks, refs, written_bytes, deduplicated_bytes, total_bytes.

    Counts per hash come first (combined before the shuffle), so a hot chunk is one row a task."""
    per = refs.groupBy("chunk_hash").agg(F.count(F.lit(1)).alias("rc"), F.max("n").alias("n"))
    totals = per.agg(
        F.count(F.lit(1)).cast("bigint").alias("distinct_chunks"), F.coalesce(F.sum("rc"), F.lit(0)).cast("bigint").alias("refs"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("written_bytes"), F.coalesce(F.sum(F.col("n") * (F.col("rc") - 1)), F.lit(0)).cast("bigint").alias("deduplicated_bytes"),
        F.coalesce(F.sum(F.col("n") * F.col("rc")), F.lit(0)).cast("bigint").alias("total_bytes"),
    )
    return files.agg(F.count(F.lit(1)).cast("bigint").alias("files_total")).join(totals)  # two single rows


def against_index(refs: DataFrame, index: DataFrame) -> DataFrame:
    """One row: new_chunks, reused_chunks, written_bytes, deduplicated_bytes of refs that meet a stored index."""
    per = refs.groupBy("chunk_hash").agg(F.count(F.lit(1)).alias("rc"), F.max("n").alias("n"))
    known = index.select(F.col("chunk_hash"), F.lit(True).alias("known"))
    x = per.join(known, "chunk_hash", "left").withColumn("new", F.col("known").isNull())
    sum_ = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return x.agg(sum_(F.col("new").cast("int")).alias("new_chunks"), sum_((~F.col("new")).cast("int")).alias("reused_chunks"), sum_(F.when(F.col("new"), F.col("n"))).alias("written_bytes"), sum_(F.when(F.col("new"), F.col("n") * (F.col("rc") - 1)).otherwise(F.col("n") * F.col("rc"))).alias("deduplicated_bytes"))


def resume(refs: DataFrame, index: DataFrame, processed: DataFrame) -> DataFrame:
    """One row: skipped_chunks (new, but uploaded by the interrupted run), uploaded_chunks, written_bytes (of both)."""
    new = refs.groupBy("chunk_hash").agg(F.max("n").alias("n")).join(index.select("chunk_hash"), "chunk_hash", "left_anti")
    x = new.join(processed.select("chunk_hash").distinct().withColumn("done", F.lit(1)), "chunk_hash", "left")
    return x.agg(F.count("done").cast("bigint").alias("skipped_chunks"), F.count(F.when(F.col("done").isNull(), 1)).cast("bigint").alias("uploaded_chunks"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("written_bytes"))


def snapshot_accounting(refs: DataFrame) -> DataFrame:
    """Per snapshot in order: refs, new_chunks, written_bytes, deduplicated_bytes. A chunk is new where it first appears."""
    per = refs.groupBy("snap", "chunk_hash").agg(F.count(F.lit(1)).alias("rc"), F.max("n").alias("n"))
    # at most one row a snapshot in a window
    x = per.withColumn("new", (F.col("snap") == F.min("snap").over(W.partitionBy("chunk_hash"))).cast("int"))
    return x.groupBy("snap").agg(F.sum("rc").cast("bigint").alias("refs"), F.sum("new").cast("bigint").alias("new_chunks"), F.sum(F.col("n") * F.col("new")).cast("bigint").alias("written_bytes"), F.sum(F.col("n") * (F.col("rc") - F.col("new"))).cast("bigint").alias("deduplicated_bytes"))


def after_delete(index: DataFrame, removed: DataFrame) -> DataFrame:
    """chunk_hash, refcount (0: orphaned) once the removed references are taken off; unknown hashes are ignored, and
    no count goes below zero."""
    gone = removed.groupBy("chunk_hash").agg(F.count(F.lit(1)).alias("gone"))
    return index.join(gone, "chunk_hash", "left").select("chunk_hash", F.greatest(F.col("refcount") - F.coalesce("gone", F.lit(0)), F.lit(0)).cast("bigint").alias("refcount"))


def orphan_counts(after: DataFrame) -> DataFrame:
    zero = F.col("refcount") == 0
    return after.agg(F.count(F.when(zero, 1)).cast("bigint").alias("deleted_chunks"), F.coalesce(F.sum("refcount"), F.lit(0)).cast("bigint").alias("remaining_refs"))


def prune_candidates(physical: DataFrame, index: DataFrame, pending: DataFrame) -> DataFrame:
    """item, kind: stored chunks that no index entry names, and every pending log."""
    orphans = physical.join(index, "chunk_hash", "left_anti").select(F.col("chunk_hash").alias("item"), F.lit("chunk").alias("kind"))
    return orphans.unionByName(pending.select(F.concat(F.lit("pending_"), F.col("hash")).alias("item"), F.lit("pending").alias("kind")))
