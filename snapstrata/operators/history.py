"""Snapshot history: newest-first lists, pages, prefix resolution, pending logs and restore plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from snapstrata.functions.scalars import PAGE, rfc3339, short


def log(summaries: DataFrame) -> DataFrame:
    """backup, backup_short, message, timestamp, timestamp_unix, size_bytes, newest first (ord descending)."""
    return summaries.orderBy(F.desc("ord")).select(F.col("hash").alias("backup"), short(F.col("hash")).alias("backup_short"), "message", rfc3339(F.col("timestamp")).alias("timestamp"), F.col("timestamp").alias("timestamp_unix"), F.col("size").alias("size_bytes"))


def log_page(summaries: DataFrame, page: int, size: int = PAGE) -> DataFrame:
    """page, rn, backup_short of one page (from 1): a top-k, so that no task sorts the whole list."""
    top = summaries.orderBy(F.desc("ord")).limit(page * size)
    ranked = top.select("hash", F.row_number().over(W.orderBy(F.desc("ord"))).cast("bigint").alias("rn"))  # at most page * size rows
    return ranked.where(F.col("rn") > (page - 1) * size).select(F.lit(page).cast("bigint").alias("page"), "rn", short(F.col("hash")).alias("backup_short"))


def resolve_prefix(summaries: DataFrame, prefixes: list[str]) -> DataFrame:
    """prefix, hash: up to 8 characters mean the newest summary that starts so (null: none); longer ones are taken as they are."""
    picks = [F.lit(p).alias(f"h{i}") if len(p.encode()) > 8 else F.max_by(F.when(F.startswith("hash", F.lit(p)), F.col("hash")), F.when(F.startswith("hash", F.lit(p)), F.col("ord"))).alias(f"h{i}") for i, p in enumerate(prefixes)]
    one = summaries.agg(F.count(F.lit(1)), *picks)
    pairs = F.array(*[F.struct(F.lit(p).alias("prefix"), F.col(f"h{i}").alias("hash")) for i, p in enumerate(prefixes)])
    return one.select(F.explode(pairs).alias("x")).select("x.prefix", "x.hash")


def resolve_pending(pending: DataFrame, prefixes: list[str]) -> DataFrame:
    """prefix, hash: the greatest name that starts so; null if there is none."""
    one = pending.agg(*[F.max(F.when(F.startswith("hash", F.lit(p)), F.col("hash"))).alias(f"h{i}") for i, p in enumerate(prefixes)])
    pairs = F.array(*[F.struct(F.lit(p).alias("prefix"), F.col(f"h{i}").alias("hash")) for i, p in enumerate(prefixes)])
    return one.select(F.explode(pairs).alias("x")).select("x.prefix", "x.hash")


def pending_list(pending: DataFrame) -> DataFrame:
    """backup, backup_short, uploaded_chunks by name; pending: hash, uploaded."""
    return pending.select(F.col("hash").alias("backup"), short(F.col("hash")).alias("backup_short"), F.col("uploaded").alias("uploaded_chunks")).orderBy("backup")


def restore_plan(tree: DataFrame, local: DataFrame) -> DataFrame:
    """path, action: restore_missing, restore_changed, skip; delete_local for files that the backup does not have."""
    here = local.select("path", F.col("hash").alias("local_hash"), F.lit(True).alias("here"))
    there = tree.select("path", "hash", F.lit(True).alias("there"))
    both = there.join(here, "path", "full_outer")
    action = F.when(F.col("there").isNull(), "delete_local").when(F.col("here").isNull(), "restore_missing").when(F.col("hash").eqNullSafe(F.col("local_hash")), "skip").otherwise("restore_changed")
    return both.select("path", action.alias("action"))
