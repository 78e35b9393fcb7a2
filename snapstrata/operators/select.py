"""Path selection, search, ignore rules and directory rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapstrata.functions.scalars import display_path, normalise_only_text


def ancestors(path: F.Column, itself: bool = False) -> F.Column:
    """All proper directory prefixes of a path, shortest first (and the path itself)."""
    parts = F.split(path, "/")
    n = F.size(parts) if itself else F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def only_select(paths: DataFrame, wanted: list[str]) -> DataFrame:
    """path, sorted and distinct: for each request the file of that exact path, else all files below it.

    Equi-joins of a file's ancestors to the requests, never a prefix test per pair. A request that matches nothing
    fails the whole call: the selection is computed once, kept, and asked for the requests that it answers."""
    if not wanted:
        raise ValueError("empty selection")
    spark: SparkSession = paths.sparkSession
    asked = spark.createDataFrame([(x,) for x in sorted({normalise_only_text(w) for w in wanted})], "want string")
    exact = paths.join(asked, paths.path == asked.want).select("path", "want")
    rest = asked.join(exact.select("want"), "want", "left_anti")
    below = paths.select("path", F.explode(ancestors(F.col("path"))).alias("want")).join(rest, "want").select("path", "want")
    found = exact.unionByName(below).persist()
    answered = {r.want for r in found.select("want").distinct().collect()}  # requests, typed by a user
    missing = sorted({normalise_only_text(w) for w in wanted} - answered)
    if missing:
        found.unpersist()
        raise ValueError("no file matches: " + ", ".join(missing))
    return found.select("path").distinct().orderBy("path")


def path_search(paths: DataFrame, query: str) -> DataFrame:
    """path, display: case-insensitive substring of the whole path; an empty query matches all."""
    return paths.where(F.contains(F.lower("path"), F.lower(F.lit(query)))).select("path", display_path(F.col("path")).alias("display")).orderBy("path")


def ignore_filter(paths: DataFrame, patterns: list[str]) -> DataFrame:
    """Files of which no part of the path equals a pattern: a match prunes the whole subtree."""
    if not patterns:
        return paths
    return paths.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, patterns))))


def dir_tree(paths: DataFrame) -> DataFrame:
    """parent, name, is_dir of all files and directories; the root is ''."""
    dirs = paths.select(F.explode(ancestors(F.col("path"))).alias("p")).distinct().select("p", F.lit(True).alias("is_dir"))
    entries = dirs.unionByName(paths.select(F.col("path").alias("p"), F.lit(False).alias("is_dir")))
    parts = F.split("p", "/")
    return entries.select(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("parent"), F.element_at(parts, -1).alias("name"), "is_dir").orderBy("parent", F.desc("is_dir"), "name")


def selection_rollup(files: DataFrame) -> DataFrame:
    """path, state of every directory, from files (path, selected): Selected if all below is, Partial if some is."""
    x = files.select(F.explode(ancestors(F.col("path"))).alias("path"), F.col("selected").cast("int").alias("s"))
    n, s = F.count(F.lit(1)), F.sum("s")
    return x.groupBy("path").agg(F.when(s == n, "Selected").when(s > 0, "Partial").otherwise("None").alias("state"))


def cleanup_dirs(paths: DataFrame) -> DataFrame:
    """dir, depth: directories deepest first, as an emptying pass visits them."""
    dirs = paths.select(F.explode(ancestors(F.col("path"))).alias("dir")).distinct()
    return dirs.select("dir", F.size(F.split("dir", "/")).cast("bigint").alias("depth")).orderBy(F.desc("depth"), "dir")
