"""Exact deduplication by skew-safe combining (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapstrata.llm.common import table
from snapstrata.llm.spans import one_of_each, row_key

#: Fixed characters that do not count when texts are compared: [\x20\x09-\x0D].
BLANKS = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def normalised(text: Column) -> Column:
    """The text without BLANKS; null counts as empty. Plain byte replacement, no regular expression."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _combined(rows: DataFrame, salts: int) -> DataFrame:
    """One row per content: digest, norm, rank (of the row that stays), group_size. rows: digest, norm, salt, rank."""
    salted = rows.groupBy("digest", "norm", "salt").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy("digest", "norm").agg(F.min("rank").alias("rank"), F.sum("n").alias("group_size"))


def _rows(docs: DataFrame, salts: int, id_col: str, text_col: str, digest, *more: Column) -> DataFrame:
    """doc_id, norm, sha, digest, salt, rank; ``more`` goes into the rank, last."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rank = F.struct((-F.char_length(text)).alias("c"), F.col(id_col).isNull().alias("n"), F.col(id_col).alias("d"), *more)
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"), rank.alias("rank")).withColumn("sha", F.sha2("norm", 256))
    return rows.select("doc_id", "norm", "sha", digest(F.col("sha")).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"), "rank")


def exact_groups(docs: DataFrame, salts: int = 16, id_col: str = "doc_id", text_col: str = "text", digest=lambda sha: sha) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Equal texts are those that are identical without blanks. Three combining steps, each grouped by the
    whole normalised content beside its digest, so a digest collision cannot join two texts:
      1. local: the map side of the first aggregation keeps one row per content and task;
      2. salted: rows meet by (digest, content, salt), at most 1/salts of a hot group in one task;
      3. global: at most ``salts`` winners per content meet.
    Survivors come back to the documents by digest and length as an ordinary join, whose hot keys adaptive
    execution splits. Contents that share digest and length (a collision; ``digest`` is there to force one) are told apart by
    the content itself; with SHA-256 there are none, and one look at the survivors says so.

    Null texts count as empty texts and form one group. Ties go to the smallest id. Repeated rows
    with one id count as members; each comes back. An empty table gives an empty result. Null ids are
    members too and lose every tie. Extra columns are ignored."""
    rows = _rows(docs, salts, id_col, text_col, digest).withColumn("bytes", F.octet_length("norm"))
    key = ["digest", "bytes"]
    groups = table(_combined(rows, salts).select("digest", F.octet_length("norm").alias("bytes"), F.col("rank.d").alias("keep_id"), "group_size"), "exact-groups")
    clash = groups.groupBy(*key).count().where("count > 1").select(*key)
    apart = clash.limit(1).count() == 0
    plain = groups if apart else groups.join(clash, key, "left_anti")
    found = rows.select("doc_id", "sha", *key).join(plain, key).select("doc_id", "keep_id", "group_size", "sha")
    if not apart:
        own = rows.join(clash, key, "left_semi")
        whole = _combined(own, salts).select("norm", F.col("rank.d").alias("keep_id"), "group_size")
        found = found.unionByName(own.select("doc_id", "sha", "norm").join(whole, "norm").select("doc_id", "keep_id", "group_size", "sha"))
    return found.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame, salts: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents whose row stays, with all their columns; of rows that agree in id and text one stays. Nulls, ties, repeated
    rows, empty tables and extra columns are handled as in ``exact_groups``."""
    rows = _rows(docs, salts, id_col, text_col, lambda sha: sha, row_key(id_col, text_col).alias("r"))
    return one_of_each(docs, _combined(rows, salts).select("rank.r"), id_col, text_col)
