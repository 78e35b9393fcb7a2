"""Fixed-size chunks of file contents and their hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapstrata.functions.scalars import sha256
from snapstrata.schema import CONTENT_TYPE


def chunk(files: DataFrame, size: int, keep_bytes: bool = False) -> DataFrame:
    """files' other columns, seq, chunk_hash, n (and bytes): one row per chunk of content; an empty file has none."""
    others = [c for c in files.columns if c != "content"]
    n = F.octet_length("content")
    # the guard comes first: a sequence up to (0 - 1) div size would not be empty
    seqs = files.where(n > 0).select("*", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / F.lit(size)).cast("int"))).alias("seq"))
    cut = seqs.select(*others, "seq", F.expr(f"substring(content, seq * {size} + 1, {size})").alias("bytes"))
    out = cut.select(*others, F.col("seq").cast("bigint").alias("seq"), sha256(F.col("bytes")).alias("chunk_hash"), F.octet_length("bytes").cast("bigint").alias("n"), *(["bytes"] if keep_bytes else []))
    return out


def file_hashes(files: DataFrame) -> DataFrame:
    """path, hash, size, content_type, permissions of whole files."""
    return files.select("path", sha256(F.col("content")).alias("hash"), F.octet_length("content").cast("bigint").alias("size"), F.lit(CONTENT_TYPE).alias("content_type"), F.col("permissions").bitwiseAND(F.lit(0o777)).alias("permissions"))


def objects(files: DataFrame, size: int) -> DataFrame:
    """file_hashes with the ordered array of chunk hashes, in one row-wise pass without a shuffle."""
    n = F.octet_length("content")
    last = F.floor((n - 1) / F.lit(size)).cast("int")
    hashes = F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.substring(F.col("content"), i * size + 1, F.lit(size)), 256))).otherwise(F.array().cast("array<string>"))
    return files.select("path", F.sha2("content", 256).alias("hash"), n.cast("bigint").alias("size"), F.lit(CONTENT_TYPE).alias("content_type"), F.col("permissions").bitwiseAND(F.lit(0o777)).alias("permissions"), hashes.alias("chunks"))


def reassemble(chunks: DataFrame, key: list[str]) -> DataFrame:
    """key..., content: the bytes of a file's chunks (seq, bytes) in order, joined in one pass over them."""
    return chunks.groupBy(*key).agg(F.expr("listagg(bytes) within group (order by seq)").alias("content"))
