"""A corpus pipeline of five stages, each one of the training-data operators.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage before kept and returns the columns of
documents (and any others that its input has, whatever their names); the last returns packed pieces of token sequences. A
stage's result is written as Parquet and read again before the next, so that a lost executor costs a stage's part at most;
once the next is written, it is deleted.

In every stage a null text counts as empty, a null id is an id like any other that comes last, repeated rows are rows of
their own unless the stage says otherwise, long texts are read whole, and an empty table gives an empty result."""

from __future__ import annotations

import functools
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from snapstrata.llm import op1_packing, op2_ngram_join, op3_quality, op5_exact_dedup, op8_suffix
from snapstrata.llm.common import forget, release, shared_dir, written
from snapstrata.llm.spans import cut_spans, keyed
from snapstrata.session import ship

#: SQL cannot state the classifier and the packing; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier scores at 0.5 or more; labels of the corpus teach it. Repeated rows stay or go
    together; without labels every text scores 0.5 and stays."""
    return op3_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest, then the smallest id. Null and blank texts are one group; of rows
    that agree in id and text one stays."""
    return op5_exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts with a shingle similarity of 0.75 or more: the smallest id. Texts without words
    link with nothing and stay; of rows that agree in id and text one stays."""
    return op2_ngram_join.near_dedup(docs, size=5, t=75)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that occur earlier, cut at whole characters; n_chars follows.

    A document of which nothing is left goes; null and empty texts stay as they are; repeated rows are cut alike."""
    return cut_spans(docs, op8_suffix.repeated_spans(keyed(docs), length=100), chars="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of at most 1024 tokens; null and empty texts are their end token alone, repeated rows
    are packed each."""
    return op1_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


_USED: dict[str, list[str]] = {}  # by application: tables of earlier stages


def _stage(f):
    """Ships the package and deletes what earlier stages left in the shared folder, unless docs still reads it."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        used = _USED.setdefault(spark.sparkContext.applicationId, [])
        if used:
            read = docs.inputFiles()
            free = [p for p in used if p in written(spark) and not any(p.removeprefix("file:").lstrip("/") in x for x in read)]
            release(spark, free)
            used[:] = [p for p in used if p not in free]
            forget(spark)
        before = set(written(spark))
        out = f(spark, docs, sf_dir)
        used.extend(p for p in written(spark) if p not in before)
        return out

    return run_stage


STAGES = [
    ("quality classifier", _stage(quality)),
    ("exact dedup", _stage(exact)),
    ("n-gram Jaccard join", _stage(near)),
    ("suffix-array dedup", _stage(passages)),
    ("best-fit packing", _stage(packing)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result lies in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
        if k:
            release(spark, [f"{folder}/{k - 1}"])
    return docs
