"""Corpus pipeline: stages over ``documents``, each written as Parquet before the next reads it."""

from __future__ import annotations

import uuid
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from spanrules.llm import byte_bpe, decontaminate, exact_dedup, jaccard_join, quality
from spanrules.llm.common import table
from spanrules.llm.queries import vocabulary_file
from spanrules.session import scratch_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with identical text the one with the largest id stays, in one row."""
    return exact_dedup.drop_copies(docs, one_row=True)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: of five-word shingles, similarity 0.8 or more."""
    return jaccard_join.keep_one(docs, size=5, threshold=Fraction(4, 5))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document as token ids, with digests of the ids and of what they decode to."""
    return byte_bpe.digests(docs, *vocabulary_file())


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("jaccard_join", jaccard_stage),
    ("decontaminate", decontaminate_stage),
    ("byte_bpe", byte_bpe_stage),
]

# The classifier is trained, so no SQL gives its rows; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``, each one's output written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
