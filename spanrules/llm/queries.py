"""The registered queries of this package, one per operator, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanrules.llm import (byte_bpe, collocations, decontaminate, exact_dedup, html_text, jaccard_join, langid, licenses,
                           merkle, quality, sharding, substring_dedup, token_files)
from spanrules.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: language and source are the directories of a document."""
    path = F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return licenses.scan(files, id_col="doc_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.copy_groups(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def vocabulary_file() -> tuple[str, str]:
    """The rank file of the byte-level vocabulary and the pattern of its pre-tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), *vocabulary_file())


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = quality.with_scores(docs.select("doc_id", "text", "lang", "source"),
                                 quality.fit(docs, labels))
    return scored.select("doc_id", "score", (scored["score"] >= quality.THRESHOLD).alias("kept"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_of(table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = langid.learn(docs.where(~held_out))
    return langid.label_spans(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered_documents(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_licenses,
    op2_exact_dedup,
    op3_substring_dedup,
    op4_html_text,
    op5_byte_bpe,
    op6_quality,
    op7_decontaminate,
    op8_jaccard_join,
    op9_sharding,
    op10_langid,
    op11_token_files,
    op12_merkle,
    op13_collocations,
)}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op9_sharding": sharding.oracle_sql(),
    "op12_merkle": merkle.oracle_sql(),
    "op13_collocations": collocations.oracle_sql(),
}
