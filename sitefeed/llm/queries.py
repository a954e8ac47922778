"""The opN_ queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefeed.llm import (
    backoff_lm,
    byte_cnn,
    decontamination,
    embedding_dedup,
    extendible_hash,
    lexical_search,
    license_scan,
    mixing,
    ngram_jaccard,
    secret_scan,
    substring_dedup,
    toxicity,
    vector_codes,
)
from sitefeed.llm.common import table


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Share of the tokens that each language is to have after mixing.
LANGUAGE_SHARES = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def language_labels(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents with their language as the domain; other languages are to be predicted."""
    return documents.join(labels.select("doc_id").distinct(), "doc_id").select("doc_id", F.col("lang").alias("domain"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return mixing.rates(documents, language_labels(documents, labels), LANGUAGE_SHARES)


def op4_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.score(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.contamination(documents, items)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(table(spark, sf_dir, "documents"))


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_hash.exact_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_ngram_jaccard, op2_toxicity, op3_source_mixing, op4_backoff_lm, op5_embedding_dedup,
        op6_decontamination, op7_secret_scan, op8_substring_dedup, op9_license_scan, op10_byte_cnn,
        op11_vector_codes, op12_lexical_search, op13_exact_dedup,
    )
    return {q.__name__: q for q in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard": ngram_jaccard.SQL,
        "op5_embedding_dedup": embedding_dedup.SQL,
        "op6_decontamination": decontamination.SQL,
        "op8_substring_dedup": substring_dedup.SQL,
        "op11_vector_codes": vector_codes.SQL,
        "op12_lexical_search": lexical_search.SQL,
        "op13_exact_dedup": extendible_hash.SQL,
    }
