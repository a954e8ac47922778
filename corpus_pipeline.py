"""A corpus pipeline: quality, near copies, benchmark passages, secrets, mixing.

Every stage takes (spark, docs, sf_dir), works on all documents that the one
before it kept, and returns them with the columns of documents; the last one adds
``rate``. Rows without doc_id and null or empty texts pass through every stage but
the quality classifier, which judges them like any text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefeed.llm import byte_cnn, decontamination, mixing, ngram_jaccard, queries, secret_scan
from sitefeed.llm.common import table
from sitefeed.runtime import materialize


def of_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return byte_cnn.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more, the least doc_id stays."""
    return ngram_jaccard.keep_one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays."""
    masked = secret_scan.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays and gets the rate it is to be drawn with."""
    labelled = queries.language_labels(docs, table(spark, sf_dir, "labels"))
    return mixing.with_rates(docs, labelled, queries.LANGUAGE_SHARES)


STAGES = [
    ("quality classifier", of_good_quality),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("mixing to target weights", mixed_to_targets),
]

#: Classifiers and inferred automata have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
