"""Shared pieces: tables, the split for learning, words as SQL, bounded samples."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefeed.runtime import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Between words of letters, digits and everything beyond ASCII: in text lower-cased in A-Z, and in any text.
SEPARATORS, SIGNS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: str, modulus: int) -> Column:
    """Rows kept away from learning; a row without a key is not held out."""
    part = F.crc32(F.col(key).cast("string")) % modulus == 2
    return F.coalesce(part, F.lit(False))


def lower_ascii(text: str) -> Column:
    """A-Z in lower case, other letters as they are; null reads as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(
        F.translate(whole, UPPER, LOWER)
    )


def split_words(text: Column, separators: str) -> Column:
    """The stretches between separators. Splitting walks through a text once; extracting matches copies it for each."""
    return F.array_remove(F.split(text, separators, -1), "")


def words_of(text: str) -> Column:
    return split_words(lower_ascii(text), SEPARATORS)


def word_count(text: str) -> Column:
    """Number of ``words_of``; case does not matter for it, so capitals count as letters."""
    return F.size(split_words(F.coalesce(F.col(text), F.lit("")), SIGNS)).cast("long")


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, modulus: int, per_class: int, max_bytes: int
) -> tuple[DataFrame, dict[int, int]]:
    """Bounded sample of labelled rows outside the held-out part, and all class counts.

    Of each class the ``per_class`` rows with the smallest hashed id are taken;
    texts over ``max_bytes`` bytes are left out of the sample. Both bounds hold
    for learning only.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id", modulus))
        .groupBy("doc_id")
        .agg(F.max(label).alias("label"))
    )
    counts = {int(r.label): r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(7))
    parts = [known.where(F.col("label") == k).orderBy(order, "doc_id").limit(per_class) for k in (0, 1)]
    chosen = materialize(parts[0].unionByName(parts[1]), "chosen")
    texts = documents.select("doc_id", "text").where(
        F.col("text").isNotNull() & (F.octet_length("text") <= max_bytes)
    )
    rows = texts.join(chosen, "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.first("label").alias("label")
    )
    return rows, counts


def unused(columns: list[str], name: str) -> str:
    """The name, lengthened until no column has it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def per_batch(frame: DataFrame, schema: str, work, *columns: str) -> DataFrame:
    """``work`` maps Arrow batches of ``columns`` to record batches or tables."""
    frame = frame.select(*columns) if columns else frame

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for out in work(batch):
                    yield from out.to_batches() if isinstance(out, pa.Table) else (out,)

    return frame.mapInArrow(run, schema)


def per_task(frame: DataFrame, schema: str, start, work) -> DataFrame:
    """``work(batch, kept)`` maps Arrow batches; ``kept`` is what ``start()`` gives each task, for all its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = start()
        for batch in batches:
            if batch.num_rows:
                for out in work(batch, kept):
                    yield from out.to_batches() if isinstance(out, pa.Table) else (out,)

    return frame.mapInArrow(run, schema)
