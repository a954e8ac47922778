"""Exact duplicates: articles of a site with the same text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(text: Column) -> Column:
    return F.md5(text)


def deduplicate(
    articles: DataFrame,
    group: Sequence[str] = ("site_id",),
    order: str = "crawl_rank",
    text: str = "content_text",
) -> DataFrame:
    """Keep the first article per text fingerprint within each group.

    One pass over the articles: a task keeps the first article of every text that it
    reads before anything is shuffled, so a third of all rows sharing one (for
    example empty) text cost one row per task. NULL is a group, a
    text and a position like any other, the last position. Rows that repeat group,
    position and text count as one article.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in articles.columns])
    place = F.struct(F.col(order).isNull(), F.col(order))
    kept = articles.groupBy(*group, fingerprint(F.col(text))).agg(F.min_by(row, place).alias("kept"))
    return kept.select("kept.*")


def duplicate_groups(
    articles: DataFrame,
    group: Sequence[str] = ("site_id",),
    order: str = "crawl_rank",
    text: str = "content_text",
) -> DataFrame:
    """(group, fingerprint, n, first): texts that occur more than once."""
    return (
        articles.groupBy(*group, fingerprint(F.col(text)).alias("fingerprint"))
        .agg(F.count("*").alias("n"), F.min(order).alias("first"))
        .where(F.col("n") > 1)
    )
