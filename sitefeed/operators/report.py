"""What a crawl did: counts per level, and per site before and after dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefeed.operators.crawl import MAX_PAGES
from sitefeed.sources.pages import OK


def crawl_report(visits: DataFrame) -> DataFrame:
    """(site_id, depth, status, n)."""
    return visits.groupBy("site_id", "depth", "status").agg(F.count("*").alias("n"))


def content_report(articles: DataFrame) -> DataFrame:
    """(site_id, content_from, n): how often thin pages needed a fallback, which, and why."""
    return articles.groupBy("site_id", "content_from").agg(F.count("*").alias("n"))


def site_summary(
    visits: DataFrame, unique_articles: DataFrame, max_pages: int | None = MAX_PAGES
) -> DataFrame:
    """(site_id, n_visited, n_articles, n_failed, progress, n_unique, n_duplicates)."""
    fetched = visits.groupBy("site_id").agg(
        F.count("*").alias("n_visited"),
        F.count_if(F.col("status") == OK).alias("n_articles"),
        F.count_if(F.col("status") != OK).alias("n_failed"),
    )
    unique = unique_articles.groupBy("site_id").agg(F.count("*").alias("n_unique"))
    n_unique = F.coalesce("n_unique", F.lit(0))
    share = F.col("n_articles") / F.lit(max_pages) * 100
    progress = F.least(share, F.lit(100.0)) if max_pages else F.lit(None).cast("double")
    return fetched.join(unique, "site_id", "left").select(
        "site_id",
        "n_visited",
        "n_articles",
        "n_failed",
        progress.alias("progress"),
        n_unique.alias("n_unique"),
        (F.col("n_articles") - n_unique).alias("n_duplicates"),
    )
