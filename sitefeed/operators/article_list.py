"""The reader's article list: index, label, and lookup of one article."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefeed.functions.feedxml import list_label
from sitefeed.operators.positions import with_positions
from sitefeed.runtime import materialize


def article_index(articles: DataFrame, mode: str = "v2") -> DataFrame:
    """(site_id, idx, crawl_rank, label): 0-based position in crawl order.

    The labels are written first: range partitioning reads its rows twice, and articles may be parsed as they are read.
    """
    keys = materialize(
        articles.select("site_id", "crawl_rank", F.expr(list_label("title", mode)).alias("label")), "labels"
    )
    return with_positions(keys, ["site_id"], ["crawl_rank"], "idx").select(
        "site_id", "idx", "crawl_rank", "label"
    )


def select_article(articles: DataFrame, index: DataFrame, site_id: str, idx: int) -> DataFrame:
    """(content) of the article at a list position; no row when out of range."""
    rank = index.where((F.col("site_id") == site_id) & (F.col("idx") == idx)).select(
        "site_id", "crawl_rank"
    )
    # The literal filter repeats the join key so that it reaches the article scan.
    own = articles.where(F.col("site_id") == site_id)
    return own.join(rank, ["site_id", "crawl_rank"]).select("content")
