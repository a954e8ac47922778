"""Feeds: one RSS document per site, as lines, so that a site may have any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefeed.functions.feedxml import TAIL, channel_head, rss_item

_LAST = 2**62


def feed_items(articles: DataFrame) -> DataFrame:
    """(site_id, crawl_rank, item): the XML of each article."""
    item = F.expr(rss_item("title", "url", "content"))
    return articles.select("site_id", "crawl_rank", item.alias("item"))


def feed_lines(articles: DataFrame, seeds: DataFrame, order: str = "crawl") -> DataFrame:
    """(site_id, seq, xml): the pieces of every feed; in ``seq`` order they are the document.

    Nothing is gathered, so a site may have any number of articles. Sites
    without articles keep an empty channel. ``order="reverse"`` lists the last
    visited article first.
    """
    rank = F.col("crawl_rank").cast("bigint")
    seq = {"crawl": rank, "reverse": -rank}[order]
    heads = seeds.select(
        "site_id", F.lit(-_LAST).alias("seq"), F.expr(channel_head("seed_url")).alias("xml")
    )
    tails = seeds.select("site_id", F.lit(_LAST).alias("seq"), F.lit(TAIL).alias("xml"))
    items = feed_items(articles).select("site_id", seq.alias("seq"), F.col("item").alias("xml"))
    return heads.unionByName(items).unionByName(tails)
