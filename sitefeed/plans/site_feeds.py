"""The whole job: page snapshot and seeds to unique articles and feeds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from sitefeed.functions.urls import DEFAULT_SUFFIXES
from sitefeed.operators.articles import Extractor, extract_articles
from sitefeed.operators.crawl import MAX_PAGES, crawl
from sitefeed.operators.exact_dedup import deduplicate
from sitefeed.operators.feeds import feed_lines
from sitefeed.operators.near_dedup import deduplicate_similar
from sitefeed.operators.report import content_report, crawl_report, site_summary
from sitefeed.runtime import materialize


@dataclass(frozen=True)
class SiteFeeds:
    """Tables of one run."""

    visits: DataFrame
    articles: DataFrame
    feed: DataFrame
    report: DataFrame
    contents: DataFrame
    summary: DataFrame


def site_feeds(
    pages: DataFrame,
    seeds: DataFrame,
    mode: str = "v2",
    max_pages: int | None = MAX_PAGES,
    extractor: Extractor | None = None,
    suffixes: DataFrame | Sequence[str] = DEFAULT_SUFFIXES,
) -> SiteFeeds:
    """Crawl every seed's site in ``pages`` and build its feed.

    ``mode`` selects titles, fallback and dedup of the two variants: v2 drops
    equal texts, v1 drops texts similar to an earlier kept one.
    """
    visits = materialize(crawl(pages, seeds, max_pages, suffixes=suffixes), "visits")
    found = materialize(extract_articles(visits, pages, mode, extractor), "articles")
    unique = deduplicate(found) if mode == "v2" else deduplicate_similar(found)
    return SiteFeeds(
        visits=visits,
        articles=unique,
        feed=feed_lines(unique, seeds),
        report=crawl_report(visits),
        contents=content_report(found),
        summary=site_summary(visits, unique, max_pages),
    )
