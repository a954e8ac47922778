"""Link and image tables, and the in-site predicate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefeed.functions import html, urls
from sitefeed.functions.exprs import let, with_computed
from sitefeed.functions.urls import DEFAULT_SUFFIXES


def page_hrefs(pages: DataFrame, *keys: str) -> DataFrame:
    """(keys, link_pos, href): every anchor of the whole page in document order."""
    # The outer form: a plain explode makes Spark filter on the array's size first,
    # which would extract the links of each page twice.
    found = F.posexplode_outer(F.expr(html.hrefs("html"))).alias("link_pos", "href")
    return pages.select(*keys, found).where(F.col("link_pos").isNotNull())


def resolve_links(hrefs: DataFrame) -> DataFrame:
    """Add ``dst_url``: the href resolved against ``src_url`` and normalised.

    Links with a malformed host are dropped one by one.
    """
    target = urls.normalize_url(urls.resolve_url("src_url", "href"))
    return with_computed(hrefs, "dst_url", target).where(F.col("dst_url").isNotNull())


def page_links(pages: DataFrame) -> DataFrame:
    """(src_url, link_pos, href, dst_url) of all pages."""
    hrefs = page_hrefs(pages.withColumnRenamed("url", "src_url"), "src_url")
    return resolve_links(hrefs)


def page_images(pages: DataFrame, mode: str = "v2") -> DataFrame:
    """(url, img_pos, src_abs) of every image tag; NULL where it has no address."""
    found = F.posexplode_outer(F.expr(html.image_tags(html.strip_opaque("html"))))
    tags = pages.select("url", found.alias("img_pos", "tag")).where(F.col("img_pos").isNotNull())
    source = let(html.attributes("tag"), lambda attrs: html.image_source(attrs, mode))
    absolute = let(source, lambda src: urls.resolve_url("url", src))
    return tags.select("url", "img_pos", F.expr(absolute).alias("src_abs"))


def in_site_links(
    links: DataFrame, seeds: DataFrame, suffixes: DataFrame | Sequence[str] = DEFAULT_SUFFIXES
) -> DataFrame:
    """Links whose target lies on the registrable domain of a seed, with its site_id.

    An equi-join on the domain. The seed side is not hinted: it is broadcast
    when its measured size allows, else both sides shuffle and skewed domains
    are split by adaptive execution. ``suffixes`` may be a table of rules.
    """
    sites = urls.with_domain(seeds, "seed_url", "domain", suffixes).select("site_id", "domain")
    if isinstance(suffixes, DataFrame):
        placed = urls.with_domain(links, "dst_url", "domain", suffixes)
    else:
        placed = with_computed(links, "domain", urls.registrable_domain("dst_url", suffixes))
    return placed.join(sites, "domain").drop("domain")
