"""Articles: title, main content, image repair, plain text and thin-page fallback."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sitefeed.functions import html
from sitefeed.functions.exprs import strip
from sitefeed.operators.main_content import with_main
from sitefeed.sources.pages import OK, html_pages, one_per_page, page_snapshot

Extractor = Callable[[pd.Series, pd.Series], pd.Series]


def is_short(text: str) -> str:
    return f"length({text}) < {html.SHORT_TEXT}"


def extractor_column(extractor: Extractor) -> Callable[[Column, Column], Column]:
    """Wrap ``extractor(urls, pages) -> contents`` as a vectorised column of (content, failed).

    NULL pages are not handed to it. If a batch fails, its rows are retried one
    by one and only the failing ones have ``failed`` set and no content.
    """

    def one_by_one(urls: pd.Series, pages: pd.Series, out: pd.DataFrame) -> None:
        for i in urls.index:
            try:
                out.loc[i, "content"] = extractor(urls[[i]], pages[[i]]).iloc[0]
            except Exception:  # noqa: BLE001 - a failing page must not fail the job
                out.loc[i, "failed"] = True

    @pandas_udf("content string, failed boolean")
    def call(urls: pd.Series, pages: pd.Series) -> pd.DataFrame:
        wanted = pages.notna()
        out = pd.DataFrame({"content": pd.Series([None] * len(pages), dtype=object), "failed": False})
        out.index = pages.index
        if wanted.any():
            try:
                out.loc[wanted, "content"] = pd.Series(extractor(urls[wanted], pages[wanted])).to_numpy()
            except Exception:  # noqa: BLE001
                one_by_one(urls[wanted], pages[wanted], out)
        return out

    return call


def fallback_content(page: str, extracted: str | None = None, mode: str = "v2") -> str:
    """Content of a thin page: the extractor's, else the whole page (v1: its text)."""
    default = page if mode == "v2" else html.html_to_text(page)
    if extracted is None:
        return default
    return f"coalesce(if({strip(extracted)} <> '', {extracted}, NULL), {default})"


def page_articles(
    pages: DataFrame, mode: str = "v2", extractor: Extractor | None = None
) -> DataFrame:
    """Add title, content, content_text and content_from to rows of (url, html, main, ...).

    ``main`` is the main content (NULL: the whole page). All steps but the
    extractor are JVM expressions, and the extractor sees thin pages only.
    ``content_from`` tells where content is from: ``main``, or for thin pages ``extractor``,
    or the whole page because there is no extractor (``page``), it raised an error on
    this page (``failed``), gave NULL (``none``) or only blanks (``blank``).
    """
    found = pages.withColumn("_main", F.coalesce("main", "html")).withColumn(
        "_text", F.expr(html.html_to_text("_main"))
    )
    short = is_short("_text")
    extracted, origin = None, "'page'"
    if extractor is not None:
        extracted = "_extracted.content"
        call = extractor_column(extractor)
        found = found.withColumn(
            "_extracted", call(F.expr(f"if({short}, url, NULL)"), F.expr(f"if({short}, html, NULL)"))
        )
        origin = (
            f"CASE WHEN _extracted.failed THEN 'failed' WHEN {extracted} IS NULL THEN 'none' "
            f"WHEN {strip(extracted)} = '' THEN 'blank' ELSE 'extractor' END"
        )
    fallback = fallback_content("html", extracted, mode)
    origin = f"if({short}, {origin}, 'main')"
    title = html.decorate_title(html.extract_title("html", "url", mode), "url", mode)
    return (
        found.withColumn("_content", F.expr(f"if({short}, {fallback}, _main)"))
        .withColumn("title", F.expr(title))
        .withColumn("content_from", F.expr(origin))
        .withColumn("content", F.expr(html.fix_image_urls("_content", "url", mode)))
        .withColumn(
            "content_text", F.expr(f"if({short}, {html.html_to_text('_content')}, _text)")
        )
        .drop("_main", "_text", "_content", "_extracted", "main", "html")
    )


def extract_articles(
    visits: DataFrame,
    pages: DataFrame,
    mode: str = "v2",
    extractor: Extractor | None = None,
) -> DataFrame:
    """Articles of a crawl, with site_id, crawl_rank and depth.

    ``visits`` is the output of ``crawl``. Bodies meet the (narrow) visits in one join;
    only pages that the crawl reached are scored.
    """
    snapshot = html_pages(one_per_page(page_snapshot(pages))).select("page_id", "html")
    wanted = visits.where(F.col("status") == OK).select(
        "site_id", "crawl_rank", "depth", "url", "page_id"
    )
    bodies = with_main(wanted.join(snapshot, "page_id"))
    return page_articles(bodies, mode, extractor).select(
        "site_id", "crawl_rank", "depth", "title", "url", "content", "content_text", "content_from"
    )
