
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefeed.functions import feedxml, html, urls
from sitefeed.functions.exprs import with_computed
from sitefeed.operators import articles as article_ops
from sitefeed.operators import exact_dedup, near_dedup
from sitefeed.operators.article_list import article_index, select_article
from sitefeed.operators.crawl import MAX_PAGES, crawl, walk
from sitefeed.operators.feeds import feed_items, feed_lines
from sitefeed.operators.links import in_site_links, page_hrefs, page_images, page_links
from sitefeed.operators.main_content import block_table, main_spans, score_blocks, with_main
from sitefeed.operators.positions import with_positions
from sitefeed.operators.report import content_report, crawl_report, site_summary
from sitefeed.plans.site_feeds import site_feeds
from sitefeed.runtime import materialize, work_dir
from sitefeed.sources.pages import html_pages, one_per_page, page_snapshot, spread
from sitefeed.sources.sinks import lookup_article, read_feed_items, save_articles, write_feeds

try:
    import corpus_pipeline
    from sitefeed.llm import queries as corpus_queries
except ModuleNotFoundError as missing:
    # Both are optional, together; anything else that is missing is an error.
    if missing.name not in ("corpus_pipeline", "sitefeed.llm"):
        raise
    corpus_pipeline = corpus_queries = None

WALK_LIMIT = 20


# Inputs ---------------------------------------------------------------------


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _page_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is the seed of its own site."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select(F.col("page_id").cast("string").alias("site_id"), F.col("url").alias("seed_url"))


def _domain_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site per registrable domain, seeded with its first page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.groupBy(F.expr(urls.registrable_domain("url")).alias("site_id")).agg(
        F.min_by("url", "page_id").alias("seed_url")
    )


def _articles(spark: SparkSession, sf_dir: str, mode: str = "v2", pages: DataFrame | None = None) -> DataFrame:
    """Articles of all pages, content = the scored main content, in page order per domain."""
    pages = (_pages(spark, sf_dir) if pages is None else pages).select(
        F.expr(urls.registrable_domain("url")).alias("site_id"),
        F.col("page_id").alias("crawl_rank"),
        "url",
        "html",
    )
    return article_ops.page_articles(with_main(pages), mode)


def _contents(pages: DataFrame) -> DataFrame:
    """The pages with their main content, or else all of it, as ``content``."""
    return with_main(pages).withColumn("content", F.coalesce("main", "html")).drop("main")


# Queries --------------------------------------------------------------------


def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select(
        "page_id", F.expr(urls.normalize_url("url")).alias("url_norm")
    )


def url_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        url_normalize(spark, sf_dir)
        .groupBy("url_norm")
        .agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))
        .where(F.col("n") > 1)
    )


def site_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return pages.groupBy(F.expr(urls.registrable_domain("url")).alias("domain")).agg(
        F.count("*").alias("n_pages"),
        F.countDistinct(F.expr(urls.url_host("url"))).alias("n_hosts"),
    )


def fetch_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a query answer 404 and pages with a fragment are not HTML here."""
    url = F.col("url")
    answered = (
        _pages(spark, sf_dir)
        .withColumn("status", F.when(url.contains("?"), 404).otherwise(200))
        .withColumn(
            "content_type",
            F.when(url.contains("#"), "application/pdf").otherwise("text/html; charset=utf-8"),
        )
    )
    return html_pages(page_snapshot(answered)).select("page_id", "url")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_links(_pages(spark, sf_dir))


def site_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_site_links(
        page_links(_pages(spark, sf_dir)), _domain_seeds(spark, sf_dir)
    ).select("site_id", "src_url", "link_pos", "dst_url")


def missing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    known = pages.select(F.expr(urls.normalize_url("url")).alias("dst_url"))
    return (
        page_links(pages)
        .join(known, "dst_url", "left_anti")
        .groupBy("dst_url")
        .agg(F.count("*").alias("n_links"))
    )


def _image_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages with a lazily loaded image put into every closed paragraph."""
    image = '<img alt="a &amp; b" data-src="/img/pic.png?w=1"></p>'
    return _pages(spark, sf_dir).withColumn("html", F.replace("html", F.lit("</p>"), F.lit(image)))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_images(_image_pages(spark, sf_dir))


def fixed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = F.expr(html.fix_image_urls("content", "url"))
    return _contents(_image_pages(spark, sf_dir)).select("page_id", fixed.alias("content"))


def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.expr(html.extract_title("html", "url"))
    return (
        _pages(spark, sf_dir)
        .select("page_id", "url", title.alias("title"))
        .select("page_id", "title", F.expr(html.decorate_title("title", "url")).alias("decorated"))
    )


def title_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles when headings vanish: h2 after an empty h1, social card, title, URL."""
    page = F.col("html")
    card = '<head><meta content="Card" property="og:title">'
    no_heads = F.replace(page, F.lit("h1>"), F.lit("h5>"))
    variants = {
        "second": F.replace(
            F.replace(page, F.lit("<h1>"), F.lit("<h1> </h1><h2>")), F.lit("</h1><p>"), F.lit("</h2><p>")
        ),
        "card": F.replace(no_heads, F.lit("<head>"), F.lit(card)),
        "title": no_heads,
        "url": F.replace(no_heads, F.lit("title>"), F.lit("h6>")),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("variant"), v.alias("html")) for k, v in variants.items()])
    return (
        _pages(spark, sf_dir)
        .select("page_id", "url", F.explode(rows).alias("v"))
        .select(
            "page_id",
            "v.variant",
            F.expr(html.extract_title("v.html", "url")).alias("title"),
            F.expr(html.extract_title("v.html", "url", "v1")).alias("title_v1"),
        )
    )


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", F.expr(html.html_to_text("html")).alias("text"))


def text_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir).select(
        "crawl_rank",
        exact_dedup.fingerprint(F.col("content_text")).alias("fingerprint"),
        F.length("content_text").alias("n_chars"),
    )


def short_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose own text was too short, with the text of the fallback."""
    texts = with_computed(_contents(_pages(spark, sf_dir)), "text", html.html_to_text("content"))
    thin = texts.where(article_ops.is_short("text"))
    return thin.select(
        "page_id",
        F.length("text").alias("n_chars"),
        F.expr(html.html_to_text(article_ops.fallback_content("html"))).alias("fallback"),
        F.expr(article_ops.fallback_content("html", None, "v1")).alias("fallback_v1"),
    )


def extracted_short_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user extractor (heading plus URL) applied to thin pages only."""

    def heading(page_urls, page_html):
        return page_html.str.extract("(<h1>.*?</h1>)", expand=False) + "<p>" + page_urls + "</p>"

    return article_ops.page_articles(with_main(_pages(spark, sf_dir)), "v2", heading).select("page_id", "content")


def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir).drop("content_from")


def content_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_report(_articles(spark, sf_dir))


def page_articles_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _articles(spark, sf_dir, "v1").select("crawl_rank", "title", "content_text")


def unique_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(_articles(spark, sf_dir), "articles")
    return exact_dedup.deduplicate(found).drop("content_from")


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_articles(spark, sf_dir))


def unique_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    return exact_dedup.deduplicate(documents, ["source", "lang"], "doc_id", "text").select(
        "doc_id", "source", "lang", F.length("text").alias("n_chars")
    )


def unique_documents_null_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup where every third document has no language: a group like any other."""
    lang = F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("lang")
    documents = _documents(spark, sf_dir).select("doc_id", "source", lang, "text")
    return exact_dedup.deduplicate(documents, ["source", "lang"], "doc_id", "text").select(
        "doc_id", "source", "lang", F.length("text").alias("n_chars")
    )


def repeated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a crawl asks for when every page was fetched twice, first without success."""
    pages = _pages(spark, sf_dir)
    twice = pages.withColumn("status", F.lit(500)).unionByName(pages.withColumn("status", F.lit(200)))
    snapshot = one_per_page(page_snapshot(twice))
    return snapshot.select("page_id", "url", "status", F.length("html").alias("n_chars"))


def site_counts_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages per registrable domain, by a table of suffix rules made from the hosts' own endings."""
    pages = _pages(spark, sf_dir)
    ending = F.regexp_extract(F.expr(urls.url_host("url")), r"([^.]+)$", 1)
    rules = pages.select(ending.alias("rule")).distinct()
    placed = urls.with_domain(pages, "url", "domain", rules)
    return placed.groupBy("domain").agg(
        F.count("*").alias("n_pages"), F.countDistinct(F.expr(urls.url_host("url"))).alias("n_hosts")
    )


def image_in_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both image repairs on pages that also name the image inside a script and a comment."""
    quoted = """<script>var s = "<img src='p.png'>";</script><!-- <img src="q.png"> -->"""
    html_col = F.concat(F.lit(quoted), F.col("content"))
    pages = _contents(_image_pages(spark, sf_dir)).select("page_id", "url", html_col.alias("html"))
    return pages.select(
        "page_id",
        F.expr(html.fix_image_urls("html", "url")).alias("content"),
        F.expr(html.fix_image_urls("html", "url", "v1")).alias("content_v1"),
    )


def compact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select(
        "doc_id", near_dedup.compact_text(F.col("text")).alias("compact")
    )


def character_bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character counts of the compact documents, as used by the similarity bound."""
    compact = _documents(spark, sf_dir).select(
        "doc_id", near_dedup.compact_text(F.col("text")).alias("text")
    )
    return near_dedup.char_counts(compact, "doc_id")


def near_unique_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    return near_dedup.deduplicate_similar(documents, ["source", "lang"], "doc_id", "text").select(
        "doc_id", "source", "lang"
    )


def near_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents of a source and language that no lossless bound of the similarity rules out."""
    return near_dedup.near_candidates(_documents(spark, sf_dir), ["source", "lang"], "doc_id", "text")


def near_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar pairs of documents of a language, whatever their sources, with their ratio."""
    return near_dedup.near_pairs(_documents(spark, sf_dir), ["lang"], "doc_id", "text")


def near_pairs_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar pairs of documents of any source and language; MinHash may miss some."""
    return near_dedup.near_pairs_lsh(_documents(spark, sf_dir), "doc_id", "text")


def near_unique_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialize(_articles(spark, sf_dir, "v1"), "articles")
    return near_dedup.deduplicate_similar(found).select("site_id", "crawl_rank", "title")


def _label_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pages and link labels as one graph: page -> label -> every page with it.

    Going through label nodes keeps the edge count linear however many pages
    share a label.
    """
    pages = _pages(spark, sf_dir)
    page, label = F.format_string("page %d", "page_id"), F.concat(F.lit("label "), "href")
    found = pages.select("page_id", F.posexplode_outer(F.expr(html.hrefs("html"))).alias("pos", "href"))
    found = materialize(found.where(F.col("pos").isNotNull()), "labels")
    first = F.min("pos").cast("bigint").alias("pos")
    out = found.groupBy(page.alias("src"), label.alias("dst")).agg(first)
    back = found.select(
        label.alias("src"), F.col("page_id").alias("pos"), page.alias("dst")
    ).distinct()
    edges = materialize(out.unionByName(back), "edges")
    nodes = edges.select(F.col("src").alias("url"), F.lit("ok").alias("status")).distinct()
    return edges, nodes


def link_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breadth-first depth of everything that page 0 leads to."""
    edges, nodes = _label_graph(spark, sf_dir)
    start = spark.sql("SELECT 's' site_id, 'page 0' url, 'page 0' visit_key")
    return walk(edges, start, nodes).select("url", "depth")


def crawl_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl(_pages(spark, sf_dir), _page_seeds(spark, sf_dir)).select(
        "site_id", "url", "depth", "crawl_rank", "status"
    )


def _linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages under the addresses that their links name: the most linked path for the first page, and so on."""
    pages = _pages(spark, sf_dir)
    path = F.expr(urls.normalize_url("href")).alias("path")
    named = page_hrefs(pages, "page_id").select(path).groupBy("path").agg((-F.count("*")).alias("few"))
    all_ = F.lit(1).alias("all")
    names = with_positions(named.select("*", all_), ["all"], ["few", "path"], "nth").select("nth", "path")
    places = with_positions(pages.select("page_id", all_), ["all"], ["page_id"], "nth").select("nth", "page_id")
    placed = places.join(names, "nth").select("page_id", F.concat(F.lit("http://walk.org"), "path").alias("url"))
    return materialize(pages.select("page_id", "html").join(placed, "page_id"), "linked-pages")


def _deep(spark: SparkSession, sf_dir: str, max_pages: int | None) -> DataFrame:
    pages = _linked_pages(spark, sf_dir)
    first = pages.agg(F.min_by("url", "page_id").alias("seed_url"))
    visits = crawl(pages, first.select(F.lit("walk").alias("site_id"), "seed_url"), max_pages)
    return visits.select("site_id", "url", "depth", "crawl_rank", "status")


def deep_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk over pages that do link each other, to its end."""
    return _deep(spark, sf_dir, None)


def deep_crawl_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same walk, ended after its twentieth article."""
    return _deep(spark, sf_dir, WALK_LIMIT)


def visit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = crawl(_pages(spark, sf_dir), _page_seeds(spark, sf_dir))
    return crawl_report(visits)


def crawl_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first MAX_PAGES articles of every domain, in page order."""
    keys = _pages(spark, sf_dir).select(
        F.expr(urls.registrable_domain("url")).alias("site_id"), "page_id"
    )
    ranked = with_positions(keys, ["site_id"], ["page_id"], "crawl_rank")
    return ranked.where(F.col("crawl_rank") < MAX_PAGES)


def articles_by_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and progress per domain before and after exact dedup."""
    found = materialize(_articles(spark, sf_dir), "articles")
    visits = found.select("site_id", F.lit("ok").alias("status"))
    return site_summary(visits, exact_dedup.deduplicate(found))


def article_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article_index(_articles(spark, sf_dir)).select("site_id", "idx", "label")


def article_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eighth article of one domain; other domains are left before anything is parsed."""
    site = F.expr(urls.registrable_domain("url")) == "example.com"
    own = _articles(spark, sf_dir, pages=_pages(spark, sf_dir).where(site))
    found = materialize(own, "articles")
    return select_article(found, article_index(found), "example.com", 7)


def rss_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed_items(_articles(spark, sf_dir))


def rss_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per domain, as lines: in seq order they are the feed."""
    found = exact_dedup.deduplicate(_articles(spark, sf_dir))
    return feed_lines(found, _domain_seeds(spark, sf_dir))


def feed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of written feed files, read back as XML."""
    path = f"{work_dir(spark)}/feeds-{uuid.uuid4().hex}"
    write_feeds(rss_feeds(spark, sf_dir), path)
    return read_feed_items(spark, path).select("title", "link", "description")


def saved_article_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eighth article of one domain, from a bucketed table of the catalog."""
    name = f"articles_{uuid.uuid4().hex}"
    save_articles(_articles(spark, sf_dir), name)
    return lookup_article(spark, name, "example.com", 7)


def failed_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where contents come from when an extractor fails, gives nothing, blanks or a text, by page number."""

    def moody(page_urls, page_html):
        numbers = page_html.str.extract(r"track\((\d+)\)", expand=False).astype(int) % 4
        if (numbers == 0).any():
            raise ValueError("no extraction of such a page")
        return numbers.map({1: None, 2: " \n", 3: "<p>found</p>"})

    # Thin pages only: the main content is cut to a tenth of the limit.
    pages = _pages(spark, sf_dir).select(
        F.expr(urls.registrable_domain("url")).alias("site_id"),
        "url",
        "html",
        F.substring(F.col("html"), 1, 20).alias("main"),
    )
    return content_report(article_ops.page_articles(pages, "v2", moody))


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block counts per page and element kind."""
    blocks = block_table(_pages(spark, sf_dir))
    return blocks.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


def block_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_blocks(block_table(_pages(spark, sf_dir)))
    return scored.where(F.col("points").isNotNull()).select("page_id", "block_id", "tag", "points")


def main_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_spans(_pages(spark, sf_dir)).select("page_id", F.to_json("spans").alias("spans"))


def site_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job: crawl, articles by scored main content, exact dedup."""
    pages = _pages(spark, sf_dir)
    return site_feeds(pages, _page_seeds(spark, sf_dir)).articles.select(
        "site_id", "crawl_rank", "title", "url", "content", "content_text"
    )


def site_articles_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole job in the older variant: its titles, fallback and near-duplicate removal."""
    job = site_feeds(_pages(spark, sf_dir), _page_seeds(spark, sf_dir), "v1")
    return job.articles.select("site_id", "crawl_rank", "title", "url", "content", "content_text")


def entry(spark: SparkSession) -> DataFrame:
    """Unique articles of all pages."""
    return unique_articles(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        url_normalize, url_collisions, site_counts, fetch_gate, links, site_links,
        missing_targets, images, fixed_images, page_title, title_cascade, page_text,
        text_fingerprint, short_pages, extracted_short_pages, page_articles,
        page_articles_v1, content_sources, unique_articles, duplicate_groups, unique_documents,
        compact_documents, character_bags, near_unique_documents, near_unique_articles,
        near_candidates, near_pairs, near_pairs_lsh,
        link_reach, crawl_visits, deep_crawl, deep_crawl_limited, visit_report, crawl_limit, articles_by_site, article_list,
        unique_documents_null_group, repeated_pages, site_counts_by_rules, image_in_script,
        article_lookup, rss_items, rss_feeds, page_blocks, block_scores, main_content,
        feed_round_trip, saved_article_lookup, failed_extractions,
        site_articles, site_articles_v1,
    )
    found = {q.__name__: q for q in every}
    if corpus_queries:
        found |= corpus_queries.queries() | {"pipeline": corpus_pipeline.run}
    return found


# SQL equivalents ------------------------------------------------------------

_ATTRS = """(?:[^''">]|"[^"]*"|''[^'']*'')*"""
_OPAQUE = (
    r"<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)"
)
_SEPARATOR = rf"(?is){_OPAQUE}|<template\b.*?(?:</template\s*>|\z)|</?[a-z!]{_ATTRS}>|<\?[^>]*>"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160)"
_NORM = "rtrim(regexp_replace({0}, '[?#].*$', ''), '/')"
_HOST = r"regexp_extract({0}, '^https?://([^/?#:]*)', 1)"
_ROOT = r"regexp_extract({0}, '^https?://[^/?#]*')"
_DOMAIN = r"regexp_extract({0}, '^https?://(?:[^/?#:]*\.)?([^./?#:]+\.[^./?#:]+)', 1)"


def _decoded(x: str) -> str:
    for name, char in (
        ("&nbsp;", "chr(160)"), ("&copy;", "chr(169)"), ("&middot;", "chr(183)"),
        ("&quot;", "chr(34)"), ("&lt;", "'<'"), ("&gt;", "'>'"),
    ):
        x = f"replace({x}, '{name}', {char})"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def _nodes(x: str) -> str:
    trimmed = f"trim({_decoded('t')}, {_BLANKS})"
    return (
        f"list_filter(list_transform(string_split_regex({x}, '{_SEPARATOR}'), "
        f"lambda t: {trimmed}), lambda t: t <> '')"
    )


def _text(x: str) -> str:
    return f"array_to_string({_nodes(x)}, chr(10))"


def _title(page: str) -> str:
    def first(tag: str) -> str:
        inner = f"regexp_extract({page}, '(?is)<{tag}>(.*?)(?:</{tag}>|\\z)', 1)"
        return f"nullif(array_to_string({_nodes(inner)}, ''), '')"

    return (
        f"coalesce({first('h1')}, {first('h2')}, "
        f"nullif(regexp_extract({page}, '<meta content=\"([^\"]*)\" property=\"og:title\">', 1), ''), "
        f"{first('title')}, nullif(list_extract(string_split(url, '/'), -1), ''), url)"
    )


def _title_v1(page: str) -> str:
    def first(tag: str) -> str:
        inner = f"regexp_extract({page}, '(?is)<{tag}>(.*?)(?:</{tag}>|\\z)', 1)"
        return f"array_to_string({_nodes(inner)}, '')"

    return (
        f"CASE WHEN contains({page}, '<h1>') THEN {first('h1')} "
        f"ELSE coalesce(nullif({first('title')}, ''), url) END"
    )


def _escaped(x: str, quote: bool = False) -> str:
    x = f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"replace({x}, '\"', '&quot;')" if quote else x


_HREFS = (
    "links_raw AS (SELECT page_id, url, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS link_pos "
    "FROM (SELECT page_id, url, regexp_extract_all(regexp_replace(html, "
    rf"'(?is){_OPAQUE}', '', 'g'), '(?is)<a\s+href=\"([^\"]*)\"', 1) AS h FROM pages))"
)
_LINKS = (
    f"{_HREFS}, links AS (SELECT page_id, url AS src_url, link_pos, href, "
    f"{_NORM.format('(' + _ROOT.format('url') + ' || href)')} AS dst_url FROM links_raw)"
)
# Level by level: each row carries all addresses seen before its level ended.
_DEEP = (
    f"WITH RECURSIVE {_HREFS}, paths AS (SELECT page_id, link_pos, {_NORM.format('href')} AS path FROM links_raw), "
    "names AS (SELECT path, row_number() OVER (ORDER BY n DESC, path) AS nth FROM "
    "(SELECT path, count(*) AS n FROM paths GROUP BY 1)), "
    "places AS (SELECT page_id, row_number() OVER (ORDER BY page_id) AS nth FROM pages), "
    "snap AS (SELECT page_id, 'http://walk.org' || path AS url FROM places JOIN names USING (nth)), "
    "steps AS (SELECT url AS src, 'http://walk.org' || path AS dst, min(link_pos) AS pos FROM paths "
    "JOIN snap USING (page_id) WHERE url <> 'http://walk.org' || path GROUP BY 1, 2), "
    "walked(url, depth, nth, seen) AS (SELECT url, 0, CAST(0 AS BIGINT), [url] FROM "
    "(SELECT arg_min(url, page_id) AS url FROM snap) UNION ALL "
    "SELECT url, depth, row_number() OVER (ORDER BY o), list_concat(seen, list(url) OVER ()) FROM "
    "(SELECT e.dst AS url, w.depth + 1 AS depth, min({'r': w.nth, 'p': e.pos}) AS o, any_value(w.seen) AS seen "
    "FROM walked w JOIN steps e ON e.src = w.url WHERE NOT list_contains(w.seen, e.dst) GROUP BY 1, 2)), "
    "ranked AS (SELECT 'walk' AS site_id, url, depth, row_number() OVER q - 1 AS crawl_rank, status, "
    "coalesce(sum(CAST(status = 'ok' AS INTEGER)) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
    "AS ok_before FROM (SELECT walked.*, CASE WHEN snap.url IS NULL THEN 'missing' ELSE 'ok' END AS status "
    "FROM walked LEFT JOIN snap USING (url)) WINDOW q AS (ORDER BY depth, nth))"
)


def _length(nodes: str) -> str:
    return f"CAST(coalesce(list_sum(list_transform({nodes}, lambda t: length(t))), 0) AS BIGINT)"


def _main_sql(pages: str) -> str:
    """Scores of the three elements that paragraphs of this markup speak for, and the page's main content.

    By element kind, not by walking the tree: every page has one article with headings and
    paragraphs, beside one note and one menu, in a body. A paragraph ends at its end tag or the next one's start.
    """
    commas = f"coalesce(list_sum(list_transform({_nodes('x')}, lambda t: length(t) - length(replace(t, ',', '')))), 0)"
    points = f"CASE WHEN {_length(_nodes('x'))} >= 25 THEN 1 + {commas} + least({_length(_nodes('x'))} // 100, 3) ELSE 0 END"
    linked = r"list_transform(regexp_extract_all(html, '(?s)<a\s[^>]*>(.*?)</a>', 1), lambda y: " + _length(_nodes("y")) + ")"
    return (
        f"source AS ({pages}), "
        "cut AS (SELECT *, regexp_extract(html, '(?s)<article>.*?</article>') AS article, "
        r"regexp_extract(html, '(?s)<body>.*?(?:</body>|\z)') AS body, regexp_extract(html, '(?s)<html.*\z') AS root, "
        "len(regexp_extract_all(html, '<li>')) AS n_li FROM source), "
        "paragraphs AS (SELECT page_id, sum(" + points + ") AS given FROM (SELECT page_id, "
        r"regexp_extract(unnest(string_split(article, '<p>')[2:]), '(?s)^(.*?)(?:</p>|</article>|\z)', 1) AS x FROM cut) GROUP BY 1), "
        "notes AS (SELECT page_id, " + points + " AS given FROM (SELECT page_id, "
        "regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1) AS x FROM cut)), "
        f"lengths AS (SELECT page_id, {_length(_nodes('body'))} AS in_body, {_length(_nodes('html'))} AS in_page, "
        f"CAST(coalesce(list_sum({linked}), 0) AS BIGINT) AS in_links FROM cut), "
        "given AS (SELECT page_id, n_li, coalesce(p.given, 0) AS p, n.given AS n, in_body, in_page, in_links "
        "FROM cut LEFT JOIN paragraphs p USING (page_id) JOIN notes n USING (page_id) JOIN lengths USING (page_id)), "
        "scores AS (SELECT page_id, 0 AS block_id, 'html' AS tag, n / 2e0 * (1 - in_links::DOUBLE / greatest(in_page, 1)) AS points FROM given WHERE n > 0 "
        "UNION ALL SELECT page_id, 1, 'body', (n + p / 2e0) * (1 - in_links::DOUBLE / greatest(in_body, 1)) FROM given WHERE n + p > 0 "
        "UNION ALL SELECT page_id, 5 + n_li, 'article', p::DOUBLE FROM given WHERE p > 0), "
        "best AS (SELECT page_id, tag FROM scores QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY points DESC, block_id) = 1), "
        "picked AS (SELECT cut.*, CASE tag WHEN 'article' THEN article WHEN 'body' THEN body WHEN 'html' THEN root END AS block "
        "FROM cut LEFT JOIN best USING (page_id)), "
        "body AS (SELECT page_id, url, html, block, coalesce('<div>' || block || '</div>', html) AS art FROM picked)"
    )


_ART = (
    f"{_main_sql('SELECT page_id, url, html FROM pages')}, "
    f"texted AS (SELECT *, {_text('art')} AS art_text FROM body), "
    f"art AS (SELECT {_DOMAIN.format('url')} AS site_id, page_id AS crawl_rank, "
    f"{_title('html')} || ' (' || url || ')' AS title, url, "
    "CASE WHEN length(art_text) < 200 THEN html ELSE art END AS content, "
    f"CASE WHEN length(art_text) < 200 THEN {_text('html')} ELSE art_text END AS content_text "
    "FROM texted)"
)
_UNIQUE = (
    "uniq AS (SELECT * FROM art QUALIFY row_number() OVER "
    "(PARTITION BY site_id, md5(content_text) ORDER BY crawl_rank) = 1)"
)
_SEEDS = (
    f"seeds AS (SELECT {_DOMAIN.format('url')} AS site_id, arg_min(url, page_id) AS seed_url "
    "FROM pages GROUP BY 1)"
)
_ITEM = (
    f"'<item>' || chr(10) || '<title>' || {_escaped('title')} || '</title>' || chr(10) || '<link>' "
    f"|| {_escaped('url')} || '</link>' || chr(10) || '<description><![CDATA[' || "
    "replace(content, ']]>', ']]]]><![CDATA[>') || ']]></description>' || chr(10) || '</item>'"
)
_HEAD_SQL = (
    "'<?xml version=\"1.0\" encoding=\"UTF-8\"?>' || chr(10) || '<rss version=\"2.0\">' || chr(10) "
    f"|| '<channel>' || chr(10) || '<title>' || {_escaped('seed_url')} || '{feedxml.CHANNEL_TITLE_SUFFIX}"
    f"</title>' || chr(10) || '<link>' || {_escaped('seed_url')} || '</link>' || chr(10) || "
    f"'<description>{feedxml.CHANNEL_DESCRIPTION}</description>'"
)
_IMG = '<img alt="a &amp; b" data-src="/img/pic.png?w=1"></p>'
_VISITS = (
    f"{_LINKS}, seed AS (SELECT page_id, url, {_NORM.format('url')} AS key FROM pages), "
    "first_links AS (SELECT page_id, dst_url, min(link_pos) AS pos FROM links GROUP BY 1, 2), "
    "found AS (SELECT l.page_id, l.dst_url, l.pos FROM first_links l JOIN seed s USING (page_id) "
    "WHERE l.dst_url <> s.key), "
    "visits AS (SELECT CAST(page_id AS VARCHAR) AS site_id, url, 0 AS depth, 0 AS crawl_rank, "
    "'ok' AS status FROM pages UNION ALL "
    "SELECT CAST(page_id AS VARCHAR), dst_url, 1, row_number() OVER (PARTITION BY page_id ORDER BY pos), "
    "'missing' FROM found)"
)


def _near_candidates_sql() -> str:
    """All pairs of a group by brute force, with the bounds of lengths, character bags and shared grams."""
    choices = near_dedup.gram_bounds_sql("len", "rare")
    # A choice is taken if a quarter of its grams must be shared; the last one if any must.
    fit = {(k, step): f"{held} >= greatest(1, ceil((len - {k}) // {step} / 4.0 + 0.25))" for k, step, held in choices}
    fit[choices[-1][:2]] = f"{choices[-1][2]} >= 1"
    chosen = "CASE " + " ".join(f"WHEN {fit[k, step]} THEN {{'k': {k}, 'step': {step}, 'shared': {held}}}" for k, step, held in choices) + " END"
    return (
        "WITH c AS (SELECT source, lang, doc_id, replace(replace(text, chr(10), ''), ' ', '') AS txt FROM documents), "
        "t AS (SELECT *, length(txt) AS len FROM c QUALIFY row_number() OVER (PARTITION BY source, lang, txt ORDER BY doc_id) = 1), "
        "bag AS (SELECT source, lang, doc_id, ch, count(*) AS n FROM (SELECT source, lang, doc_id, unnest(string_split(txt, '')) AS ch FROM t) "
        "WHERE ch <> '' GROUP BY ALL), "
        "rare AS (SELECT source, lang, doc_id, sum(CASE WHEN n <= len // 100 + 1 THEN n ELSE 0 END) AS rare "
        "FROM bag JOIN t USING (source, lang, doc_id) GROUP BY ALL), "
        f"b AS (SELECT source, lang, doc_id, txt, len, {chosen} AS g FROM t JOIN rare USING (source, lang, doc_id)), "
        "near AS (SELECT a.source, a.lang, a.doc_id AS id_a, b.doc_id AS id_b, a.txt AS txt_a, b.txt AS txt_b, a.len + b.len AS total, b.g "
        "FROM b a JOIN b ON a.source = b.source AND a.lang = b.lang AND a.doc_id < b.doc_id "
        "AND 20 * least(a.len, b.len) > 9 * (a.len + b.len) WHERE b.g IS NOT NULL), "
        "bagged AS (SELECT near.* FROM near JOIN (SELECT x.source, x.lang, x.doc_id AS id_a, y.doc_id AS id_b, sum(least(x.n, y.n)) AS held "
        "FROM bag x JOIN bag y ON x.source = y.source AND x.lang = y.lang AND x.ch = y.ch AND x.doc_id < y.doc_id GROUP BY ALL) "
        "USING (source, lang, id_a, id_b) WHERE 20 * held > 9 * total), "
        "counted AS (SELECT source, lang, id_a, id_b, g.shared AS shared, CAST(len(list_filter(list_transform("
        "range(0, length(txt_b) - g.k + 1, g.step), lambda i: substring(txt_b, i + 1, g.k)), lambda x: contains(txt_a, x))) AS INTEGER) AS n_shared FROM bagged) "
        "SELECT source, lang, id_a, id_b, n_shared FROM counted WHERE n_shared >= shared"
    )


def oracle_sql() -> dict[str, str]:
    norm, domain, host = _NORM.format("url"), _DOMAIN.format("url"), _HOST.format("url")
    heads = "replace(html, 'h1>', 'h5>')"
    card = "<head><meta content=\"Card\" property=\"og:title\">"
    variants = {
        "second": "replace(replace(html, '<h1>', '<h1> </h1><h2>'), '</h1><p>', '</h2><p>')",
        "card": f"replace({heads}, '<head>', '{card}')",
        "title": heads,
        "url": f"replace({heads}, 'title>', 'h6>')",
    }
    cascade = " UNION ALL ".join(
        f"SELECT page_id, url, '{k}' AS variant, {v} AS html FROM pages" for k, v in variants.items()
    )
    quoted = """'<script>var s = "<img src=''p.png''>";</script><!-- <img src="q.png"> -->'"""
    image_pages = f"SELECT page_id, url, replace(html, '</p>', '{_IMG}') AS html FROM pages"
    fixed = (
        "'<img alt=\"a &amp; b\" data-src=\"/img/pic.png?w=1\" src=\"' || "
        f"{_ROOT.format('url')} || '/img/pic.png?w=1\" style=\"max-width:100%;height:auto;\"/>'"
    )
    styled = "'<img alt=\"a &amp; b\" data-src=\"/img/pic.png?w=1\" style=\"max-width:100%;height:auto;margin:5px 0;\"/>'"

    def replaced(image: str) -> str:
        """The content with its images rewritten; a whole page's head holds none but a quoted one."""
        head = "regexp_extract(art, '(?s)^.*?</head>')"
        return f"{head} || replace(substr(art, length({head}) + 1), '{_IMG.removesuffix('</p>')}', {image})"

    found = {
        "url_normalize": f"SELECT page_id, {norm} AS url_norm FROM pages",
        "url_collisions": f"SELECT {norm} AS url_norm, count(*) AS n, min(page_id) AS first_page "
        "FROM pages GROUP BY 1 HAVING count(*) > 1",
        "site_counts": f"SELECT {domain} AS domain, count(*) AS n_pages, "
        f"count(DISTINCT {host}) AS n_hosts FROM pages GROUP BY 1",
        "fetch_gate": "SELECT page_id, url FROM pages WHERE NOT contains(url, '?') "
        "AND NOT contains(url, '#')",
        "links": f"WITH {_LINKS} SELECT src_url, link_pos, href, dst_url FROM links",
        "site_links": f"WITH {_LINKS}, {_SEEDS} SELECT site_id, src_url, link_pos, dst_url "
        f"FROM links JOIN seeds ON {_DOMAIN.format('dst_url')} = site_id",
        "missing_targets": f"WITH {_LINKS} SELECT dst_url, count(*) AS n_links FROM links "
        f"WHERE dst_url NOT IN (SELECT {norm} FROM pages) GROUP BY 1",
        "images": "SELECT url, unnest(generate_series(0, n - 1)) AS img_pos, "
        f"{_ROOT.format('url')} || '/img/pic.png?w=1' AS src_abs FROM (SELECT url, "
        f"len(regexp_extract_all(regexp_replace(html, '(?is){_OPAQUE}', '', 'g'), '<img ')) AS n "
        f"FROM ({image_pages})) WHERE n > 0",
        "fixed_images": f"WITH {_main_sql(image_pages)} SELECT page_id, {replaced(fixed)} AS content FROM body",
        "page_title": f"SELECT page_id, {_title('html')} AS title, "
        f"{_title('html')} || ' (' || url || ')' AS decorated FROM pages",
        "title_cascade": f"SELECT page_id, variant, {_title('html')} AS title, "
        f"{_title_v1('html')} AS title_v1 FROM ({cascade})",
        "page_text": f"SELECT page_id, {_text('html')} AS text FROM pages",
        "text_fingerprint": f"WITH {_ART} SELECT crawl_rank, md5(content_text) AS fingerprint, "
        "length(content_text) AS n_chars FROM art",
        "short_pages": f"WITH {_ART} SELECT page_id, length(art_text) AS n_chars, "
        f"{_text('html')} AS fallback, {_text('html')} AS fallback_v1 FROM texted "
        "WHERE length(art_text) < 200",
        "extracted_short_pages": f"WITH {_ART} SELECT page_id, CASE WHEN length(art_text) < 200 THEN "
        "regexp_extract(html, '<h1>.*?</h1>') || '<p>' || url || '</p>' ELSE art END AS content "
        "FROM texted",
        "page_articles": f"WITH {_ART} SELECT * FROM art",
        "page_articles_v1": f"WITH {_ART} SELECT page_id AS crawl_rank, {_title_v1('html')} AS title, "
        f"CASE WHEN length(art_text) < 200 THEN {_text(_text('html'))} ELSE art_text END "
        "AS content_text FROM texted",
        "content_sources": f"WITH {_ART} SELECT site_id, CASE WHEN length(art_text) < 200 THEN 'page' "
        "ELSE 'main' END AS content_from, count(*) AS n FROM texted JOIN art ON page_id = crawl_rank "
        "GROUP BY 1, 2",
        "unique_articles": f"WITH {_ART}, {_UNIQUE} SELECT * FROM uniq",
        "duplicate_groups": f"WITH {_ART} SELECT site_id, md5(content_text) AS fingerprint, "
        "count(*) AS n, min(crawl_rank) AS first FROM art GROUP BY 1, 2 HAVING count(*) > 1",
        "unique_documents": "SELECT doc_id, source, lang, length(text) AS n_chars FROM documents "
        "QUALIFY row_number() OVER (PARTITION BY source, lang, md5(text) ORDER BY doc_id) = 1",
        "compact_documents": "SELECT doc_id, replace(replace(text, chr(10), ''), ' ', '') AS compact "
        "FROM documents",
        "character_bags": "SELECT doc_id, ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split("
        "replace(replace(text, chr(10), ''), ' ', ''), '')) AS ch FROM documents) "
        "WHERE ch <> '' GROUP BY 1, 2",
        "near_candidates": _near_candidates_sql(),
        # A row enters once: the recursion ends when no new node is reached.
        "link_reach": f"WITH RECURSIVE {_HREFS}, hops AS (SELECT 'page ' || page_id AS src, "
        "'label ' || href AS dst FROM links_raw UNION SELECT 'label ' || href, 'page ' || page_id "
        "FROM links_raw), reach(url, depth) USING KEY (url) AS (SELECT 'page 0', 0 UNION "
        "SELECT h.dst, min(r.depth) + 1 FROM reach r JOIN hops h ON h.src = r.url "
        "WHERE NOT EXISTS (SELECT 1 FROM recurring.reach o WHERE o.url = h.dst) GROUP BY h.dst) "
        "SELECT url, depth FROM reach",
        "deep_crawl": f"{_DEEP} SELECT site_id, url, depth, crawl_rank, status FROM ranked",
        "deep_crawl_limited": f"{_DEEP} SELECT site_id, url, depth, crawl_rank, status FROM ranked "
        f"WHERE ok_before < {WALK_LIMIT}",
        "crawl_visits": f"WITH {_VISITS} SELECT site_id, url, depth, crawl_rank, status FROM visits",
        "visit_report": f"WITH {_VISITS} SELECT site_id, depth, status, count(*) AS n FROM visits "
        "GROUP BY 1, 2, 3",
        "crawl_limit": f"SELECT {domain} AS site_id, page_id, row_number() OVER (PARTITION BY {domain} "
        f"ORDER BY page_id) - 1 AS crawl_rank FROM pages QUALIFY crawl_rank < {MAX_PAGES}",
        "articles_by_site": f"WITH {_ART}, {_UNIQUE} SELECT a.site_id, n AS n_visited, n AS n_articles, "
        "CAST(0 AS BIGINT) AS n_failed, least(n / 500.0::DOUBLE * 100, 100.0) AS progress, n_unique, "
        "n - n_unique AS n_duplicates FROM (SELECT site_id, count(*) AS n FROM art GROUP BY 1) a "
        "JOIN (SELECT site_id, count(*) AS n_unique FROM uniq GROUP BY 1) u USING (site_id)",
        "article_list": f"WITH {_ART} SELECT site_id, row_number() OVER (PARTITION BY site_id "
        f"ORDER BY crawl_rank) - 1 AS idx, {_escaped('title', True)} AS label FROM art",
        "article_lookup": f"WITH {_ART} SELECT content FROM (SELECT *, row_number() OVER (PARTITION BY "
        "site_id ORDER BY crawl_rank) - 1 AS idx FROM art) WHERE site_id = 'example.com' AND idx = 7",
        "rss_items": f"WITH {_ART} SELECT site_id, crawl_rank, {_ITEM} AS item FROM art",
        "rss_feeds": f"WITH {_ART}, {_UNIQUE}, {_SEEDS} SELECT site_id, CAST(-4611686018427387904 AS BIGINT) "
        f"AS seq, {_HEAD_SQL} AS xml FROM seeds UNION ALL SELECT site_id, CAST(crawl_rank AS BIGINT), {_ITEM} "
        "FROM uniq UNION ALL SELECT site_id, CAST(4611686018427387904 AS BIGINT), "
        "'</channel>' || chr(10) || '</rss>' FROM seeds",
        "feed_round_trip": f"WITH {_ART}, {_UNIQUE} SELECT title, url AS link, content AS description FROM uniq",
        "saved_article_lookup": f"WITH {_ART} SELECT content FROM (SELECT *, row_number() OVER (PARTITION BY "
        "site_id ORDER BY crawl_rank) - 1 AS idx FROM art) WHERE site_id = 'example.com' AND idx = 7",
        "failed_extractions": f"SELECT {domain} AS site_id, CASE CAST(regexp_extract(html, 'track\\((\\d+)\\)', 1) AS INTEGER) % 4 "
        "WHEN 0 THEN 'failed' WHEN 1 THEN 'none' WHEN 2 THEN 'blank' ELSE 'extractor' END AS content_from, "
        "count(*) AS n FROM pages GROUP BY 1, 2",
        "unique_documents_null_group": "SELECT doc_id, source, lang, length(text) AS n_chars FROM (SELECT doc_id, "
        "source, text, CASE WHEN doc_id % 3 <> 0 THEN lang END AS lang FROM documents) "
        "QUALIFY row_number() OVER (PARTITION BY source, lang, md5(text) ORDER BY doc_id) = 1",
        "repeated_pages": "SELECT page_id, url, CAST(200 AS INTEGER) AS status, length(html) AS n_chars FROM pages",
        "site_counts_by_rules": f"SELECT {domain} AS domain, count(*) AS n_pages, "
        f"count(DISTINCT {host}) AS n_hosts FROM pages GROUP BY 1",
        "image_in_script": f"WITH {_main_sql(image_pages)} SELECT page_id, {quoted} || {replaced(fixed)} AS content, "
        f"{quoted} || {replaced(styled)} AS content_v1 FROM body",
        "block_scores": f"WITH {_main_sql('SELECT page_id, url, html FROM pages')} SELECT page_id, block_id, tag, points FROM scores",
        "main_content": f"WITH {_main_sql('SELECT page_id, url, html FROM pages')} SELECT page_id, '[{{\"start\":' || (strpos(html, block) - 1) || "
        "',\"length\":' || length(block) || '}]' AS spans FROM body WHERE block IS NOT NULL",
        "site_articles_v1": f"WITH {_ART} SELECT CAST(page_id AS VARCHAR) AS site_id, 0 AS crawl_rank, {_title_v1('html')} AS title, url, "
        f"CASE WHEN length(art_text) < 200 THEN {_text('html')} ELSE art END AS content, "
        f"CASE WHEN length(art_text) < 200 THEN {_text(_text('html'))} ELSE art_text END AS content_text FROM texted",
        # No link of these pages leads to another page, so every site has its seed's article only.
        "site_articles": f"WITH {_ART} SELECT CAST(crawl_rank AS VARCHAR) AS site_id, 0 AS crawl_rank, title, url, content, content_text FROM art",
        "page_blocks": "SELECT page_id, lower(tag) AS tag, count(*) AS n FROM (SELECT page_id, "
        f"unnest(regexp_extract_all(regexp_replace(html, '(?is){_OPAQUE}', '', 'g'), "
        "'(?i)<(html|body|article|footer|nav|div|p|ul|li|h1)(?:>|\\s)', 1)) AS tag FROM pages) "
        "GROUP BY 1, 2",
    }
    if corpus_queries:
        found |= corpus_queries.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
