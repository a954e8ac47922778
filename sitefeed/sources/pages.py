"""Page snapshots and seeds: the inputs of a crawl.

A snapshot is a table of already fetched pages, one row per URL. Fetching is
replaced by a lookup in it, so one scan serves link extraction and articles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OK, HTTP_ERROR, NOT_HTML, MISSING = "ok", "http_error", "not_html", "missing"


def read_pages(spark: SparkSession, path: str, format: str = "parquet", **options) -> DataFrame:
    """Read a snapshot table in any Spark format and complete its columns."""
    return page_snapshot(spark.read.format(format).options(**options).load(path))


def read_page_files(
    spark: SparkSession, path: str, base_url: str, glob: str = "*.html", charset: str | None = None
) -> DataFrame:
    """Read a mirrored site: one HTML file per page, URL = ``base_url`` + relative path.

    Bytes never fail a job. Without a charset, a file that is UTF-8 is read as
    such and any other as Latin-1, the default of the protocol. With charset
    UTF-8, bad bytes become replacement characters.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    # The folder is looked for literally: its name may hold any characters.
    root = F.lit(path.rstrip("/") + "/")
    begin = F.instr("path", root) + F.length(root)
    relative = F.regexp_replace(F.substring("path", begin, F.length("path")), r"^/+", "")
    plain = F.col("content").cast("string")
    if charset is None:
        page = F.when(F.is_valid_utf8(plain), plain).otherwise(F.decode("content", "ISO-8859-1"))
    elif charset.upper().replace("-", "") == "UTF8":
        page = F.make_valid_utf8(plain)
    else:
        page = F.decode("content", charset)
    return page_snapshot(
        files.select(
            F.concat(F.lit(base_url.rstrip("/") + "/"), relative).alias("url"),
            page.alias("html"),
        )
    )


def page_snapshot(pages: DataFrame) -> DataFrame:
    """(page_id, url, status, content_type, html) from a table that has url and html.

    Missing columns mean a plain success: status 200, type ``text/html``. The
    page id defaults to the URL; it orders pages that share a normalised URL.
    """
    defaults = {
        "page_id": F.col("url"),
        "status": F.lit(200),
        "content_type": F.lit("text/html"),
    }
    have = set(pages.columns)
    columns = [
        (F.col(name) if name in have else defaults[name]).alias(name)
        for name in ("page_id", "url", "status", "content_type", "html")
    ]
    return pages.select(*columns)


def one_per_page(snapshot: DataFrame) -> DataFrame:
    """One row per page id: a page fetched again keeps one answer, a success if there is one.

    Among equal answers the one with the least digest of the body stays. Ids are
    counted first, which reads no bodies; only repeated pages are compared.
    """
    again = snapshot.groupBy("page_id").agg(F.count("*").alias("_n")).where("_n > 1").select(
        F.col("page_id").alias("_again")
    )
    if again.isEmpty():
        return snapshot
    same = F.col("page_id").eqNullSafe(F.col("_again"))
    rank = F.struct(
        (fetch_status(F.col("status"), F.col("content_type")) != OK).alias("bad"), F.md5("html").alias("digest"), "url"
    )
    row = F.struct(*snapshot.columns)
    chosen = snapshot.join(again, same, "left_semi").groupBy("page_id").agg(F.min_by(row, rank).alias("_row"))
    return snapshot.join(again, same, "left_anti").unionByName(chosen.select("_row.*"))


def is_success(status: Column) -> Column:
    return F.coalesce(status < 400, F.lit(False))


def is_html(content_type: Column) -> Column:
    """The header must contain ``text/html`` literally; no header means no page."""
    return F.coalesce(content_type, F.lit("")).contains("text/html")


def fetch_status(status: Column, content_type: Column) -> Column:
    return (
        F.when(~is_success(status), HTTP_ERROR).when(~is_html(content_type), NOT_HTML).otherwise(OK)
    )


def html_pages(snapshot: DataFrame) -> DataFrame:
    """Pages that yield an article; both gates are plain filters and reach the scan."""
    return snapshot.where(is_success(F.col("status")) & is_html(F.col("content_type")))


def look_up_pages(snapshot: DataFrame, wanted: DataFrame, literals: int = 1000) -> DataFrame:
    """Rows of a stored snapshot for the URLs of ``wanted(url)``; every URL's rows, whatever their number.

    Up to ``literals`` different URLs reach the scan as values, so that row groups whose
    Bloom filter (``write_snapshot``) has none of them are not read; more are joined.
    """
    urls = wanted.select("url").where(F.col("url").isNotNull()).distinct()
    first = [r.url for r in urls.limit(literals + 1).collect()]
    if len(first) <= literals:
        return snapshot.where(F.col("url").isin(first)) if first else snapshot.limit(0)
    return snapshot.join(urls, "url", "left_semi").select(*snapshot.columns)


def seeds(spark: SparkSession, sites: dict[str, str]) -> DataFrame:
    """(site_id, seed_url) from a small mapping; larger seed lists come as a table."""
    return spark.createDataFrame(list(sites.items()), "site_id string, seed_url string")


def spread(table: DataFrame) -> DataFrame:
    """Use all cores when a table comes in fewer splits than there are cores.

    Page parsing is CPU-bound, so a small file in one row group would occupy one
    core. Tables with enough splits, hence all large ones, stay as they are.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
