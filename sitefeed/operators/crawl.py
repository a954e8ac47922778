"""Breadth-first traversal of many sites at once over a page snapshot."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefeed.functions import urls
from sitefeed.functions.urls import DEFAULT_SUFFIXES
from sitefeed.operators.links import page_hrefs, resolve_links
from sitefeed.operators.positions import with_positions
from sitefeed.runtime import BucketedRows, discard, materialize, read_together
from sitefeed.sources.pages import MISSING, OK, fetch_status, html_pages, one_per_page, page_snapshot

MAX_PAGES = 500
# Levels whose visits are looked through one by one; older ones lie in buckets.
_RECENT, _BUCKETS = 8, 64
# Queue keys are numbered anew before they could pass this.
_LARGEST_KEY = 2**62


def walk(
    edges: DataFrame,
    seeds: DataFrame,
    nodes: DataFrame,
    max_ok: int | None = None,
    max_depth: int | None = None,
) -> DataFrame:
    """Bounded breadth-first walk, one Spark job per level for all sites together.

    ``edges(src, pos, dst[, scope])``, ``seeds(site_id, url, visit_key[, scope])``
    and ``nodes(url, status, ...)``; extra node columns are carried along. Only
    nodes with status ``ok`` are expanded and count towards ``max_ok``; a node
    absent from ``nodes`` is ``missing``. With a scope column, an edge is
    followed only by sites of the same scope.

    Returns (site_id, url, depth, crawl_rank, status, extra node columns) where
    ``crawl_rank`` is the position in first-in-first-out visiting order. Within
    a level that order is (order of the parent, position of the link). A node's
    queue key is one integer, its parent's key times the number of link positions
    plus its own position; a level whose children's keys might not fit is numbered
    anew by range partitions. So rows have one width at any depth, and most levels
    need no sort.

    A level looks for its nodes among the visits of the last levels and, of all
    older ones, in the hash buckets that its nodes fall into only.
    """
    extra = [c for c in nodes.columns if c not in ("url", "status")]
    scoped = ["scope"] if "scope" in edges.columns else []
    status = F.coalesce("status", F.lit(MISSING)).alias("status")
    made: list[DataFrame] = []

    def kept(table: DataFrame, label: str = "walk") -> DataFrame:
        made.append(materialize(table, label))
        return made[-1]

    # Targets are looked up once, not per level. The table is not partitioned by
    # source: a join may split a hub that a tenth of all nodes leads through.
    edges = kept(
        edges.withColumnRenamed("dst", "url")
        .join(nodes, "url", "left")
        .select("src", "pos", "url", status, *scoped, *extra),
        "walk-edges",
    )
    start = seeds.join(nodes, "url", "left").select(
        "site_id",
        "url",
        "visit_key",
        F.lit(0).cast("bigint").alias("queue_key"),
        F.lit(0).alias("depth"),
        status,
        *scoped,
        *extra,
    )
    visited = _Visited(edges.sparkSession)
    try:
        levels = _levels(start, edges, kept, visited, [*scoped, *extra], scoped, max_ok, max_depth)
        visits = read_together(levels)
        ranked = with_positions(
            visits.select("site_id", "url", "depth", "queue_key", "status", *extra),
            ["site_id"], ["depth", "queue_key", "url"], "crawl_rank",
        )
    finally:
        # The positions were written, so the levels are no longer needed.
        discard(*made)
        visited.discard()
    return ranked.select("site_id", "url", "depth", "crawl_rank", "status", *extra)


class _Visited:
    """Visited (site_id, url): the last levels as they are, older ones in buckets."""

    def __init__(self, spark: SparkSession):
        self.recent: list[DataFrame] = []
        self.older = BucketedRows(spark, "visited", ["site_id", "url"], _BUCKETS)

    def add(self, level: DataFrame) -> None:
        if len(self.recent) == _RECENT:
            self.older.add(self._keys(read_together(self.recent)))
            self.recent = []
        self.recent.append(level)

    def _keys(self, levels: DataFrame) -> DataFrame:
        return levels.select("site_id", F.col("visit_key").alias("url"))

    def without(self, reached: DataFrame, kept: Callable[..., DataFrame]) -> DataFrame:
        """The rows that were not visited before."""
        fresh = reached.join(self._keys(read_together(self.recent)), ["site_id", "url"], "left_anti")
        if not self.older.present:
            return fresh
        fresh = kept(fresh, "reached")
        older = self.older.read(self.older.numbers(fresh))
        return fresh if older is None else fresh.join(older, ["site_id", "url"], "left_anti")

    def discard(self) -> None:
        if self.older.present:
            self.older.discard()


def _levels(
    start: DataFrame,
    edges: DataFrame,
    kept: Callable[..., DataFrame],
    visited: _Visited,
    carried: list[str],
    scoped: list[str],
    max_ok: int | None,
    max_depth: int | None,
) -> list[DataFrame]:
    """All levels of the walk; successes per site are running totals where there is a limit."""
    level = kept(start)
    done: list[DataFrame] = []
    totals: DataFrame | None = None
    positions = int(edges.agg(F.max("pos")).first()[0] or 0) + 1
    depth = 0
    while True:
        ok = F.count_if(F.col("status") == OK)
        if max_ok is None:
            full = False
            fresh, last = level.agg(ok, F.max("queue_key")).first()
        else:
            counted = level.groupBy("site_id").agg(
                ok.alias("n_ok"), ok.alias("n_new"), F.max("queue_key").alias("last")
            )
            if totals is not None:
                former = totals.select(
                    "site_id", "n_ok", F.lit(0).cast("bigint").alias("n_new"), F.lit(0).cast("bigint").alias("last")
                )
                both = former.unionByName(counted).groupBy("site_id")
                counted = both.agg(F.sum("n_ok").alias("n_ok"), F.sum("n_new").alias("n_new"), F.max("last").alias("last"))
            totals = kept(counted, "totals")
            peak, fresh, last = totals.agg(F.max("n_ok"), F.sum("n_new"), F.max("last")).first()
            full = peak is not None and peak >= max_ok
        if full:
            level = kept(_cut(level, totals, max_ok))
        done.append(level)
        if not fresh or (max_depth is not None and depth >= max_depth):
            return done
        visited.add(level)
        frontier = level.where(F.col("status") == OK)
        if full:
            finished = totals.where(F.col("n_ok") >= max_ok)
            frontier = frontier.join(finished, "site_id", "left_anti")
        if (last + 1) * positions > _LARGEST_KEY:
            parents = frontier.select("site_id", "url", "queue_key", *scoped)
            numbered = with_positions(parents, ["site_id"], ["queue_key", "url"], "nth")
            frontier = kept(numbered.withColumn("queue_key", F.col("nth")).drop("nth"), "numbered")
        depth += 1
        level = kept(_next_level(frontier, edges, positions, visited, kept, carried, scoped, depth))


def _next_level(
    frontier: DataFrame,
    edges: DataFrame,
    positions: int,
    visited: _Visited,
    kept: Callable[..., DataFrame],
    carried: list[str],
    scoped: list[str],
    depth: int,
) -> DataFrame:
    """Unvisited targets of the frontier, each at its first queue position."""
    parents = frontier.select("site_id", F.col("url").alias("src"), "queue_key", *scoped)
    place = F.col("queue_key") * F.lit(positions).cast("bigint") + F.col("pos")
    reached = (
        parents.join(edges, ["src", *scoped])
        .groupBy("site_id", "url", "status", *carried)
        .agg(F.min(place).alias("queue_key"))
    )
    return visited.without(reached, kept).select(
        "site_id",
        "url",
        F.col("url").alias("visit_key"),
        "queue_key",
        F.lit(depth).alias("depth"),
        "status",
        *carried,
    )


def _cut(level: DataFrame, totals: DataFrame, max_ok: int) -> DataFrame:
    """End each site right after its ``max_ok``-th success.

    Only sites that reach the limit in this level are ranked, by range partitions,
    so a site of any size and a limit of any size take many tasks.
    """
    reaching = totals.where((F.col("n_ok") >= max_ok) & (F.col("n_new") > 0)).select(
        "site_id", (F.lit(max_ok) - F.col("n_ok") + F.col("n_new")).alias("room")
    )
    ranked = with_positions(
        level.where(F.col("status") == OK)
        .join(reaching, "site_id", "left_semi")
        .select("site_id", "queue_key"),
        ["site_id"], ["queue_key"], "nth",
    )
    last = (
        ranked.join(reaching, "site_id")
        .where(F.col("nth") + 1 == F.col("room"))
        .select("site_id", F.col("queue_key").alias("last_key"))
    )
    return (
        level.join(last, "site_id", "left")
        .where(F.col("last_key").isNull() | (F.col("queue_key") <= F.col("last_key")))
        .drop("last_key")
    )


def page_requests(snapshot: DataFrame, seeds: DataFrame) -> DataFrame:
    """(url, page_id, status): which snapshot row answers a request.

    Links are requested by normalised URL: an exact row wins, else the least
    page id among the rows with that normal form. Seeds are requested as typed
    and fall back to their normal form.
    """
    key = F.expr(urls.normalize_url("url"))
    rows = snapshot.select(
        "page_id",
        "url",
        key.alias("key"),
        fetch_status(F.col("status"), F.col("content_type")).alias("status"),
    )
    answer = F.struct("page_id", "status")
    by_key = rows.groupBy("key").agg(
        F.min_by(answer, F.struct((F.col("url") != F.col("key")).alias("other"), "page_id")).alias("a")
    )
    typed = seeds.select(F.col("seed_url").alias("url")).distinct()
    exact = rows.join(typed, "url").groupBy("url").agg(F.min_by(answer, "page_id").alias("exact"))
    raw = (
        typed.withColumn("key", key)
        .where(F.col("url") != F.col("key"))
        .join(exact, "url", "left")
        .join(by_key, "key", "left")
        .select("url", F.coalesce("exact", "a").alias("a"))
        .where(F.col("a").isNotNull())
    )
    return by_key.select(F.col("key").alias("url"), "a").unionByName(raw).select("url", "a.*")


def crawl(
    pages: DataFrame,
    seeds: DataFrame,
    max_pages: int | None = MAX_PAGES,
    max_depth: int | None = None,
    suffixes: DataFrame | Sequence[str] = DEFAULT_SUFFIXES,
) -> DataFrame:
    """(site_id, url, depth, crawl_rank, status, page_id) of every visited URL.

    ``suffixes`` are public suffix rules, as a sequence or as a table of any
    length with a column ``rule``.

    Follows same-site links from each seed until no new page is found or
    ``max_pages`` pages of the site gave an article. Page bodies are scanned
    once, for their hrefs; the walk itself moves only URLs.
    """
    snapshot = one_per_page(page_snapshot(pages))
    requests = materialize(page_requests(snapshot, seeds), "requests")
    hrefs = page_hrefs(html_pages(snapshot), "page_id")
    answered = requests.where(F.col("status") == OK).select("page_id", F.col("url").alias("src_url"))
    starts = seeds.select("site_id", F.col("seed_url").alias("url")).select(
        "site_id", "url", F.expr(urls.normalize_url("url")).alias("visit_key")
    )
    starts = urls.with_domain(starts, "url", "scope", suffixes)
    links = resolve_links(hrefs.join(answered, "page_id")).where(
        F.expr(urls.is_fetchable("dst_url")) & (F.col("dst_url") != F.col("src_url"))
    )
    # A page linking the same target often (menus, footers) keeps its first link.
    edges = links.groupBy(F.col("src_url").alias("src"), F.col("dst_url").alias("dst")).agg(
        F.min("link_pos").alias("pos")
    )
    edges = urls.with_domain(edges, "dst", "scope", suffixes)
    edges = materialize(edges.join(starts.select("scope").distinct(), "scope", "left_semi"), "edges")
    try:
        return walk(edges, starts, requests, max_pages, max_depth)
    finally:
        discard(edges, requests)
