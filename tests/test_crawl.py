import random

import pytest
from pyspark.sql import functions as F

from sitefeed.operators import crawl as crawl_module
from sitefeed.operators.crawl import crawl, walk
from sitefeed.operators.positions import with_positions
from sitefeed.operators.report import crawl_report, site_summary
from sitefeed.runtime import BucketedRows


def normal(url):
    return url.split("#")[0].split("?")[0].rstrip("/")


def fifo(pages, seed, limit):
    """Plain queue walk; pages maps a URL to (status, type, links)."""
    by_key = {}
    for url in sorted(pages, key=lambda u: (u != normal(u), u)):
        by_key.setdefault(normal(url), pages[url])
    queue, seen, out, articles = [(seed, 0)], set(), [], 0
    while queue and (limit is None or articles < limit):
        url, depth = queue.pop(0)
        if normal(url) in seen:
            continue
        seen.add(normal(url))
        page = pages.get(url) if depth == 0 else None
        page = page or by_key.get(normal(url))
        if page is None:
            status = "missing"
        elif page[0] >= 400:
            status = "http_error"
        else:
            status = "ok" if "text/html" in (page[1] or "") else "not_html"
        out.append((url, depth, len(out), status))
        if status == "ok":
            articles += 1
            for link in page[2]:
                link = normal(link)
                if link.split("/")[2].endswith("s.com") and link not in seen:
                    queue.append((link, depth + 1))
    return out


def tables(spark, pages, seeds):
    rows = [
        (u, s, t, "".join(f'<a href="{link}">l</a>' for link in links))
        for u, (s, t, links) in pages.items()
    ]
    snapshot = spark.createDataFrame(rows, "url string, status int, content_type string, html string")
    return snapshot, spark.createDataFrame(list(seeds.items()), "site_id string, seed_url string")


def walked(visits):
    found = {}
    for r in visits.orderBy("site_id", "crawl_rank").collect():
        found.setdefault(r.site_id, []).append((r.url, r.depth, r.crawl_rank, r.status))
    return found


HTML = "text/html; charset=utf-8"
SMALL = {
    "http://s.com/?start=1": (200, HTML, ["http://s.com/a", "http://s.com/b?x", "http://s.com/a/"]),
    "http://s.com/a": (200, HTML, ["http://s.com/", "http://s.com/c", "http://off.org/z"]),
    "http://s.com/b": (301, HTML, ["http://s.com/c#t", "http://sub.s.com/d", "http://s.com/gone"]),
    "http://s.com/c": (404, HTML, ["http://s.com/never"]),
    "http://sub.s.com/d": (200, HTML, ["http://s.com/pdf", "http://s.com/e", "http://s.com/none"]),
    "http://s.com/pdf": (200, "application/pdf", ["http://s.com/never"]),
    "http://s.com/none": (200, None, ["http://s.com/never"]),
    "http://s.com/e?p=2": (200, HTML, ["http://s.com/f"]),
    "http://s.com/f": (200, HTML, []),
    "http://s.com/never": (200, HTML, []),
}


@pytest.mark.parametrize("limit", [None, 1, 3, 4])
def test_small_site(spark, limit):
    snapshot, seeds = tables(spark, SMALL, {"x": "http://s.com/?start=1", "y": "http://s.com/f"})
    expected = {
        "x": fifo(SMALL, "http://s.com/?start=1", limit),
        "y": fifo(SMALL, "http://s.com/f", limit),
    }
    visits = crawl(snapshot, seeds, limit).cache()
    assert walked(visits) == expected
    if limit is None:
        report = {(r.site_id, r.depth, r.status): r.n for r in crawl_report(visits).collect()}
        assert report[("x", 2, "http_error")] == 1 and report[("x", 2, "missing")] == 1
        unique = visits.where("status = 'ok'").limit(4)
        total = {r.site_id: r for r in site_summary(visits, unique, 6).collect()}
        assert total["x"].n_articles == 6 and total["x"].progress == 100.0
        assert sum(r.n_duplicates for r in total.values()) == 7 - 4


def test_depth_limit(spark):
    snapshot, seeds = tables(spark, SMALL, {"x": "http://s.com/?start=1"})
    expected = [v for v in fifo(SMALL, "http://s.com/?start=1", None) if v[1] <= 1]
    assert walked(crawl(snapshot, seeds, None, max_depth=1)) == {"x": expected}


def test_random_graphs(spark):
    rnd = random.Random(3)
    pages, seeds, expected = {}, {}, {}
    for g in range(25):
        host = f"http://g{g}.s.com"
        n = rnd.randint(1, 60)
        names = [f"{host}/{i}" for i in range(n)]
        for name in names:
            status = rnd.choice([200, 200, 200, 200, 302, 404])
            kind = rnd.choice([HTML] * 5 + ["image/png"])
            links = [rnd.choice(names) + rnd.choice(["", "?q", "#f", "/"]) for _ in range(rnd.randint(0, 4))]
            if rnd.random() < 0.9:
                pages[name] = (status, kind, links)
        seeds[str(g)] = names[0]
    snapshot, table = tables(spark, pages, seeds)
    for limit in (7, None):
        expected = {site: fifo(pages, seed, limit) for site, seed in seeds.items()}
        assert walked(crawl(snapshot, table, limit)) == expected


def test_positions_of_a_hot_group(spark):
    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.6 else rnd.choice("abc"), i) for i in range(5000)]
    rnd.shuffle(rows)
    table = spark.createDataFrame(rows, "g string, k int").repartition(8)
    found = with_positions(table, ["g"], ["k"], "at").collect()
    expected = {}
    for g, k in sorted(rows):
        expected.setdefault(g, []).append(k)
    assert sorted((r.g, r.at, r.k) for r in found) == sorted(
        (g, i, k) for g, ks in expected.items() for i, k in enumerate(ks)
    )


def graph(spark, links, seed="n0"):
    """Walk tables of a graph {node: [targets]}; all nodes are ok."""
    rows = [(a, i, b) for a, targets in links.items() for i, b in enumerate(targets)]
    nodes = sorted({*links, *(b for _, _, b in rows)})
    return (
        spark.createDataFrame(rows, "src string, pos int, dst string"),
        spark.createDataFrame([("s", seed, seed)], "site_id string, url string, visit_key string"),
        spark.createDataFrame([(n, "ok") for n in nodes], "url string, status string"),
    )


def plain_order(links, seed="n0"):
    queue, order, depth = [(seed, 0)], [], {}
    while queue:
        node, d = queue.pop(0)
        if node not in depth:
            depth[node] = d
            order.append(node)
            queue += [(b, d + 1) for b in links.get(node, []) if b not in depth]
    return [(n, depth[n], i) for i, n in enumerate(order)]


def in_order(visits):
    return [(r.url, r.depth, r.crawl_rank) for r in visits.orderBy("crawl_rank").collect()]


def test_queue_keys_are_numbered_anew_in_time(spark, monkeypatch):
    rnd = random.Random(21)
    links = {f"n{i}": [f"n{min(119, i + rnd.randint(1, 14))}" for _ in range(rnd.randint(1, 6))] for i in range(120)}
    monkeypatch.setattr(crawl_module, "_LARGEST_KEY", 300)
    visits = walk(*graph(spark, links))
    assert dict(visits.dtypes)["crawl_rank"] == "bigint"
    assert in_order(visits) == plain_order(links)


def test_a_deep_walk_looks_into_the_buckets_its_nodes_fall_into(spark, monkeypatch):
    """A chain with ways back; older visits are read by bucket only, and never written twice."""
    links = {f"n{i}": [f"n{max(0, i - 7)}", f"n{i + 1}", "n3"] for i in range(24)}
    monkeypatch.setattr(crawl_module, "_RECENT", 2)
    opened, added = [], []
    read, add = BucketedRows.read, BucketedRows.add
    monkeypatch.setattr(BucketedRows, "read", lambda self, wanted: opened.append(len(wanted)) or read(self, wanted))
    monkeypatch.setattr(BucketedRows, "add", lambda self, rows: added.append(rows.count()) or add(self, rows))
    assert in_order(walk(*graph(spark, links))) == plain_order(links)
    # At most three nodes a level: not more buckets, however many visits there are.
    assert len(opened) > 15 and max(opened) <= 3
    assert sum(added) <= 25


def test_limits_beyond_a_thousand_and_repeated_pages(spark):
    links = "".join(f'<a href="/p{i}">x</a>' for i in range(1500))
    rows = [("http://s.com/", 200, links)] + [(f"http://s.com/p{i}", 200, "x") for i in range(1500)]
    rows += [("http://s.com/p3", 500, "x"), ("http://s.com/p3", 200, "x")]
    pages = spark.createDataFrame(rows, "url string, status int, html string")
    seeds = spark.createDataFrame([("s", "http://s.com/")], "site_id string, seed_url string")
    got = sorted((r.crawl_rank, r.url) for r in crawl(pages, seeds, max_pages=1200).collect())
    assert got == [(0, "http://s.com/")] + [(i + 1, f"http://s.com/p{i}") for i in range(1199)]


def test_suffix_rules_as_a_table_of_any_length(spark):
    rules = spark.createDataFrame([(f"x{i}",) for i in range(700)] + [("xyz",), ("co.xyz",), ("*.ck",), ("!www.ck",)], "rule string")
    html = '<a href="http://blog.shop.xyz/">a</a><a href="http://other.xyz/">b</a>'
    pages = spark.createDataFrame([("http://www.shop.xyz", html), ("http://blog.shop.xyz", "x"), ("http://other.xyz", "y")], "url string, html string")
    seeds = spark.createDataFrame([("s", "http://www.shop.xyz")], "site_id string, seed_url string")
    got = sorted(r.url for r in crawl(pages, seeds, suffixes=rules).collect())
    assert got == ["http://blog.shop.xyz", "http://www.shop.xyz"]
