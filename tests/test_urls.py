import random
from urllib.parse import urljoin, urlparse, urlunparse

from pyspark.sql import functions as F

from sitefeed.functions import urls
from sitefeed.operators.links import in_site_links, page_links

BASES = [
    "http://a.com", "http://a.com/", "http://a.com/b/c/d?x=1#f", "http://a.com/b/c/",
    "https://u@A.com:80/b;p/c;q?y", "http://a.com/b//c/d", "", "mailto:x@y", "HTTP://A.com/x",
]
HREFS = [
    "", "#t", "?p=2", "/r", "r", "../r", "../../../r", ".", "..", "//h/q", "http://z.org/x?y#z",
    "mailto:me@x", "a//b", "http:y", "http://[bad", "http://[::1]/x", "./a/./b/../c/", "/a/../..",
    "g;x=1/../y", "g;x=1", ";x", "..;x", "?", "#", " /x y", "\tr\n", "javascript:void(0)",
    "HTTPS://Z.com/A", "http:///p", "//", "http://h?q", "/a//b/../c", "ü/é", "x:y", "1x:y",
    "a?b/../c", "tel:12;3", "//[x]/a", "x;y;z", "/;",
]
PIECES = ["a", "b", "/", "..", ".", "?", "#", ";", "//", ":", "http:", "x.com", " ", "=", "&"]


def _pairs():
    rnd = random.Random(7)
    pairs = [(b, h) for b in BASES for h in HREFS]
    for _ in range(1500):
        href = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 8)))
        pairs.append((rnd.choice(BASES), href))
    return pairs


def normal(url):
    return urlunparse(urlparse(url)._replace(query="", fragment="")).rstrip("/")


def test_resolution_equals_the_standard_rule(values):
    def expected(base, href):
        try:
            return urljoin(base, href)
        except ValueError:
            return None

    pairs = _pairs()
    assert values(urls.resolve_url("b", "h"), pairs, ["b", "h"]) == [expected(*p) for p in pairs]


def test_normal_form_equals_the_standard_rule(values):
    cases = [h for _, h in _pairs()] + BASES
    cases += ["http://", "http://a.com/x;", "HTTP://A.com//", "http://a.com/x;p=1?q#f"]
    kept, expected = [], []
    for case in cases:
        try:
            expected.append(normal(case))
            kept.append((case,))
        except ValueError:
            pass
    assert values(urls.normalize_url("u"), kept, ["u"]) == expected


def test_registrable_domain_by_expression_and_by_table(spark):
    cases = {
        "http://a.example.com/x": "example.com",
        "http://x.co.uk": "x.co.uk",
        "http://b.x.co.uk/": "x.co.uk",
        "http://localhost:80/": "localhost",
        "http://10.0.0.1/x": "10.0.0.1",
        "https://u@Host.Example.org:8/x": "example.org",
        "http://co.uk/": "co.uk",
        "http://www.ck": "www.ck",
        "http://a.www.ck": "www.ck",
        "http://b.ck": "b.ck",
        "http://a.b.c.ck": "b.c.ck",
    }
    table = spark.createDataFrame([(u,) for u in cases], "url string")
    rules = spark.createDataFrame([(s,) for s in urls.DEFAULT_SUFFIXES], "rule string")
    by_host = urls.site_domains(table, rules)
    found = (
        table.select(
            "url",
            F.expr(urls.url_host("url")).alias("host"),
            F.expr(urls.registrable_domain("url")).alias("one"),
        )
        .join(by_host, "host")
        .collect()
    )
    assert {r.url: (r.one, r.domain) for r in found} == {u: (d, d) for u, d in cases.items()}


def test_links_of_a_page(spark):
    page = (
        "<a href='/x?q=1'>x</a><!-- <a href='/no'> --><script>'<a href=\"/no\">'</script>"
        "<A title='a > b' HREF=\"sub/y#t\">y</A><a name=n>no</a><a href>self</a>"
        "<a href=http://o.org/p/>o</a><a href='http://[bad'>bad</a><a href='?a&amp;b'>q</a>"
        "<abbr href='/no'>no</abbr>"
    )
    pages = spark.createDataFrame([("http://www.s.com/d/i", page)], "url string, html string")
    links = page_links(pages)
    assert [(r.link_pos, r.href, r.dst_url) for r in links.orderBy("link_pos").collect()] == [
        (0, "/x?q=1", "http://www.s.com/x"),
        (1, "sub/y#t", "http://www.s.com/d/sub/y"),
        (2, "", "http://www.s.com/d/i"),
        (3, "http://o.org/p/", "http://o.org/p"),
        (5, "?a&b", "http://www.s.com/d/i"),
    ]
    seeds = spark.createDataFrame([("s", "https://s.com")], "site_id string, seed_url string")
    inside = in_site_links(links, seeds)
    assert sorted(r.link_pos for r in inside.collect()) == [0, 1, 2, 5]
