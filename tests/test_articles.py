import random

import pytest
from pyspark.sql import functions as F

from sitefeed.operators.articles import extract_articles, page_articles
from sitefeed.operators.crawl import crawl
from sitefeed.operators.main_content import block_table, cut_spans, main_spans
from tests import plain_blocks

LONG = "Some words, and more words, go here to make the paragraph long enough to count. " * 3


def body(n, char="x"):
    return f"<article><p>{char * n}</p></article>"


@pytest.mark.parametrize("mode", ["v1", "v2"])
def test_only_thin_pages_fall_back(spark, mode):
    rows = [
        (f"http://s.com/{n}{c}", f"<title>t</title><i>menu</i>{body(n, c)}", body(n, c))
        for n in (199, 200, 201) for c in "xé"
    ]
    pages = spark.createDataFrame(rows, "url string, html string, main string")
    for r in page_articles(pages, mode).collect():
        n, c = int(r.url[13:16]), r.url[16:]
        if n > 199:
            assert (r.content, r.content_text) == (body(n, c), c * n)
        elif mode == "v2":
            assert r.content == f"<title>t</title><i>menu</i>{body(n, c)}"
            assert r.content_text == f"t\nmenu\n{c * n}"
        else:
            assert r.content == r.content_text == f"t\nmenu\n{c * n}"


def test_extractor_sees_thin_pages_only(spark):
    def extract(urls, pages):
        assert all(len(p) < 300 for p in pages)
        if any("error" in u for u in urls):
            raise RuntimeError("service down")
        out = {"text": "<p>got</p>", "blank": "  ", "null": None}
        return urls.str.rsplit("/").str[-1].map(out)

    names = ["text", "blank", "null", "error", "long"]
    rows = [
        (f"http://s.com/{n}", body(900 if n == "long" else 20), body(900 if n == "long" else 20))
        for n in names
    ]
    pages = spark.createDataFrame(rows, "url string, html string, main string").coalesce(1)
    rows = page_articles(pages, "v2", extract).collect()
    sources = {r.url.rsplit("/")[-1]: r.content_from for r in rows}
    assert sources == {
        "text": "extractor", "blank": "blank", "null": "none", "error": "failed", "long": "main",
    }
    found = {r.url.rsplit("/")[-1]: r.content for r in rows}
    assert found == {
        "text": "<p>got</p>",
        "blank": body(20),
        "null": body(20),
        "error": body(20),
        "long": body(900),
    }


def test_main_block(spark):
    cases = {
        "article": (
            f"<body><nav><ul><li><a href=x>{LONG}</a></ul></nav><article><h1>H</h1><p>{LONG}<p>{LONG}"
            f"</article><footer>foot</footer></body>",
            f"<div><article><h1>H</h1><p>{LONG}<p>{LONG}</article></div>",
        ),
        "class": (
            f"<body><div class=sidebar><p>{LONG}</p><p>{LONG}</p></div>"
            f"<div id='story'><p>{LONG}</p></div></body>",
            f"<div><div id='story'><p>{LONG}</p></div></div>",
        ),
        "sibling": (
            f"<section><div class=main><p>{LONG}</p><p>{LONG}</p></div><p>{LONG}</p><p>Short end.</p>"
            f"<p>Short</p><p><a href=x>{LONG}</a></p><p></p></section>",
            f"<div><div class=main><p>{LONG}</p><p>{LONG}</p></div><p>{LONG}</p><p>Short end.</p></div>",
        ),
        "links": (
            f"<div><div><p><a href=x>{LONG}{LONG}</a></p></div><div><p>{LONG}</p></div></div>",
            f"<div><div><p>{LONG}</p></div></div>",
        ),
        "none": ("<body><b>no paragraph</b></body>", None),
        "empty": ("", None),
    }
    rows = [(k, page) for k, (page, _) in cases.items()]
    pages = spark.createDataFrame(rows, "page_id string, html string")
    found = pages.join(main_spans(pages), "page_id", "left").select(
        "page_id", cut_spans(F.col("html"), F.col("spans")).alias("main")
    )
    assert {r.page_id: r.main for r in found.collect()} == {k: m for k, (_, m) in cases.items()}


def test_blocks_nest_and_end_by_rule(spark):
    page = "<ul><li>a<li>b<p>c<div>d, e</div></ul><p><b>x<p>y <a>zz</a></p><table><tr><td>1<td>2</table>"
    pages = spark.createDataFrame([(1, page)], "page_id int, html string")
    rows = block_table(pages).orderBy("block_id").collect()
    assert [(r.tag, r.parent_id, r.text_len) for r in rows] == [
        ("body", -1, 13), ("ul", 0, 7), ("li", 1, 1), ("li", 1, 6), ("p", 3, 1), ("div", 3, 4),
        ("p", 0, 1), ("p", 0, 3), ("table", 0, 2), ("tr", 8, 2), ("td", 9, 1), ("td", 9, 1),
    ]
    assert [r.link_len for r in rows if r.tag == "p"] == [0, 0, 2]
    assert page[rows[7].start : rows[7].start + rows[7].length] == "<p>y <a>zz</a></p>"


def test_articles_of_a_crawl(spark):
    pages = spark.createDataFrame(
        [
            ("http://s.com/", f"<h1>Home</h1><a href=one>1</a><div><p>{LONG}<img src=i.png></p></div>"),
            ("http://s.com/one", "<h2>One</h2><p>thin</p>"),
        ],
        "url string, html string",
    )
    seeds = spark.createDataFrame([("s", "http://s.com/")], "site_id string, seed_url string")
    found = extract_articles(crawl(pages, seeds), pages).orderBy("crawl_rank").collect()
    assert [(r.crawl_rank, r.title, r.url) for r in found] == [
        (0, "Home (http://s.com/)", "http://s.com/"),
        (1, "One (http://s.com/one)", "http://s.com/one"),
    ]
    assert found[0].content_text == LONG.strip()
    assert 'src="http://s.com/i.png"' in found[0].content
    assert found[1].content_text == "One\nthin"


def given_points(rows):
    """Paragraph points by plain recursion over the finished block rows."""
    given = dict.fromkeys((b[0] for b in rows), 0.0)
    for b in rows:
        number, parent, grand, tag, _, n, commas, _, has_blocks = b[:9]
        if (tag in ("p", "td", "pre") or tag == "div" and not has_blocks) and n >= 25:
            points = 1 + commas + min(n // 100, 3)
            for target, share in ((parent, 1), (grand, 0.5)):
                if target >= 0:
                    given[target] += points * share
    return given


def tangled_pages():
    """Pages of random tags: nested, unclosed, unopened, with text, entities, comments and scripts between."""
    rnd = random.Random(12)
    names = "html body article section nav div p td tr table ul li dl dt dd blockquote h1 pre form b br a span".split()
    pages = ["", "plain, text. ", "<p>one<p>two", "</div></p>", "<DIV Class='a b' id=c>x</DIV>", "<!-- <div> --><script><div></script>", None]
    for _ in range(150):
        parts = []
        for _ in range(rnd.randint(1, 60)):
            name = rnd.choice(names)
            attrs = rnd.choice(["", "", "", " class=\"main comment\"", " id='foot>er'", " href=/x class=post"])
            words = " ".join(rnd.choice(["word,", "longer text", "end. ", "&amp;", "&eacute;x", "\n\t", "&nbsp;"]) for _ in range(rnd.randint(0, 12)))
            parts.append(rnd.choice([f"<{name}{attrs}>", f"<{name}{attrs}>", f"</{name}>", f"</{name.upper()} >", "<!-- c <p> -->", "<br/>"]) + words)
        pages.append("".join(parts))
    return pages


def test_blocks_equal_a_plain_walk(spark):
    pages = tangled_pages()
    pages += [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    table = spark.createDataFrame(list(enumerate(pages)), "page_id int, html string")
    got = {(r.page_id, r.block_id): tuple(r)[2:] for r in block_table(table).collect()}
    expected = {}
    for i, page in enumerate(pages):
        rows = plain_blocks.page_blocks(page or "")
        given = given_points(rows)
        expected |= {(i, b[0]): (*b[1:], given[b[0]]) for b in rows}
    assert len(expected) > 3000 and got == expected


def test_main_content_stays_in_the_jvm_and_moves_no_row(spark):
    plan = main_spans(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    # Node names only: the plan also quotes character names such as LeftArrow.
    assert not [n for n in ("Exchange hash", "Exchange range", "EvalPython", "InArrow", "InPandas", "Broadcast") if n in plan]
