import uuid
import xml.etree.ElementTree as ET

from pyspark.sql import functions as F

from sitefeed.operators.article_list import article_index, select_article
from sitefeed.operators.feeds import feed_lines
from sitefeed.plans.site_feeds import site_feeds
from sitefeed.sources.pages import look_up_pages, read_page_files, read_pages
from sitefeed.sources.sinks import (
    lookup_article,
    read_feed,
    read_feed_items,
    save_articles,
    write_articles,
    write_feeds,
    write_snapshot,
)

ARTICLES = [
    ("s", 3, 'T <&" 标题', "http://s.com/a?x=1&y=2", "<p>a ]]> b\x01</p>", "t1"),
    ("s", 7, "second `q`", "http://s.com/b", "<p>é\n😀</p>", "t2"),
    ("s", 8, "third", "http://s.com/c", "", "t3"),
]
SCHEMA = "site_id string, crawl_rank int, title string, url string, content string, content_text string"
CONTENTS = ["<p>a ]]> b</p>", "<p>é\n😀</p>", None]


def inputs(spark):
    seeds = spark.createDataFrame(
        [("s", "http://s.com/"), ("none", "http://n.org")], "site_id string, seed_url string"
    )
    return spark.createDataFrame(ARTICLES, SCHEMA), seeds


def items(document):
    channel = ET.fromstring(document.encode()).find("channel")
    return channel, [(i.findtext("title"), i.findtext("link"), i.findtext("description") or None) for i in channel.iter("item")]


def documents(lines):
    """One document per site from feed lines."""
    found = {}
    for r in lines.orderBy("site_id", "seq").collect():
        found.setdefault(r.site_id, []).append(r.xml)
    return {site: "\n".join(parts) for site, parts in found.items()}


def test_documents_are_well_formed(spark):
    articles, seeds = inputs(spark)
    feeds = documents(feed_lines(articles, seeds))
    channel, found = items(feeds["s"])
    assert channel.findtext("title") == "http://s.com/ 全站 RSS"
    assert channel.findtext("link") == "http://s.com/"
    assert channel.findtext("description") == "自动生成全站RSS"
    assert found == [(a[2], a[3], c) for a, c in zip(ARTICLES, CONTENTS)]
    assert items(feeds["none"])[1] == []
    reverse = documents(feed_lines(articles, seeds, "reverse"))
    assert items(reverse["s"])[1] == found[::-1]


def test_a_site_of_any_size_is_one_document_and_missing_parts_lose_no_item(spark):
    _, seeds = inputs(spark)
    rows = [("s", i, None if i % 2 else f"t{i}", f"http://s.com/{i}", None if i % 3 else "c", "x") for i in range(700)]
    feeds = documents(feed_lines(spark.createDataFrame(rows, SCHEMA), seeds))
    assert sorted(feeds) == ["none", "s"]
    found = items(feeds["s"])[1]
    assert [link for _, link, _ in found] == [r[3] for r in rows]
    assert found[1] == ("", "http://s.com/1", None)


def test_reading_one_feed_keeps_site_ids_apart(spark, tmp_path):
    _, seeds = inputs(spark)
    rows = [("7", 1, "a", "u", "c", "x"), ("007", 1, "b", "u", "c", "x")]
    write_feeds(feed_lines(spark.createDataFrame(rows, SCHEMA), seeds), str(tmp_path / "f"))
    for site, title in (("7", "a"), ("007", "b")):
        lines = [r.value for r in read_feed(spark, str(tmp_path / "f"), site).collect()]
        assert sum("<title>" in x for x in lines) == 1 and any(f"<title>{title}<" in x for x in lines)


def test_page_files_of_any_bytes_and_folder_names(spark, tmp_path):
    folder = tmp_path / "site(v1)+x"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.html").write_bytes("é".encode())
    (folder / "sub" / "b.html").write_bytes("é".encode("latin-1"))
    got = {r.url: r.html for r in read_page_files(spark, str(folder), "http://s.com").collect()}
    assert got == {"http://s.com/a.html": "é", "http://s.com/sub/b.html": "é"}
    strict = read_page_files(spark, str(folder), "http://s.com/", charset="utf-8").collect()
    assert {r.html for r in strict} == {"é", "\ufffd"}
    other = read_page_files(spark, str(folder), "http://s.com", charset="ISO-8859-1").collect()
    assert {r.html for r in other} == {"Ã©", "é"}



def test_files_concatenate_to_the_document(spark, tmp_path):
    articles, seeds = inputs(spark)
    path = str(tmp_path / "feeds")
    write_feeds(feed_lines(articles, seeds), path)
    for site, expected in (("s", 3), ("none", 0)):
        files = sorted((tmp_path / "feeds" / f"site_id={site}").glob("part-*"))
        document = "".join(f.read_text() for f in files)
        assert len(items(document)[1]) == expected
    assert read_feed(spark, path, "s").count() > 10
    found = [(r.title, r.link, r.description or None) for r in read_feed_items(spark, path).collect()]
    assert sorted(found, key=str) == sorted(
        [(a[2], a[3], c) for a, c in zip(ARTICLES, CONTENTS)], key=str
    )


def test_list_and_lookup(spark, tmp_path):
    articles, _ = inputs(spark)
    path = str(tmp_path / "articles")
    write_articles(articles, path)
    stored = spark.read.parquet(path)
    index = article_index(stored, "v1").cache()
    assert [(r.idx, r.label) for r in index.orderBy("idx").collect()] == [
        (0, "T &lt;&amp;&quot; 标题"), (1, "second 'q'"), (2, "third"),
    ]
    pick = lambda i: [r.content for r in select_article(stored, index, "s", i).collect()]
    assert [pick(0), pick(2), pick(3), pick(-1)] == [[ARTICLES[0][4]], [""], [], []]


def test_whole_job_from_files(spark, tmp_path):
    site = tmp_path / "site"
    (site / "sub").mkdir(parents=True)
    text = "Plenty of words, to make it long, in this one paragraph of the page. " * 4
    (site / "index.html").write_text(f"<h1>Index</h1><a href=sub/a.html>a</a><a href=b.html>b</a><div><p>{text}</p></div>")
    (site / "sub" / "a.html").write_text(f"<h1>A</h1><div><p>{text} And a little more.</p></div>")
    (site / "b.html").write_text(f"<h1>B</h1><div><p>{text}</p></div>")
    pages = read_page_files(spark, str(site), "http://s.com")
    assert pages.count() == 3
    stored = str(tmp_path / "pages.json")
    pages.write.json(stored)
    pages = read_pages(spark, stored, "json")
    seeds = spark.createDataFrame(
        [("s", "http://s.com/index.html")], "site_id string, seed_url string"
    )
    for mode, left in (("v2", 2), ("v1", 1)):
        job = site_feeds(pages, seeds, mode)
        assert job.visits.count() == 3
        assert job.articles.count() == left
        document = "\n".join(r.xml for r in job.feed.orderBy("seq").collect())
        assert len(items(document)[1]) == left
        summary = job.summary.collect()[0]
        assert (summary.n_articles, summary.n_unique) == (3, left)
        assert [(r.content_from, r.n) for r in job.contents.collect()] == [("main", 3)]


def scanned_rows(frame):
    """Rows that the scan of an executed query handed out."""
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    leaf = plan.collectLeaves().head()
    return leaf.metrics().apply("numOutputRows").value()


def test_row_groups_without_the_wanted_urls_are_not_read(spark, tmp_path):
    rows = [(f"http://s.com/{i % 4}/{i}", 200, "text/html", f"<p>{i}</p>") for i in range(2000)]
    pages = spark.createDataFrame(rows, "url string, status int, content_type string, html string")
    path = str(tmp_path / "snapshot")
    write_snapshot(pages.repartition(8, "html"), path)
    snapshot = spark.read.parquet(path)
    one = look_up_pages(snapshot, spark.createDataFrame([("http://s.com/1/5",), ("http://s.com/1/5",), (None,)], "url string"))
    assert [r.html for r in one.collect()] == ["<p>5</p>"] and scanned_rows(one) < 1000
    absent = look_up_pages(snapshot, spark.createDataFrame([("http://s.com/2/no",)], "url string"))
    assert absent.count() == 0 and scanned_rows(absent) < 1000
    some = spark.createDataFrame([(r[0],) for r in rows[:30]], "url string")
    for literals in (10, 1000):
        assert sorted(r.url for r in look_up_pages(snapshot, some, literals).collect()) == sorted(r[0] for r in rows[:30])
    assert look_up_pages(snapshot, some.where("url = ''")).count() == 0


def test_a_saved_table_is_looked_up_in_one_bucket_without_a_shuffle(spark):
    rows = [(f"site{i % 9}", i // 9 * 2, f"t{i}", f"c{i}") for i in range(900)]
    articles = spark.createDataFrame(rows, "site_id string, crawl_rank int, title string, content string")
    name = "saved_articles_" + uuid.uuid4().hex
    save_articles(articles, name, buckets=16)
    try:
        found = lookup_article(spark, name, "site3", 7)
        assert [r.content for r in found.collect()] == [f"c{7 * 9 + 3}"]
        plan = found._jdf.queryExecution().executedPlan().toString()
        # One bucket's files hold a few of the nine sites, and no others are opened.
        assert scanned_rows(found) <= 300 and "Exchange" not in plan
        assert lookup_article(spark, name, "site3", 100).count() == 0
        counts = spark.table(name).groupBy("site_id").count()
        assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_lists_and_saved_tables_parse_each_article_once(spark):
    parsed = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def rank(n):
        parsed.add(1)
        return n

    rows = spark.range(40).select(F.lit("s").alias("site_id"), rank("id").alias("crawl_rank"), F.col("id").cast("string").alias("title"))
    assert sorted((r.idx, r.label) for r in article_index(rows).collect()) == [(i, f"{i}") for i in range(40)]
    assert parsed.value == 40
    name = f"saved_{uuid.uuid4().hex}"
    save_articles(rows.withColumn("content", F.col("title")), name)
    assert parsed.value == 80
    assert [r.content for r in lookup_article(spark, name, "s", 7).collect()] == ["7"]
    spark.sql(f"DROP TABLE {name}")
