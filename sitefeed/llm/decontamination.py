"""Benchmark decontamination over a positional inverted index, DataFrame operations only.

Words are lower-cased in A-Z and consist of letters, digits and non-ASCII
characters. Benchmark items are cut into windows of ``WINDOW`` words (a shorter
item is one window). The index stores the postings (text, position) of every
corpus word that some window uses. For each window the lists of its two rarest
words are intersected, shifted by their offsets; the window's other words are
then compared in the text itself, so matches are exact. ``gap`` > 0 also
returns proximity matches: the window's words in order with up to ``gap`` extra
words before the second rarest one.

Texts are identified by a 64-bit hash; a chance equality of two only costs look-ups, for
the words of each text decide. Copies of a text have one place of each window between
them: places are made distinct before lists are intersected and again after. Rows
with equal, missing or repeated doc_id keep apart. Null or empty texts have no
words, very long texts are read whole. Items without an id or without words hold no window; repeated items
count once. Extra columns of either table are ignored. An empty benchmark gives
zero hits for every document, an empty table of documents no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitefeed.llm.common import word_count, words_of
from sitefeed.runtime import materialize

WINDOW = 10


def item_windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """One row per distinct window: its words and the ids of the items that hold it."""
    words = (
        items.where(F.col("item_id").isNotNull())
        .select(F.col("item_id").cast("string").alias("item_id"), words_of("text").alias("words"))
        .where(F.size("words") > 0)
    )
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    cut = words.select("item_id", "words", F.explode(starts).alias("at")).select(
        "item_id", F.slice("words", F.col("at"), F.lit(width)).alias("words")
    )
    return (
        cut.groupBy("words")
        .agg(F.collect_set("item_id").alias("items"))
        .withColumn("win", F.xxhash64("words"))
    )


def window_terms(windows: DataFrame) -> DataFrame:
    return windows.select("win", F.posexplode("words").alias("off", "term"))


def text_key(text: str = "text") -> Column:
    return F.xxhash64(text)


def build_index(documents: DataFrame, windows: DataFrame) -> DataFrame:
    """Postings (text key, position, word) of every word that a window uses."""
    vocabulary = materialize(window_terms(windows).select("term").distinct(), "vocabulary")
    # The key is made before words are dealt out as rows, not once for each of them.
    texts = documents.where(F.col("text").isNotNull()).select(text_key().alias("key"), words_of("text").alias("words"))
    tokens = texts.select("key", F.posexplode("words").alias("pos", "term"))
    return materialize(tokens.join(vocabulary, "term"), "postings")


def candidates(index: DataFrame, windows: DataFrame, gap: int = 0) -> DataFrame:
    """Places where the two rarest words of a window stand at the right distance.

    ``start`` is where the window would begin. Windows of one word have one list.
    """
    frequency = index.groupBy("term").agg(F.count("*").alias("n"))
    terms = window_terms(windows).join(frequency, "term")
    total = F.count("*").over(Window.partitionBy("win"))
    rarest = F.row_number().over(Window.partitionBy("win").orderBy("n", "term", "off"))
    ranked = terms.select("win", "term", "off", total.alias("present"), rarest.alias("rank"))
    whole = windows.select("win", F.size("words").alias("size"))
    # A window with a word that the corpus lacks cannot occur.
    ranked = ranked.join(whole, "win").where((F.col("present") == F.col("size")) & (F.col("rank") <= 2))
    ranked = materialize(ranked.drop("present"), "rarest")

    def places(rank: int) -> DataFrame:
        found = index.join(ranked.where(F.col("rank") == rank), "term")
        start = (F.col("pos") - F.col("off")).alias("start")
        return found.select("key", "win", "size", start).where(F.col("start") >= 0)

    single = places(1).where(F.col("size") == 1)
    # Copies of a text, a third of all rows maybe, are put together where they are read.
    second = places(2).select("key", "win", "start").distinct()
    if gap:
        second = second.select("key", "win", F.explode(F.sequence(F.col("start") - gap, F.col("start") + gap)).alias("start"))
    first = places(1).where(F.col("size") > 1).select("key", "win", "start").distinct()
    pairs = first.join(second.distinct() if gap else second, ["key", "win", "start"])
    return single.select("key", "win", "start").distinct().unionByName(pairs)


def phrase_matches(documents: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Documents with ``n_words`` and ``matches``: exact window places with their items."""
    windows = materialize(item_windows(items, width), "windows")
    index = build_index(documents, windows)
    found = candidates(index, windows).join(windows, "win")
    place = F.struct(F.col("start"), F.col("words").alias("phrase"), F.col("items"))
    by_text = found.groupBy("key").agg(F.collect_list(place).alias("places"))
    nothing = F.array().cast(by_text.schema["places"].dataType)
    texts = documents.select("doc_id", text_key().alias("key"), "text")
    # Words are cut again only where there is a place to look at; elsewhere they are counted.
    # The generator keeps the words of a text from being cut again for each of its places.
    words = F.explode_outer(F.array(F.when(F.col("places").isNotNull(), words_of("text")))).alias("words")
    checked = texts.join(by_text, "key", "left").select("doc_id", "text", "places", words)
    exact = F.filter("places", lambda p: F.slice("words", p.start + 1, F.size(p.phrase)) == p.phrase)
    return checked.select("doc_id", "text", word_count("text").alias("n_words"), F.coalesce(exact, nothing).alias("matches"))


def proximity_matches(documents: DataFrame, items: DataFrame, gap: int, width: int = WINDOW) -> DataFrame:
    """(doc_id, win, start, words): windows whose words follow each other in order, with up to ``gap`` others between.

    ``start`` is the place of the first word. Repeated words need as many occurrences.
    """
    windows = materialize(item_windows(items, width), "windows")
    index = build_index(documents, windows)
    # The two rarest words are at most ``gap`` further apart than in the window, wherever it starts.
    near = candidates(index, windows, gap).join(windows, "win")
    texts = documents.select("doc_id", text_key().alias("key"), words_of("text").alias("tokens"))

    def followed(first: Column) -> Column:
        """Last place that a walk over the window's words from ``first`` on comes to, each at its next occurrence (0: none)."""

        def step(at: Column, word: Column) -> Column:
            after = F.slice("tokens", at + 1, F.greatest(F.size("tokens") - at, F.lit(0)))
            offset = F.array_position(after, word).cast("int")
            return F.when((at > 0) & (offset > 0), at + offset).otherwise(0)

        return F.aggregate(F.slice("words", 2, F.size("words")), first, step)

    begins = F.sequence(F.greatest(F.col("start") - gap, F.lit(0)) + 1, F.col("start") + gap + 1)
    starts = F.filter(begins, lambda i: F.get("tokens", i - 1) == F.get("words", F.lit(0)))
    fits = F.filter(starts, lambda i: followed(i).between(i, i + F.size("words") + gap - 1))
    held = texts.join(near, "key").select("doc_id", "win", F.explode(fits).alias("at"), "words")
    return held.select("doc_id", "win", (F.col("at") - 1).alias("start"), "words").distinct()


def contamination(documents: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Per document: words, words inside a benchmark window, items that occur."""
    covered = F.array_distinct(
        F.flatten(
            F.transform("matches", lambda m: F.sequence(m.start, m.start + F.size(m.phrase) - 1))
        )
    )
    found = F.array_sort(F.array_distinct(F.flatten(F.transform("matches", lambda m: m["items"]))))
    return (
        phrase_matches(documents, items, width)
        .select("doc_id", "n_words", F.size(covered).cast("long").alias("n_hit"), found.alias("found"))
        .select(
            "doc_id",
            "n_words",
            "n_hit",
            F.size("found").cast("long").alias("n_items"),
            F.sha2(F.array_join("found", ","), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"),
        )
    )


def drop_contaminated(documents: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """The documents without any benchmark window, all columns kept; repeated rows stay repeated."""
    matches = phrase_matches(documents.select("doc_id", "text"), items, width)
    hit = matches.where(F.size("matches") > 0).select(F.md5("text").alias("hit_key")).distinct()
    row = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.md5("text").alias("text_key"))
    kept = row.join(hit, F.col("text_key") == F.col("hit_key"), "left_anti")
    return kept.select("row.*")


#: Needs views documents and benchmark. Windows by brute force, per window length.
SQL = r"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, w, least(len(w), 10) size, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) p FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, size, list_slice(w, p, p + size - 1) phrase FROM s),
sizes AS (SELECT DISTINCT size FROM win),
dw AS (SELECT rid, size, w, unnest(range(1, len(w) - size + 2)) p FROM d, sizes WHERE len(w) >= size),
hit AS (SELECT rid, p, dw.size, item_id FROM dw JOIN win ON win.size = dw.size AND win.phrase = list_slice(w, p, p + dw.size - 1)),
pos AS (SELECT rid, count(*) n FROM (SELECT DISTINCT rid, unnest(range(p, p + size)) q FROM hit) GROUP BY rid),
it AS (SELECT rid, count(*) n, string_agg(i, ',' ORDER BY i) ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) i FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, coalesce(pos.n, 0) n_hit, coalesce(it.n, 0) n_items,
  sha256(coalesce(it.ids, '')) items_sha256, coalesce(pos.n, 0) > 0 contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN it USING (rid)
"""
