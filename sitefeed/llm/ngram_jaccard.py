"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

A text's n-grams are its runs of five consecutive words (letters, digits and
non-ASCII, lower-cased in A-Z); a text of fewer words is one n-gram. Documents
with equal n-gram sets form a class and are compared once. ``BANDS`` bands of
``ROWS`` MinHash values are shuffled on their hashes. At a similarity of 0.8 a
pair shares a band with probability 1 - (1 - 0.8^5)^26 = 0.99997.

Classes that share bands, directly or through others, form a candidate block.
A block is cut into tiles of ``TILE`` classes and every pair of tiles is one
task's work on full n-gram sets. So a block of any size is compared in parallel
without a row per pair: a task returns a number per class, and one link per
class to the least one it reaches.

Texts without words link with nothing. Rows without doc_id are left alone: no
class, no links. Rows of equal doc_id and equal n-grams count as copies; equal
doc_ids with different texts share their class. Hashes of n-grams and of n-gram
sets have 64 bits. Texts of any length give all their n-grams; further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefeed.llm.common import per_batch
from sitefeed.llm.graph import components
from sitefeed.llm.words import PUNCTUATION, Texts, U, mix, slices, split, window_hashes, word_hashes
from sitefeed.runtime import materialize

N, THRESHOLD = 5, 0.8
BANDS, ROWS = 26, 5
TILE = 512
#: n-grams of a tile compared at a time.
COLUMNS = 4096
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | U(1)


def ngram_sets(texts: Texts, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes, ascending within each text, and where each text's begin."""
    words = split(texts, PUNCTUATION)
    hashes, first = word_hashes(texts, words), words.first
    count = np.diff(first)
    grams, owner = [], []
    if len(hashes) >= n:
        inside = np.flatnonzero(np.arange(len(hashes) - n + 1) + n <= np.repeat(first[1:], count)[: len(hashes) - n + 1])
        grams.append(window_hashes(hashes, n)[inside])
        owner.append(words.text[inside])
    for size in range(1, n):
        short = np.flatnonzero(count == size)
        if len(short):
            grams.append(window_hashes(hashes, size)[first[short]])
            owner.append(short)
    gram = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
    text = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    order = np.lexsort((gram, text))
    gram, text = gram[order], text[order]
    new = np.append(True, (gram[1:] != gram[:-1]) | (text[1:] != text[:-1]))[: len(gram)]
    gram, text = gram[new], text[new]
    return gram, np.searchsorted(text, np.arange(len(texts) + 1))


def set_hash(grams: np.ndarray) -> int:
    return int.from_bytes(hashlib.md5(grams.tobytes()).digest()[:8], "little", signed=True)


def band_keys(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One key for each band of each non-empty set; band numbers are part of the keys."""
    keys = np.zeros((len(first), BANDS), np.uint64)
    for i, seed in enumerate(_SEEDS):
        lowest = np.minimum.reduceat((grams ^ (seed >> U(7))) * seed, first)
        band = i // ROWS
        keys[:, band] = mix(keys[:, band] * U(0x9E3779B97F4A7C15) + lowest + U(band))
    return keys.view(np.int64)


def signatures(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, node (hash of the n-gram set), one key per band; null without words."""

    def work(batch: pa.RecordBatch):
        for texts in slices(batch.column(1), lower=True):
            grams, first = ngram_sets(texts)
            empty = np.diff(first) == 0
            full = np.flatnonzero(~empty)
            nodes, keys = np.zeros(len(texts), np.int64), np.zeros((len(texts), BANDS), np.int64)
            if len(full):
                nodes[full] = [set_hash(grams[first[i] : first[i + 1]]) for i in full]
                keys[full] = band_keys(grams, first[full])
            columns = [pa.array(c, pa.int64(), mask=empty) for c in (nodes, *keys.T)]
            yield pa.table([batch.column(0).slice(texts.row, len(texts)), *columns], names=names)

    names = ["doc_id", "node", *(f"k{i}" for i in range(BANDS))]
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return per_batch(rows, ", ".join(f"{n} bigint" for n in names), work)


def candidate_blocks(classes: DataFrame) -> DataFrame:
    """(rep, block): classes that may be similar to another class of their block."""
    keys = F.array(*[F.col(f"k{i}") for i in range(BANDS)])
    members = classes.select("rep", F.explode(keys).alias("key"))
    shared = members.groupBy("key").agg(F.min("rep").alias("low"), F.count("*").alias("n")).where("n > 1")
    links = members.join(shared, "key").select(F.col("rep").alias("a"), F.col("low").alias("b"))
    return components(links).select(F.col("node").alias("rep"), F.col("component").alias("block"))


def similar(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Matrix: whether the Jaccard similarity of set i of a and set j of b reaches the threshold."""
    sizes = [np.array([len(x) for x in side]) for side in (a, b)]
    flat = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(len(a) + len(b)), np.concatenate(sizes))
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    start = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])[: len(flat)])
    number = np.diff(np.append(start, len(flat)))
    common = np.repeat(number > 1, number)
    column = np.repeat(np.cumsum(number > 1) - 1, number)[common]
    owner = owner[common]
    both = np.zeros((len(a), len(b)), np.float32)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [begin, begin + COLUMNS]))
        block = np.zeros((len(a) + len(b), COLUMNS), np.float32)
        block[owner[part], column[part] - begin] = 1
        both += block[: len(a)] @ block[len(a) :].T
    union = sizes[0][:, None] + sizes[1][None, :] - both
    return both >= threshold * union - 1e-6


def least_reached(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For every row of a symmetric link matrix the least id reachable from it."""
    low = ids.copy()
    while True:
        step = np.where(linked, low[None, :], low[:, None]).min(axis=1)
        if (step == low).all():
            return low
        low = step


def verified(tiles: DataFrame, threshold: float) -> DataFrame:
    """Per tile pair and class: rep, number of linked documents, least class reached."""

    def compare(table: pa.Table) -> pa.Table:
        # Repeated rows of a class count through its copies.
        keys = ["block", "low", "high", "side", "rep", "node", "copies"]
        table = table.group_by(keys).aggregate([("grams", "min")]).rename_columns([*keys, "grams"])
        table = table.sort_by([("side", "ascending"), ("rep", "ascending")])
        side, rep = table["side"].to_numpy(), table["rep"].to_numpy()
        copies = table["copies"].to_numpy().astype(np.int64)
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table["grams"]]
        own = table["low"][0].as_py() == table["high"][0].as_py()
        cut = 0 if own else int(np.searchsorted(side, 1))
        # One tile against itself, or the first tile against the second.
        left, right = (slice(0, None), slice(0, None)) if own else (slice(0, cut), slice(cut, None))
        a, b = sets[left], sets[right]
        found = similar(a, b, threshold) if a and b else np.zeros((len(a), len(b)), bool)
        linked = np.zeros((len(rep), len(rep)), bool)
        linked[left, right] = found
        linked |= linked.T
        np.fill_diagonal(linked, False)
        weight = linked @ copies
        return pa.table({"rep": rep, "links": weight, "low": least_reached(linked, rep)})

    return tiles.groupBy("block", "low", "high").applyInArrow(compare, "rep bigint, links bigint, low bigint")


def _tiles(documents: DataFrame, classes: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row per class and tile pair that it takes part in, with its n-gram set."""
    size = blocks.groupBy("block").agg(F.ceil(F.count("*") / TILE).cast("int").alias("n_tiles"))
    members = blocks.join(size, "block").join(classes.select("rep", "node", "copies"), "rep")
    members = members.withColumn("tile", F.pmod(F.xxhash64("node", F.lit(11)), F.col("n_tiles")).cast("int"))
    # Candidates grow with the corpus, so the plan is the same at every size: a merge join.
    texts = documents.select(F.col("doc_id").cast("bigint").alias("rep"), "text").join(
        materialize(members, "members").hint("merge"), "rep"
    )

    def work(batch: pa.RecordBatch):
        for texts in slices(batch.column(0), lower=True):
            grams, first = ngram_sets(texts)
            sets = [grams[first[i] : first[i + 1]] for i in range(len(texts))]
            rest = batch.slice(texts.row, len(texts))
            node = rest.column(3).to_pylist()
            held = [len(s) > 0 and set_hash(s) == x for s, x in zip(sets, node, strict=True)]
            kept = pa.RecordBatch.from_arrays(
                [*rest.columns[1:], pa.array([s.tobytes() for s in sets], pa.binary())],
                ["rep", "block", "node", "copies", "tile", "n_tiles", "grams"],
            )
            yield kept.filter(pa.array(held))

    kinds = "rep bigint, block bigint, node bigint, copies bigint, tile int, n_tiles int, grams binary"
    sets = per_batch(texts, kinds, work, "text", "rep", "block", "node", "copies", "tile", "n_tiles")
    other = F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)).alias("other")
    pairs = sets.select("*", other).select(
        "block",
        F.least("tile", "other").alias("low"),
        F.greatest("tile", "other").alias("high"),
        (F.col("tile") > F.col("other")).cast("int").alias("side"),
        "rep", "node", "copies", "grams",
    )
    return pairs


def jaccard_join(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, n_links (other rows linked directly), class_id, kept.

    ``class_id`` is the least doc_id that links lead to, the row's own included.
    """
    rows = materialize(signatures(documents), "signatures")
    classes = materialize(
        rows.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("node")
        .agg(
            F.min("doc_id").alias("rep"),
            F.count("*").alias("copies"),
            *[F.first(f"k{i}").alias(f"k{i}") for i in range(BANDS)],
        ),
        "classes",
    )
    blocks = materialize(candidate_blocks(classes), "blocks")
    found = materialize(verified(_tiles(documents, classes, blocks), threshold), "verified")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("rep").alias("a"), F.col("low").alias("b")))
    of_class = (
        classes.select("node", "rep", "copies")
        .join(links, "rep", "left")
        .join(reached.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "node",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
            F.coalesce("component", "rep").alias("class_id"),
        )
    )
    placed = rows.select("doc_id", "node").join(of_class, "node", "left")
    known = F.col("doc_id").isNotNull()
    return placed.select(
        "doc_id",
        F.when(known, F.coalesce("links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"),
        F.when(known, F.coalesce("class_id", "doc_id")).alias("class_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def keep_one_of_each(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with the least doc_id of their class, all columns kept.

    Rows that repeat a kept doc_id and its text count as one document: of them the one stays
    whose columns have the least digest. Rows without doc_id stay.
    """
    joined = jaccard_join(documents.select("doc_id", "text"), threshold)
    kept = joined.where("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("kept_id")).agg(F.count("*").alias("n"))
    # The whole row is one column here, so its names may be any.
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    named = documents.select(row.alias("row")).join(materialize(kept, "kept"), F.col("row.doc_id") == F.col("kept_id"))
    single = named.where("n = 1").select("row")
    digest = F.md5(F.to_json("row"))
    repeated = named.where("n > 1").groupBy("kept_id", F.col("row.text").alias("of_text")).agg(F.min_by("row", digest).alias("row"))
    nameless = documents.where(F.col("doc_id").isNull()).select(row.alias("row"))
    return single.unionByName(repeated.select("row")).unionByName(nameless).select("row.*")


#: Brute force: all pairs that share an n-gram, then the closure of the links.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
g AS (SELECT DISTINCT doc_id, list_slice(w, p, p + 4) gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM g GROUP BY doc_id),
common AS (SELECT x.doc_id a, y.doc_id b, count(*) c FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 10 * c >= 8 * (na.n + nb.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT doc_id, (SELECT count(*) FROM link WHERE link.a = doc_id) n_links, c.class_id, doc_id = c.class_id kept
FROM d JOIN (SELECT a, min(b) class_id FROM reach GROUP BY a) c ON c.a = doc_id
"""
