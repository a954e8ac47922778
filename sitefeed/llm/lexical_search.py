"""Ranked lexical search by NRA: sequential reads of impact-sorted lists, no random access.

Queries are taken in blocks of ``ITEMS``. For each block one pass over the documents
writes an index of the block's terms: its rows are shards, each with the lists (document, occurrences) of up
to ``POSTINGS`` occurrences and the lengths of its documents. Document frequencies and
totals are sums over all shards. A second pass reads the shards. A term adds the
same integer impact to a document whoever asks, so a shard sorts each list by impact
once. For an item it reads its lists from the top, all to the same depth, which
doubles. A document's score lies between what was read for it and that plus the
next impact of every list it was not yet met in. Reading goes on until ten documents have a
score that no other document, unread ones included, can reach or equal, and until their own scores
are known exactly; then only lists are read that such a document may still be in. The
best ten of every shard meet in one ranking per item, cut to ten before the shuffle.
A task hands the tenth best score that it knows for an item on to its next shard,
which then leaves documents that can't reach it.

Terms are told apart by 64-bit hashes. Documents without a term count
nowhere; null and empty texts have none. Very long texts are read whole. Items without an id are left out, rows
that repeat an id are one item with all their terms, items without terms find nothing. Rows that repeat a
doc_id are documents of their own; equal scores go to the lesser doc_id, a missing one comes last.
Extra columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitefeed.llm.blocks import look_up
from sitefeed.llm.common import per_batch
from sitefeed.llm.words import PUNCTUATION, U, slices, split, word_hashes
from sitefeed.runtime import materialize

#: Results per item; items per pass; term occurrences and documents per shard; depth of the first reads.
BEST, ITEMS, POSTINGS, SHARD_DOCUMENTS, DEPTH = 10, 500, 1 << 19, 1 << 15, 64

SHARD = "n_documents bigint, n_terms bigint, ids array<bigint>, lengths array<int>, term array<int>, document array<int>, tf array<int>"


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, terms: the distinct term hashes of every row."""

    def work(batch: pa.RecordBatch):
        for texts in slices(batch.column(1), lower=True):
            words = split(texts, PUNCTUATION)
            hashes = word_hashes(texts, words).view(np.int64)
            terms = [np.unique(hashes[a:b]) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            yield pa.table([batch.column(0).slice(texts.row, len(texts)), pa.array(terms, pa.list_(pa.int64()))], names=["item_id", "terms"])

    rows = items.where(F.col("item_id").isNotNull()).select("item_id", F.col("text").cast("string").alias("text"))
    return per_batch(rows, f"item_id {dict(items.dtypes)['item_id']}, terms array<bigint>", work)


class _Shard:
    """Collects documents until they fill a shard."""

    def __init__(self):
        self.n_documents = self.n_terms = self.size = self.postings = 0
        self.parts: list[tuple] = []

    def add(self, ids: pa.Array, n: np.ndarray, document: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        """Documents by place: ids, numbers of terms, and occurrences sorted by document."""
        self.n_documents += int((n > 0).sum())
        self.n_terms += int(n.sum())
        held, place = np.unique(document, return_inverse=True)
        self.parts.append((ids.take(pa.array(held)), n[held], self.size + place, term, tf))
        self.size += len(held)
        self.postings += len(term)

    def row(self) -> pa.Table:
        def one(values, kind) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))

        ids = pa.concat_arrays([p[0] for p in self.parts]) if self.parts else pa.array([], pa.int64())
        n, place, term, tf = (np.concatenate([p[k] for p in self.parts] or [np.zeros(0, np.int64)]) for k in (1, 2, 3, 4))
        order = np.argsort(term, kind="stable")
        return pa.table({
            "n_documents": [self.n_documents], "n_terms": [self.n_terms],
            "ids": one(ids, pa.int64()), "lengths": one(n, pa.int32()), "term": one(term[order], pa.int32()),
            "document": one(place[order], pa.int32()), "tf": one(tf[order], pa.int32()),
        })


def build_index(documents: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Shards of the documents; ``vocabulary``: ascending term hashes, terms are their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for texts in slices(batch.column(1), lower=True):
                words = split(texts, PUNCTUATION)
                term = look_up(vocabulary, word_hashes(texts, words))
                known = np.flatnonzero(term >= 0)
                pair, tf = np.unique(words.text[known] * len(vocabulary) + term[known], return_counts=True)
                ids = batch.column(0).slice(texts.row, len(texts))
                shard.add(ids, np.diff(words.first), pair // max(len(vocabulary), 1), pair % max(len(vocabulary), 1), tf)
                if shard.postings >= POSTINGS or shard.size >= SHARD_DOCUMENTS:
                    yield from shard.row().to_batches()
                    shard = _Shard()
        if shard.parts:
            yield from shard.row().to_batches()

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, SHARD), "search-shards")


def corpus_totals(index: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, their terms, and the document frequency of every term of the vocabulary."""

    def work(batch: pa.RecordBatch):
        df = np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        used = np.flatnonzero(df)
        yield pa.table({"term": used, "df": df[used]})

    sums = index.agg(F.sum("n_documents"), F.sum("n_terms")).first()
    counts = per_batch(index, "term bigint, df bigint", work, "term").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(n_terms, np.int64)
    df[counts["term"].to_numpy()] = counts["df"].to_numpy()
    return int(sums[0] or 0), int(sums[1] or 0), df


def weights(n: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(f) + 1))) for f in df], np.int64)


def _upper(lower: np.ndarray, lists: list, read: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """Most that each document can reach: a list it was not met in adds its next impact at most."""
    met = np.concatenate([docs[:r] for (docs, _), r in zip(lists, read, strict=True)])
    no_more = np.bincount(met, np.repeat(ahead, read).astype(float), len(lower)).astype(np.int64)
    return lower + ahead.sum() - no_more


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n_documents: int, best: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents that may be among the ``best``, ties included, with exact scores of at least ``floor``.

    ``lists``: documents and impacts, greatest impact first. Also returns how many entries were read.
    """
    lower = np.zeros(n_documents, np.int64)
    ends = np.array([len(docs) for docs, _ in lists], np.int64)
    read, wanted, depth = np.zeros_like(ends), np.ones(len(lists), bool), DEPTH
    while True:
        for t in np.flatnonzero(wanted & (read < ends)):
            docs, impacts = lists[t]
            part = slice(read[t], min(read[t] + depth, ends[t]))
            lower[docs[part]] += impacts[part]
            read[t] = part.stop
        ahead = np.array([0 if r == e else impacts[r] for (_, impacts), r, e in zip(lists, read, ends, strict=True)], np.int64)
        # A score that the result reaches for sure: no document below it belongs there.
        sure = max(floor, int(np.partition(lower, -best)[-best]) if n_documents >= best else 0)
        upper = _upper(lower, lists, read, ahead)
        open_ = np.flatnonzero(upper >= sure)
        if not ahead.any() or (upper[open_] == lower[open_]).all():
            found = open_[lower[open_] >= sure]
            return found, lower[found], int(read.sum())
        if ahead.sum() < sure:
            # No unread document can get in: a list matters only while an open document is not met in it.
            is_open = np.zeros(n_documents, bool)
            is_open[open_] = True
            wanted = np.array([is_open[docs[:r]].sum() < len(open_) for (docs, _), r in zip(lists, read, strict=True)])
        depth *= 2


def search_block(index: DataFrame, items: dict, vocabulary: np.ndarray, best: int) -> DataFrame:
    """item_id, doc_id, score: the best of every task, ties included."""
    n, total, df = corpus_totals(index, len(vocabulary))
    weight = weights(n, df)
    asked = [(item, look_up(vocabulary, terms)) for item, terms in items.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            for r in range(batch.num_rows):
                shard = {name: batch.column(name)[r].values for name in batch.schema.names if name[:2] != "n_"}
                term, place, tf = (shard[c].to_numpy().astype(np.int64) for c in ("term", "document", "tf"))
                m = 10 + (90 * shard["lengths"].to_numpy().astype(np.int64) * n) // max(total, 1)
                impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[place]))
                order = np.lexsort((-impact, term))
                place, impact = place[order], impact[order]
                cuts = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
                for item, terms in asked:
                    lists = [(place[a:b], impact[a:b]) for a, b in zip(cuts[terms], cuts[terms + 1], strict=True) if a < b]
                    if not lists:
                        continue
                    found, scores, _ = nra(lists, len(m), best, known.get(item, [1])[0])
                    top = np.sort(np.append(known.get(item, []), scores).astype(np.int64))[-best:]
                    if len(top) == best:
                        known[item] = top.tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(found), kind), shard["ids"].take(pa.array(found)), pa.array(scores, pa.int64())],
                        names=["item_id", "doc_id", "score"],
                    )

    kind = pa.string() if any(isinstance(i, str) for i in items) else pa.int64()
    schema = f"item_id {'string' if kind == pa.string() else 'bigint'}, doc_id bigint, score bigint"
    return index.select("ids", "lengths", "term", "document", "tf").mapInArrow(run, schema)


def search(documents: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: the best documents of every item."""
    asked = materialize(item_terms(items), "item-terms")
    blocks = max(1, -(-asked.count() // ITEMS))
    found: DataFrame | None = None
    for block in range(blocks):
        queries: dict = {}
        for row in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect():
            queries[row.item_id] = np.union1d(queries.get(row.item_id, np.zeros(0, np.uint64)), np.array(row.terms, np.int64).view(np.uint64))
        vocabulary = np.unique(np.concatenate([*queries.values(), np.zeros(0, U)]))
        rows = search_block(build_index(documents, vocabulary), queries, vocabulary, best)
        found = rows if found is None else found.unionByName(rows)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.select("item_id", "rank", "doc_id", "score")


#: Brute force: every item against every document. Needs views documents and benchmark.
SQL = r"""
WITH words AS (SELECT row_number() OVER () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') w FROM documents),
d AS (SELECT * FROM words WHERE len(w) > 0),
totals AS (SELECT count(*) n, CAST(sum(len(w)) AS BIGINT) l FROM d),
tf AS (SELECT rid, t, count(*) tf FROM (SELECT rid, unnest(w) t FROM d) GROUP BY ALL),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) w FROM tf, totals GROUP BY t, n),
m AS (SELECT rid, doc_id, 10 + (90 * len(w) * n) // l m FROM d, totals),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, rid, doc_id, CAST(sum(weight.w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) score
  FROM i JOIN weight USING (t) JOIN tf USING (t) JOIN m USING (rid) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) "rank", doc_id, score
FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""
