"""Substring dedup by fixed-block anchors.

A passage of ``WINDOW`` words that occurs in two documents contains, wherever it
stands, one whole block of the reference grid: every document is cut into
non-overlapping blocks of ``BLOCK`` = WINDOW / 2 words, and their hashes are the
index. Every rolling window of BLOCK words of every document probes the index.
A block hit by another document is an anchor. Around anchors, matches are
extended: each window of WINDOW words that contains an anchor is compared with
all others of its kind, and runs of repeated windows make up the maximal exact
repeats. A passage shared by any number of documents costs a few bytes per
document and word, not a row per pair.

A word goes if it lies in a window whose words also begin in a document with a
smaller doc_id; windows are judged on the input. Words are separated by ASCII
blanks and compared unchanged. Anchors are found by 48-bit hashes, which only
select; windows are compared by 80 bits of two hashes.

Null or empty texts have no words. Rows without doc_id keep all words and remove
none. Repeated rows of one doc_id do not remove each other's words. Texts of any length
are worked on whole; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sitefeed.llm.blocks import QUESTION, answer, heads, in_blocks, look_up, questions, received, spread
from sitefeed.llm.common import per_batch
from sitefeed.llm.words import U, slices, split, window_hashes, windows_within, word_hashes

WINDOW, BLOCK = 50, 25
_SIGN = U(1 << 63)
#: Low bits that the anchors' hashes leave out.
_SHORT = U(16)
RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept string"


class BlockWords:
    """Word hashes of a block's documents, in slices of bounded size."""

    def __init__(self, table: pa.Table):
        self.ids = table["doc_id"].to_numpy()
        self.parts = []
        for texts in slices(table["text"]):
            words = split(texts)
            self.parts.append((texts, words, word_hashes(texts, words)))

    def windows(self, width: int, salt: int = 0):
        """Per slice: hashes of all windows, and whether each stays in its document."""
        for texts, words, hashes in self.parts:
            inside = windows_within(words.first, width, len(hashes))
            yield texts, words, window_hashes(hashes, width, salt), inside



def ask_anchors(table: pa.Table, block: int, buckets: int) -> pa.Table:
    """Distinct probes of a block, with marks: 1 on the reference grid, 2 in several documents."""
    held = BlockWords(table)
    probes, grid, owner = [], [], []
    for texts, words, windows, inside in held.windows(BLOCK):
        at = np.flatnonzero(inside)
        text = words.text[at]
        probes.append(windows[at] >> _SHORT << _SHORT)
        grid.append((at - words.first[text]) % BLOCK == 0)
        owner.append(held.ids[texts.row + text])
    probe, grid, owner = map(np.concatenate, (probes, grid, owner))
    order = np.argsort(probe, kind="stable")
    probe, grid, owner = probe[order], grid[order], owner[order]
    first = heads(probe)
    if not len(first):
        return questions(block, 0, buckets, probe, probe)
    marks = np.maximum.reduceat(grid.astype(np.uint64), first)
    several = np.minimum.reduceat(owner, first) != np.maximum.reduceat(owner, first)
    return questions(block, 0, buckets, probe[first], marks + several * U(2))


def reply_anchors(columns: list[np.ndarray]):
    """Probes that are on some document's grid and occur in two documents."""
    probe, marks = columns
    first = heads(probe)
    on_grid = np.maximum.reduceat(marks & U(1), first) > 0
    documents = np.add.reduceat(U(1) + (marks >> U(1)), first)
    return spread(on_grid & (documents > 1), first, len(probe)), []


def ask_windows(table: pa.Table, answers: pa.Table, block: int, buckets: int) -> pa.Table:
    """Distinct windows around anchors: second hash and mark of several documents, least doc_id."""
    held, (anchors,) = BlockWords(table), received(answers, 0, 1)
    keys, seconds, owner = [], [], []
    salted = held.windows(WINDOW, 1)
    whole = held.windows(WINDOW)
    for (texts, words, windows, inside), (_, _, k1, in_long), (_, _, k2, _) in zip(
        held.windows(BLOCK), whole, salted, strict=True
    ):
        hit = np.zeros(len(windows) + 1, np.int64)
        np.cumsum(inside & (look_up(anchors, windows >> _SHORT << _SHORT) >= 0), out=hit[1:])
        at = np.flatnonzero(in_long)
        at = at[hit[at + WINDOW - BLOCK + 1] > hit[at]]
        keys.append(k1[at])
        seconds.append(k2[at] >> U(48))
        owner.append(held.ids[texts.row + words.text[at]])
    key, second, owner = map(np.concatenate, (keys, seconds, owner))
    order = np.lexsort((second, key))
    key, second, owner = key[order], second[order], owner[order]
    if not len(key):
        return questions(block, 1, buckets, key, second, key)
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (second[1:] != second[:-1])))
    low, high = np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)
    marked = second[first] << U(1) | (low != high).astype(np.uint64)
    return questions(block, 1, buckets, key[first], marked, low.view(np.uint64) ^ _SIGN)


def reply_windows(columns: list[np.ndarray]):
    """Least doc_id of every window that some document of the asking block has a smaller one for."""
    key, marked, low = columns
    second = marked >> U(1)
    order = np.lexsort((second, key))
    k, s = key[order], second[order]
    first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (s[1:] != s[:-1])))
    least = np.empty_like(low)
    least[order] = spread(np.minimum.reduceat(low[order], first), first, len(key))
    return (least < low) | ((marked & U(1)) > 0), [second, least]


def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
    """doc_id, n_words, n_removed, kept of a block's documents."""
    held, (key, second, least) = BlockWords(table), received(answers, 1, 3)
    total, removed, kept = [], [], []
    for (texts, words, k1, inside), (_, _, k2, _) in zip(held.windows(WINDOW), held.windows(WINDOW, 1), strict=True):
        at = np.flatnonzero(inside)
        place = look_up(key, k1[at])
        found = place >= 0
        at, place = at[found], place[found]
        mine = (held.ids[texts.row + words.text[at]].view(np.uint64) ^ _SIGN)
        # Keys of equal first hash are neighbours; almost always there is one.
        again = np.zeros(len(at), bool)
        for step in range(int(np.diff(np.append(heads(key), len(key))).max()) if len(key) else 0):
            near = np.minimum(place + step, len(key) - 1)
            again |= (key[near] == k1[at]) & (second[near] == k2[at] >> U(48)) & (least[near] < mine)
        edge = np.zeros(len(words.start) + 1, np.int64)
        np.add.at(edge, at[again], 1)
        np.add.at(edge, at[again] + WINDOW, -1)
        gone = np.cumsum(edge[:-1]) > 0
        sums = np.append(0, np.cumsum(gone))
        removed.append(sums[words.first[1:]] - sums[words.first[:-1]])
        total.append(np.diff(words.first))
        content = texts.data.tobytes()
        for i in range(len(texts)):
            tokens = content[texts.offsets[i] : texts.offsets[i + 1]].split()
            if removed[-1][i]:
                tokens = compress(tokens, ~gone[words.first[i] : words.first[i + 1]])
            kept.append(b" ".join(tokens))
    return pa.table(
        {
            "doc_id": table["doc_id"],
            "n_words": pa.array(np.concatenate(total), pa.int64()),
            "n_removed": pa.array(np.concatenate(removed), pa.int64()),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        }
    )


def _unchanged(batch: pa.RecordBatch):
    count, kept = [], []
    for text in batch.column(0).to_pylist():
        words = (text or "").encode().split()
        count.append(len(words))
        kept.append(b" ".join(words).decode())
    ids, none = pa.nulls(len(count), pa.int64()), pa.array([0] * len(count), pa.int64())
    yield pa.table({"doc_id": ids, "n_words": pa.array(count, pa.int64()), "n_removed": none, "kept": pa.array(kept, pa.string())})


def dedup_substrings(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept (the words that stay, joined by blanks)."""
    rows = documents.selectExpr("cast(doc_id as bigint) doc_id", "text")
    blocks, buckets = in_blocks(rows.where("doc_id IS NOT NULL"), "doc_id")
    dealt = blocks.groupBy("block")

    def first(table: pa.Table) -> pa.Table:
        return ask_anchors(table, table["block"][0].as_py(), buckets)

    def second(table: pa.Table, answers: pa.Table) -> pa.Table:
        return ask_windows(table, answers, table["block"][0].as_py(), buckets) if len(table) else answers

    anchors = answer(dealt.applyInArrow(first, QUESTION), 2, reply_anchors)
    asked = dealt.cogroup(anchors.groupBy("block")).applyInArrow(second, QUESTION)
    repeats = answer(asked, 3, reply_windows)
    named = dealt.cogroup(repeats.groupBy("block")).applyInArrow(remove, RESULT)
    return named.unionByName(per_batch(rows.where("doc_id IS NULL"), RESULT, _unchanged, "text"))


#: Brute force: every window as text. Needs a view documents with distinct doc_ids.
SQL = r"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w FROM documents),
starts AS (SELECT rid, doc_id, w, unnest(range(1, len(w) - 50 + 2)) p FROM d WHERE len(w) >= 50),
windows AS (SELECT rid, doc_id, p, array_to_string(list_slice(w, p, p + 49), ' ') s FROM starts),
firsts AS (SELECT s, min(doc_id) least FROM windows GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(p, p + 50)) q FROM windows JOIN firsts USING (s) WHERE doc_id > least),
words AS (SELECT rid, unnest(w) x, generate_subscripts(w, 1) q FROM d),
kept AS (SELECT rid, string_agg(x, ' ' ORDER BY q) text, count(*) n FROM words ANTI JOIN gone USING (rid, q) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) n_removed, sha256(coalesce(kept.text, '')) kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
