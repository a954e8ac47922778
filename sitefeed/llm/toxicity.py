"""Toxicity by class-conditional Kneser-Ney models.

Two models over the bytes of words, one of toxic and one of ordinary texts,
predict each byte from up to ``ORDER`` - 1 before it. The long histories are
counted per class; histories of fewer than ``SHARED`` bytes use continuation counts
of both classes together. Every n-gram of a class counts, also one seen once; but besides
its discount, a history of a class gives ``MASS`` counts to the shorter history, down to
the shared ones. So an expression that is rare in either class is predicted mostly by the
same distribution and tells little by its rarity; the more often a class has it, the more
it tells. An expression's evidence is the difference of the two log-likelihoods. A text is judged by the
evidence of its two strongest words, of its strongest stretch of ``STRETCH``
words per byte, of the whole text per byte, and of all words that speak for toxicity,
summed and normalised by the text's length in two ways; a logistic curve turns
these into a probability. It is fitted on the labelled texts, each judged by models that have
seen the other folds only; the final models have seen the whole sample.

Learning uses a bounded sample: at most ``PER_CLASS`` labelled rows of each class,
each of at most ``MAX_BYTES`` bytes, from rows that are not held out. Scoring
covers every word of every text. Only words enter a score.

Null, empty or wordless texts have no evidence and get the curve's value at
zero. Without labels of both classes every score is the share of label 1 (0.1
without any label). Repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefeed.llm.blocks import heads, look_up
from sitefeed.llm.common import held_out, labelled_sample, per_batch
from sitefeed.llm.words import PUNCTUATION, U, Texts, slices, split, word_hashes

ORDER, SHARED, STRETCH, CLEAR = 8, 2, 8, 8.0
#: Counts that a history of a class leaves to the shorter one besides its discount; folds of the sample.
MASS, FOLDS = 30.0, 4
#: Evidence of a word from which on it speaks for toxicity, and the most that counts of it: weakly, clearly.
WEAK, STRONG = (1.0, 4.0), (2.5, 2.0)
FEATURES = 7
PER_CLASS, MAX_BYTES = 1500, 1 << 15
#: Modulus of the crc32 split for toxicity labels.
SPLIT = 4
#: Words whose evidence a task remembers.
REMEMBERED = 1 << 20
BEGIN, END = 0x20, 0x0A


def framed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words between begin and end marks: bytes, place in the word, number of the word."""
    data = np.frombuffer(b"".join(b"\x20" + w + b"\x0a" for w in words), np.uint8)
    size = np.array([len(w) + 2 for w in words])
    owner = np.repeat(np.arange(len(words)), size)
    return data, np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size), owner


def grams(data: np.ndarray, place: np.ndarray):
    """Per order: key of the bytes that end at each predicted byte, and where that many exist."""
    key = np.zeros(len(data), np.uint64)
    for k in range(1, ORDER + 1):
        older = np.zeros(len(data), np.uint64)
        older[k - 1 :] = data[: len(data) - k + 1]
        key = key | older << U(8 * (k - 1))
        yield k, key, (place >= k - 1) & (place >= 1)


def summed(keys: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, weight = keys[order], weight[order]
    first = heads(keys)
    return keys[first], np.add.reduceat(weight, first) if len(first) else weight


class Level:
    """One order: probability of each seen n-gram, and what each history leaves to the shorter one."""

    def __init__(self, keys: np.ndarray, count: np.ndarray, lower: np.ndarray, mass: float):
        """``mass`` is added to the discounted counts that the shorter history shares out."""
        once, twice = (count == 1).sum(), (count == 2).sum()
        discount = once / (once + 2 * twice) if once else 0.5
        history = keys >> U(8)
        first = heads(history)
        total = np.add.reduceat(count, first) + mass
        at = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
        share = np.maximum(count - discount, 0) / total[at]
        self.histories, self.left = history[first], 1 - np.add.reduceat(share, first)
        self.keys, self.p = keys, share + self.left[at] * lower

    def refine(self, key: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities with this order's history, and where that history is known."""
        history = look_up(self.histories, key >> U(8))
        known = history >= 0
        p = lower.copy()
        seen = look_up(self.keys, key[known])
        backed = self.left[history[known]] * lower[known]
        p[known] = np.where(seen >= 0, self.p[np.maximum(seen, 0)] if len(self.p) else 0, backed)
        return p, known


class KneserNey:
    """Models of both classes; ``levels[k]`` holds one level if shared, else one per class."""

    def __init__(self, counts: list[Counter]):
        found = []  # per class and order: distinct keys, summed counts of those at a word's begin
        for counter in counts:
            words = sorted(counter)
            data, place, owner = framed(words)
            weight = np.array([counter[w] for w in words], float)[owner]
            orders = {}
            for k, key, valid in grams(data, place):
                orders[k] = (
                    summed(key[valid], weight[valid]),
                    summed(key[valid & (place == k - 1)], weight[valid & (place == k - 1)]),
                )
            found.append(orders)
        self.levels: list[list[Level]] = []
        for k in range(1, ORDER + 1):
            groups = [found] if k <= SHARED else [[f] for f in found]
            self.levels.append([])
            for group in groups:
                if k == ORDER:
                    keys, count = summed(*map(np.concatenate, zip(*[g[k][0] for g in group], strict=True)))
                else:
                    # Distinct bytes before an n-gram; at a word's begin there are none, so occurrences.
                    longer = np.unique(np.concatenate([g[k + 1][0][0] for g in group]))
                    tail = longer & U((1 << 8 * k) - 1)
                    parts = [(tail, np.ones(len(tail))), *[g[k][1] for g in group]]
                    keys, count = summed(*map(np.concatenate, zip(*parts, strict=True)))
                side, mass = len(self.levels[-1]), 0.0 if k <= SHARED else MASS
                self.levels[-1].append(Level(keys, count, self._lower(k, keys, side), mass))

    def _lower(self, k: int, keys: np.ndarray, side: int) -> np.ndarray:
        p = np.full(len(keys), 1 / 256)
        for j in range(1, k):
            p, _ = self._level(j, side).refine(keys & U((1 << 8 * j) - 1), p)
        return p

    def _level(self, k: int, side: int) -> Level:
        levels = self.levels[k - 1]
        return levels[side if len(levels) > 1 else 0]

    def evidence(self, words: list[bytes]) -> np.ndarray:
        """Log-likelihood as toxic minus as ordinary of each word."""
        if not words:
            return np.zeros(0)
        data, place, owner = framed(words)
        p = [np.full(len(data), 1 / 256) for _ in (0, 1)]
        # A longer history is unknown wherever a shorter one is.
        open_ = [np.ones(len(data), bool) for _ in (0, 1)]
        for k, key, valid in grams(data, place):
            for side in (0, 1):
                if side and k <= SHARED:
                    p[1], open_[1] = p[0].copy(), open_[0].copy()
                    continue
                at = np.flatnonzero(valid & open_[side])
                p[side][at], known = self._level(k, side).refine(key[at], p[side][at])
                open_[side][at[~known]] = False
        gain = np.where(place >= 1, np.log(p[1]) - np.log(p[0]), 0)
        return np.bincount(owner, gain, len(words))


class Evidence:
    """Evidence of words, remembered by hash up to a bound."""

    def __init__(self, model: KneserNey):
        self.model = model
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def of(self, texts: Texts, words, hashes: np.ndarray) -> np.ndarray:
        distinct, first = np.unique(hashes, return_index=True)
        new = look_up(self.keys, distinct) < 0
        if new.any():
            content = texts.data.tobytes()
            spans = zip(words.start[first[new]].tolist(), words.end[first[new]].tolist(), strict=True)
            found = self.model.evidence([content[a:b] for a, b in spans])
            if len(self.keys) > REMEMBERED:
                old = distinct[~new]
                self.values, self.keys = self.values[look_up(self.keys, old)], old
            keys, values = np.append(self.keys, distinct[new]), np.append(self.values, found)
            order = np.argsort(keys)
            self.keys, self.values = keys[order], values[order]
        return self.values[look_up(self.keys, hashes)]


def features(texts: Texts, known: Evidence) -> np.ndarray:
    """Per text: strongest word, second strongest, strongest stretch and whole text per byte, and sums over words."""
    words = split(texts, PUNCTUATION)
    out = np.zeros((len(texts), FEATURES))
    full = np.flatnonzero(np.diff(words.first))
    if not len(full):
        return out
    gain = known.of(texts, words, word_hashes(texts, words))
    first = words.first[full]
    size = (words.end - words.start + 1).astype(float)
    top = np.maximum.reduceat(gain, first)
    place = np.arange(len(gain))
    is_top = gain == np.repeat(top, np.diff(words.first)[full])
    where = np.minimum.reduceat(np.where(is_top, place, len(gain)), first)
    rest = gain.copy()
    rest[where] = -np.inf
    second = np.maximum.reduceat(rest, first)
    sums, bytes_before = np.append(0, np.cumsum(gain)), np.append(0, np.cumsum(size))
    last = np.minimum(place + STRETCH, np.repeat(words.first[1:], np.diff(words.first)))
    stretch = (sums[last] - sums[place]) / np.maximum(bytes_before[last] - bytes_before[place], 4 * STRETCH)
    # Beyond CLEAR, a word is not more toxic for being longer.
    out[full, 0] = np.clip(top, 0, CLEAR)
    out[full, 1] = np.clip(second, 0, CLEAR)
    out[full, 2] = np.maximum.reduceat(stretch, first)
    out[full, 3] = np.add.reduceat(gain, first) / np.add.reduceat(size, first)
    number = np.diff(words.first)[full]
    weak, strong = (np.add.reduceat(np.clip(gain - least, 0, most), first) for least, most in (WEAK, STRONG))
    out[full, 4], out[full, 5], out[full, 6] = weak / np.sqrt(number), np.log1p(weak), strong / number
    return out


def distinct_words(text: bytes) -> set[bytes]:
    """A word counts once per text: a text that repeats itself tells no more."""
    found: set[bytes] = set()
    for part in slices(pa.array([text], pa.binary()).cast(pa.string()), lower=True):
        words, content = split(part, PUNCTUATION), part.data.tobytes()
        found.update(content[a:b] for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True))
    return found


def judged(texts: list[bytes], model: KneserNey) -> np.ndarray:
    known = Evidence(model)
    column = pa.array(texts, pa.binary()).cast(pa.string())
    return np.concatenate([np.zeros((0, FEATURES)), *[features(p, known) for p in slices(column, lower=True)]])


class Judge:
    """Models, and the logistic curve over the features of a text."""

    def __init__(self, texts: list[bytes], labels: list[int], counts: dict[int, int]):
        words = [distinct_words(t) for t in texts]

        def model(chosen: np.ndarray) -> KneserNey:
            seen = [Counter(), Counter()]
            for i in chosen:
                seen[labels[i]].update(words[i])
            return KneserNey(seen)

        fold = np.arange(len(texts)) % FOLDS
        rows = np.zeros((len(texts), FEATURES))
        for k in range(FOLDS):
            own = np.flatnonzero(fold == k)
            rows[own] = judged([texts[i] for i in own], model(np.flatnonzero(fold != k)))
        self.model = model(np.arange(len(texts)))
        y = np.array(labels, float)
        self.mean, self.scale = rows.mean(0), rows.std(0) + 1e-9
        x = np.hstack([(rows - self.mean) / self.scale, np.ones((len(rows), 1))])
        w, ridge = np.zeros(x.shape[1]), np.diag([1.0] * FEATURES + [1e-3])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve(x.T * (p * (1 - p)) @ x + ridge, x.T @ (y - p) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        # The sample holds other shares of the classes than the labels do.
        w[-1] += np.log(max(counts[1], 1) / max(counts[0], 1)) - np.log(max(y.sum(), 1) / max((1 - y).sum(), 1))
        self.weights = w

    def score(self, rows: np.ndarray) -> np.ndarray:
        x = np.hstack([(rows - self.mean) / self.scale, np.ones((len(rows), 1))])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def fit(texts: list[bytes], labels: list[int], counts: dict[int, int]) -> Judge | float:
    if min(labels.count(0), labels.count(1)) < 4:
        return counts.get(1, 0) / sum(counts.values()) if sum(counts.values()) else 0.1
    return Judge(texts, labels, counts)


def train(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Judge | float:
    rows, counts = labelled_sample(documents, labels, "toxic", SPLIT, per_class, MAX_BYTES)
    found = rows.toPandas().sort_values(["label", "doc_id"])
    return fit([t.encode() for t in found.text], [int(x) for x in found.label], counts)


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted."""
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, labels))
    known: list[Evidence] = []

    def work(batch: pa.RecordBatch):
        judge = shared.value
        if isinstance(judge, float):
            score = np.full(batch.num_rows, judge)
        else:
            if not known:
                known.append(Evidence(judge.model))
            parts = [judge.score(features(t, known[0])) for t in slices(batch.column(1), lower=True)]
            score = np.concatenate(parts)
        yield pa.table(
            {
                "doc_id": batch.column(0),
                "held_out": batch.column(2),
                "score": pa.array(score, pa.float64()),
                "predicted": pa.array((score >= threshold).astype(np.int32)),
            }
        )

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out("doc_id", SPLIT).alias("held_out"))
    return per_batch(rows, "doc_id bigint, held_out boolean, score double, predicted int", work)
