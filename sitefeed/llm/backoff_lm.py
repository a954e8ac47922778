"""Language model scoring with a weighted backoff automaton.

Tokens are words between ASCII blanks, lower-cased in A-Z, and one end per text.
States are histories of up to two tokens. A state has an arc for each token seen
after it, weighted with the smoothed log10 probability, and a failure arc to the
shorter history, weighted with the mass left to unseen tokens:

    p(w | h) = (c(h w) + m p(w | h')) / (c(h) + m)      arc
    p(w | h) = m / (c(h) + m) * p(w | h')               failure arc, then h'

with one m per order (Dirichlet smoothing). The empty history holds discounted
token shares; its discount is spread evenly over all tokens and one unknown, so it
has an arc for every token. A history is a state if it was seen at least
``LEAST_STATE`` times. An arc leads to the longest history after its token that is a
state. The score is that of one walk from left to right, from the state of an end:
the walk carries its state, takes the arc of the next token, or else failure arcs
until a state has one, and adds up what it passes.

Counts cover every text that is not held out. The automaton is never in one
place: blocks of documents ask for the counts of their own n-grams (see blocks),
which makes the part of the automaton that the block can reach (``Automaton``). Orders
follow one another, so n-grams after histories that are no states are never asked for.
All texts of a block walk abreast. A text of more than ``STRIDE`` tokens is walked in
stretches: a state depends on two tokens at most, so a stretch that first reads the
two tokens before it is in the state that the walk from the text's start would be in.

Null or empty texts are one end. Rows without doc_id are learnt from, not held
out. With nothing to learn from, all scores are zero. Words are told apart by 64
bits of hash, longer n-grams by 56. Repeated rows count and score as often as
they occur. Texts of any length are scored whole; further columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefeed.llm.blocks import QUESTION, gathered, heads, in_blocks, look_up, pack, questions, spread, unpack
from sitefeed.llm.common import held_out
from sitefeed.llm.words import U, mix, slices, split, word_hashes
from sitefeed.runtime import materialize

#: Smoothing masses of histories of one and two tokens; least count of a state.
MASSES, LEAST_STATE = (2000.0, 20.0), 2
END = U(0x5EED0FE11D0C5EED)
#: Tokens that a walk passes in one stretch, and those it reads before to find its state.
STRIDE, LEAD = 512, 2
#: Modulus of the crc32 split.
SPLIT = 7
STATS = "n bigint, v bigint, n1 bigint, n2 bigint"
RESULT = (
    "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, "
    "train_tokens bigint, base_score double, score double"
)


class Tokens:
    """Token hashes of a block's texts with their histories, and which are learnt from."""

    def __init__(self, table: pa.Table):
        parts, sizes = [], []
        for texts in slices(table["text"], lower=True):
            words = split(texts)
            parts.append(np.insert(word_hashes(texts, words), words.first[1:], END))
            sizes.append(np.diff(words.first) + 1)
        self.token, self.size = np.concatenate(parts), np.concatenate(sizes)
        self.held = np.repeat(table["held_out"].to_numpy(), self.size)
        self.before = np.append(END, self.token[:-1])
        second = np.append(END, self.before[:-1])
        # An end is a fresh start: nothing before it counts.
        self.second = np.where(self.before == END, END, second)

    def pairs(self) -> np.ndarray:
        return mix(self.before * U(3) + self.token) >> U(8) << U(8)

    def triples(self) -> np.ndarray:
        return mix(mix(self.second * U(5) + self.before) * U(3) + self.token) >> U(8) << U(8)


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, ascending, a place of each, and the number of every place's key."""
    order = np.argsort(keys)
    ascending = keys[order]
    first = heads(ascending)
    number = np.empty(len(keys), np.int64)
    number[order] = spread(np.arange(len(first)), first, len(keys))
    return ascending[first], order[first], number


def counted(keys: np.ndarray, learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each occurs in learnt places."""
    order = np.argsort(keys)
    keys, learnt = keys[order], learnt[order]
    first = heads(keys)
    return keys[first], np.add.reduceat(learnt.astype(np.uint64), first) if len(first) else keys


def sums(asked: DataFrame) -> DataFrame:
    """Per block's row the total count of each of its keys, in the order of the keys.

    One row per bucket also holds the bucket's sums: count, keys, keys seen once, twice.
    """

    def work(table: pa.Table) -> pa.Table:
        (key, count), owner, sizes = gathered(table, 2)
        first = heads(key)
        each = np.add.reduceat(count, first)
        total = spread(each, first, len(key))
        by_row = np.argsort(owner, kind="stable")
        cuts = np.cumsum([0, *sizes])
        packed = [pack(np.zeros(0, np.uint64)) if a == b else _plain(total[by_row[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        stats = [int(each.sum()), int((each > 0).sum()), int((each == 1).sum()), int((each == 2).sum())]
        rest = [0] * (len(sizes) - 1)
        named = {n: table[n] for n in ("bucket", "block", "part")}
        columns = {n: pa.array([x, *rest], pa.int64()) for n, x in zip(("n", "v", "n1", "n2"), stats, strict=True)}
        return pa.table({**named, "packed": pa.array(packed, pa.binary()), **columns})

    return asked.groupBy("bucket", "part").applyInArrow(work, f"{QUESTION}, {STATS}")


def _plain(values: np.ndarray) -> bytes:
    """Numbers in any order."""
    return pack(np.arange(len(values), dtype=np.uint64), values)


def totals(answers: pa.Table, part: int) -> np.ndarray:
    """A block's answers of one part, in the order of its keys."""
    rows = sorted(
        (b, p) for b, k, p in zip(*[answers[n].to_pylist() for n in ("bucket", "part", "packed")], strict=True) if k == part
    )
    return np.concatenate([np.zeros(0, np.uint64), *[unpack(p, 2)[1] for _, p in rows]])


class Counts:
    """Counts of a block's tokens, and of the n-grams that were asked for.

    ``word`` is the number of each place's token among the block's, ``word_at`` a place of
    each token; so it is with pairs and triples, whose number is -1 where not asked for.
    """

    def __init__(self, held: Tokens, answers: pa.Table):
        self.held, self.answers = held, answers
        _, self.word_at, self.word = numbered(held.token)
        self.word_totals = totals(answers, 0).astype(np.int64)
        # The last place of any text is an end.
        self.end = self.word[-1]
        self.before = np.append(self.end, self.word[:-1])

    def asked_pairs(self) -> np.ndarray:
        """Places whose one-token history is a state."""
        return self.word_totals[self.before] >= LEAST_STATE

    def add_pairs(self) -> None:
        self.pair_at, self.pair = _numbered(self.held.pairs(), self.asked_pairs())
        self.pair_totals = totals(self.answers, 1).astype(np.int64)

    def asked_triples(self) -> np.ndarray:
        """Places whose two-token history is a state. At a text's start it never is one."""
        history = np.where(self.held.before == END, -1, np.append(-1, self.pair[:-1]))
        return (history >= 0) & (np.append(self.pair_totals, 0)[history] >= LEAST_STATE)

    def add_triples(self) -> None:
        self.triple_at, _ = _numbered(self.held.triples(), self.asked_triples())
        self.triple_totals = totals(self.answers, 2).astype(np.int64)


def _numbered(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key that was asked for, and all places' numbers, else -1."""
    places = np.flatnonzero(asked)
    _, at, found = numbered(keys[places])
    number = np.full(len(keys), -1)
    number[places] = found
    return places[at], number


def ask_words(table: pa.Table, buckets: int) -> pa.Table:
    held = Tokens(table)
    return questions(table["block"][0].as_py(), 0, buckets, *counted(held.token, ~held.held))


def ask_pairs(table: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    held = Tokens(table)
    place = Counts(held, answers).asked_pairs()
    return questions(table["block"][0].as_py(), 1, buckets, *counted(held.pairs()[place], ~held.held[place]))


def ask_triples(table: pa.Table, answers: pa.Table, buckets: int) -> pa.Table:
    held = Tokens(table)
    counts = Counts(held, answers)
    counts.add_pairs()
    place = counts.asked_triples()
    return questions(table["block"][0].as_py(), 2, buckets, *counted(held.triples()[place], ~held.held[place]))


class Root:
    """The empty history: discounted shares of tokens, the rest for all tokens and the unknown."""

    def __init__(self, n: int, v: int, n1: int, n2: int):
        self.n, self.v = n, v
        self.discount = n1 / (n1 + 2 * n2) if n1 else 0.5
        self.share = self.discount * v / n / (v + 1) if n else 0.0

    def probability(self, count: np.ndarray) -> np.ndarray:
        return np.maximum(count - self.discount, 0) / self.n + self.share

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.n + self.v + 1))


class Automaton:
    """The part of the automaton that a block's texts can reach.

    State 0 is the empty history, then come those of one token, then those of two.
    ``failure`` and ``loss`` are target and weight of each state's failure arc. Arcs are
    sorted by ``key``, state * tokens + token, and have ``weight`` and ``target``.
    """

    def __init__(self, counts: Counts, root: Root, masses: tuple[float, float] = MASSES):
        counts.add_pairs()
        counts.add_triples()
        word, pair = counts.word, counts.pair
        self.tokens = len(counts.word_totals)
        ones, twos = counts.word_totals >= LEAST_STATE, counts.pair_totals >= LEAST_STATE
        after_word = np.where(ones, np.cumsum(ones), 0)
        after_pair = np.where(twos, ones.sum() + np.cumsum(twos), after_word[word[counts.pair_at]])
        self.start = after_word[counts.end]

        seen = np.concatenate([counts.word_totals[ones], counts.pair_totals[twos]])
        mass = np.repeat(np.array(masses), [ones.sum(), twos.sum()])
        self.failure = np.concatenate([[0], np.zeros(ones.sum(), np.int64), after_word[word[counts.pair_at[twos]]]])
        self.loss = np.append(0.0, np.log10(mass / (seen + mass)))
        seen = np.append(0, seen)

        at = counts.pair_at
        p = root.probability(counts.word_totals)
        from_one, of_pair = after_word[counts.before[at]], counts.pair_totals
        q = (of_pair + masses[0] * p[word[at]]) / (seen[from_one] + masses[0])
        met = of_pair > 0
        parts = [(np.arange(self.tokens), p, after_word), ((from_one * self.tokens + word[at])[met], q[met], after_pair[met])]
        at = counts.triple_at
        if len(at):
            from_two, of_triple, own = after_pair[pair[at - 1]], counts.triple_totals, pair[at]
            r = (of_triple + masses[1] * q[own]) / (seen[from_two] + masses[1])
            met = of_triple > 0
            parts.append(((from_two * self.tokens + word[at])[met], r[met], after_pair[own[met]]))
        key, p, target = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key)
        self.key, self.weight, self.target = key[order], np.log10(p[order]), target[order]

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gain and next state of walks in ``state`` that read ``token``."""
        gain, after = np.zeros(len(state)), np.empty_like(state)
        walks = np.arange(len(state))
        while len(walks):
            arc = look_up(self.key, state * self.tokens + token)
            fits = arc >= 0
            done, taken = walks[fits], arc[fits]
            gain[done] += self.weight[taken]
            after[done] = self.target[taken]
            walks, state, token = walks[~fits], state[~fits], token[~fits]
            gain[walks] += self.loss[state]
            state = self.failure[state]
        return gain, after


def traverse(automaton: Automaton, word: np.ndarray, size: np.ndarray, stride: int = STRIDE) -> np.ndarray:
    """log10 probability of each text: its tokens' numbers lie one after another in ``word``."""
    pieces = -(-size // stride)
    text = np.repeat(np.arange(len(size)), pieces)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    lead = np.where(nth > 0, LEAD, 0)
    begin = (np.cumsum(size) - size)[text] + nth * stride - lead
    length = np.minimum(size[text] - nth * stride, stride) + lead
    # Longest first, so those that are still on their way are always the first ones.
    order = np.argsort(-length, kind="stable")
    text, begin, length, lead = text[order], begin[order], length[order], lead[order]
    state = np.where(lead > 0, 0, automaton.start)
    total = np.zeros(len(text))
    for t in range(int(length[0])):
        n = int(np.searchsorted(-length, -t))
        gain, state = automaton.step(state[:n], word[begin[:n] + t])
        total[:n] += np.where(t < lead[:n], 0.0, gain)
    return np.bincount(text, total, len(size))


def scored(table: pa.Table, answers: pa.Table, root: Root) -> pa.Table:
    held = Tokens(table)
    n = len(held.size)
    first = np.cumsum(held.size) - held.size
    counts = Counts(held, answers)
    if root.n:
        base = np.add.reduceat(root.base(counts.word_totals)[counts.word], first)
        score = traverse(Automaton(counts, root), counts.word, held.size)
    else:
        base = score = np.zeros(n)
    return pa.table(
        {
            "doc_id": table["doc_id"],
            "held_out": table["held_out"],
            "n_tokens": pa.array(held.size, pa.int64()),
            "n_known": pa.array(np.add.reduceat((counts.word_totals > 0)[counts.word].astype(np.int64), first)),
            "train_tokens": pa.array(np.full(n, root.n), pa.int64()),
            "base_score": pa.array(base, pa.float64()),
            "score": pa.array(score, pa.float64()),
        }
    )


def score(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out("doc_id", SPLIT).alias("held_out")
    )
    blocks, buckets = in_blocks(rows, "doc_id", "text")
    dealt = blocks.groupBy("block")

    def asked(ask, answers: DataFrame) -> DataFrame:
        def work(table: pa.Table, found: pa.Table) -> pa.Table:
            return ask(table, found, buckets)

        return dealt.cogroup(answers.groupBy("block")).applyInArrow(work, QUESTION)

    words = sums(dealt.applyInArrow(lambda table: ask_words(table, buckets), QUESTION))
    words = materialize(words, "word-counts")
    stats = words.agg(*[F.sum(c).alias(c) for c in ("n", "v", "n1", "n2")]).first()
    root = Root(*[int(x or 0) for x in stats])
    words = words.select("block", "bucket", "part", "packed")
    pairs = materialize(sums(asked(ask_pairs, words)), "pair-counts").select("block", "bucket", "part", "packed")
    known = words.unionByName(pairs)
    triples = sums(asked(ask_triples, known)).select("block", "bucket", "part", "packed")
    return dealt.cogroup(known.unionByName(triples).groupBy("block")).applyInArrow(
        lambda table, found: scored(table, found, root), RESULT
    )


