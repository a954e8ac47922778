"""Secret scan by grammar inference: merged prefix trees of known credentials.

Three patterns give the base findings: ``assign`` (a value after password,
token, ... ), ``access`` (AKIA keys) and ``hex`` (long hexadecimal runs). The
values they find in the corpus, a bounded sample per kind, are the labelled
credentials. Each kind's prefix tree over character classes is folded into a
probabilistic automaton by merging states whose outgoing frequencies are
statistically compatible (the ALERGIA test with Hoeffding bounds). A further
automaton is inferred from ordinary words. Every candidate (a run of at least
``LEAST`` characters usable in credentials that contains digits and letters) is
scored by its log-likelihood ratio per character against ordinary words; those
over a kind's threshold add a span of kind ``format``. Base findings always stay.

Whole texts are scanned. Null or empty texts have no findings. Without any known
credential no format spans are added. Offsets count code points, end exclusive.
Repeated rows give repeated rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefeed.llm.common import per_batch
from sitefeed.llm.words import TO_LOWER, Texts, runs, slices
from sitefeed.runtime import materialize

# The base patterns, their least lengths, the order of kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
KINDS = ("assign", "access", "hex", "format")
NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]+")
#: Shortest run that is scored.
LEAST = 16
#: Labelled credentials and ordinary words that automata are inferred from, for each kind.
SAMPLE = 400
#: Most characters of a credential that automata are inferred from; longer ones are found as any other.
LONGEST = 512
#: Confidence of the merge test, and share of known credentials under the threshold.
ALPHA, MISSED = 0.05, 0.02

_VALUE = np.zeros(256, bool)
_VALUE[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-", np.uint8)] = True
_HEXES = np.zeros(256, bool)
_HEXES[np.frombuffer(b"0123456789abcdef", np.uint8)] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def symbol(c: str) -> str:
    """Character class: digit, a-f, other lower, A-F, other upper, or the sign itself."""
    if c.isdigit():
        return "0"
    if "a" <= c <= "z":
        return "a" if c <= "f" else "z"
    if "A" <= c <= "Z":
        return "A" if c <= "F" else "Z"
    return c


SYMBOLS = 5 + len("+/_.=-")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) by start, then kind as listed."""
    found = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= LEAST_ASSIGN:
            found.append((m.start(), 0, m.end(), m[2]))
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= LEAST_ACCESS:
            found.append((m.start(), 1, m.end(), m[0]))
    for m in HEX.finditer(text):
        if m.end() - m.start() >= LEAST_HEX:
            found.append((m.start(), 2, m.end(), m[0]))
    return sorted(found)


class Automaton:
    """Probabilistic automaton inferred from strings by merging compatible states."""

    def __init__(self, strings: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.passed: list[dict[str, int]] = [{}]  # how often each arc was taken
        self.ended: list[int] = [0]
        for s in strings:
            state = 0
            for c in map(symbol, s):
                self.passed[state][c] = self.passed[state].get(c, 0) + 1
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.passed.append({})
                    self.ended.append(0)
                state = self.next[state][c]
            self.ended[state] += 1
        self._merge()

    def _total(self, state: int) -> int:
        return self.ended[state] + sum(self.passed[state].values())

    def _compatible(self, a: int, b: int) -> bool:
        """Outgoing and ending frequencies within Hoeffding bounds, for all pairs of successors."""
        pending = [(a, b)]
        while pending:
            a, b = pending.pop()
            n, m = self._total(a), self._total(b)
            if not n or not m:
                continue
            bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ended[a] / n - self.ended[b] / m) > bound:
                return False
            for c in self.passed[a].keys() | self.passed[b].keys():
                if abs(self.passed[a].get(c, 0) / n - self.passed[b].get(c, 0) / m) > bound:
                    return False
                if c in self.next[a] and c in self.next[b]:
                    pending.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Adds the subtree ``tree`` to the state ``into`` and what follows it."""
        pending = [(into, tree)]
        while pending:
            into, tree = pending.pop()
            self.ended[into] += self.ended[tree]
            for c, n in self.passed[tree].items():
                self.passed[into][c] = self.passed[into].get(c, 0) + n
                if c in self.next[into]:
                    pending.append((self.next[into][c], self.next[tree][c]))
                else:
                    self.next[into][c] = self.next[tree][c]

    def _merge(self) -> None:
        kept, border = [0], [(0, c) for c in sorted(self.next[0])]
        while border:
            parent, c = border.pop(0)
            state = self.next[parent][c]
            if state in kept:
                continue
            match = next((k for k in kept if self._compatible(k, state)), None)
            if match is None:
                kept.append(state)
                border += [(state, d) for d in sorted(self.next[state])]
                continue
            self.next[parent][c] = match
            self._fold(match, state)
            border += [(k, d) for k in kept for d in sorted(self.next[k]) if self.next[k][d] not in kept and (k, d) not in border]

    def rate(self, text: str) -> float:
        """Log-likelihood per step; unseen steps get a smoothed share and restart the automaton."""
        state, total = 0, 0.0
        for c in map(symbol, text):
            n = self._total(state)
            total += math.log((self.passed[state].get(c, 0) + 0.1) / (n + 0.1 * (SYMBOLS + 1)))
            state = self.next[state].get(c, 0)
        n = self._total(state)
        return (total + math.log((self.ended[state] + 0.1) / (n + 0.1 * (SYMBOLS + 1)))) / (len(text) + 1)


class Formats:
    """Automata per kind, the one of ordinary words, and each kind's threshold."""

    def __init__(self, known: dict[str, list[str]], ordinary: list[str]):
        self.plain = Automaton(ordinary or ["a"])
        self.kinds, self.least = {}, {}
        for kind, values in sorted(known.items()):
            learnt = Automaton(values)
            gain = [learnt.rate(v) - self.plain.rate(v) for v in values]
            usual = [learnt.rate(v) - self.plain.rate(v) for v in ordinary]
            floor = float(np.quantile(usual, 0.999)) if usual else 0.0
            self.kinds[kind] = learnt
            self.least[kind] = max(float(np.quantile(gain, MISSED)), floor, 0.0)

    def likely(self, value: str) -> bool:
        plain = self.plain.rate(value)
        return any(a.rate(value) - plain >= self.least[k] for k, a in self.kinds.items())


def suspects(texts: Texts) -> np.ndarray:
    """Numbers of the texts that may hold a finding; bytes only, no loop over texts."""
    marked = []
    for inside, least in ((_HEXES, LEAST_HEX), (_VALUE, LEAST)):
        start, end = runs(inside[texts.data], texts.offsets)
        marked.append(start[end - start >= least])
    small = TO_LOWER[texts.data].tobytes()
    for name in NAMES:
        at = small.find(name)
        while at >= 0:
            marked.append(np.array([at]))
            at = small.find(name, at + len(name))
    at = np.concatenate(marked)
    return np.unique(np.searchsorted(texts.offsets, at, "right") - 1)


def candidates(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """Runs with a digit and a letter that touch no base span; ``taken`` is sorted."""
    out, passed, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        low, high = m.span()
        # Of the base spans that begin before the run ends, how far the furthest goes.
        while passed < len(taken) and taken[passed][0] < high:
            reach = max(reach, taken[passed][2])
            passed += 1
        if high - low >= LEAST and low >= reach and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]):
            out.append((low, high, m[0]))
    return out


def known_credentials(documents: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, list[str]], list[str]]:
    """Distinct base findings of each kind, and ordinary words: those with the least hashes."""

    def work(batch: pa.RecordBatch):
        best: dict[str, dict[str, int]] = defaultdict(dict)

        def add(kind: str, value: str) -> None:
            best[kind][value] = int.from_bytes(hashlib.md5(value.encode()).digest()[:7], "big")

        for texts in slices(batch.column(0)):
            for i in suspects(texts):
                text = batch.column(0)[texts.row + int(i)].as_py() or ""
                for _, kind, _, value in base_spans(text):
                    if len(value) <= LONGEST:
                        add(KINDS[kind], value)
            # One word of each text, from a place that its bytes decide, stands for ordinary runs.
            content = texts.data.tobytes()
            view = memoryview(content)
            for low, high in zip(texts.offsets[:-1].tolist(), texts.offsets[1:].tolist(), strict=True):
                begin = content.find(b" ", low + zlib.crc32(view[low:high]) % max(1, high - low), high) + 1
                end = content.find(b" ", begin, high) if begin else 0
                word = content[begin:end] if begin and end > begin + 3 else b""
                if word.isalpha():
                    add("plain", word.decode())
        rows = []
        for kind, values in best.items():
            top = sorted(values.items(), key=lambda x: (x[1], x[0]))[:sample]
            rows += [(kind, v, h) for v, h in top]
        if rows:
            k, v, h = zip(*rows, strict=True)
            yield pa.table({"kind": list(k), "value": list(v), "hash": pa.array(h, pa.int64())})

    rows = per_batch(documents, "kind string, value string, hash bigint", work, "text")
    found = materialize(rows.groupBy("kind", "value").agg(F.min("hash").alias("hash")), "credentials")
    known: dict[str, list[str]] = {}
    for kind in (*KINDS[:3], "plain"):
        top = found.where(F.col("kind") == kind).orderBy("hash", "value").limit(sample)
        if values := [r.value for r in top.collect()]:
            known[kind] = values
    return known, known.pop("plain", [])


def learn(documents: DataFrame, sample: int = SAMPLE) -> Formats | None:
    known, ordinary = known_credentials(documents, sample)
    return Formats(known, ordinary) if known else None


def find_spans(text: str, formats: Formats | None) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of base findings and likely formats, by start."""
    base = base_spans(text)
    found = [(a, k, b) for a, k, b, _ in base]
    if formats:
        found += [(a, 3, b) for a, b, v in candidates(text, base) if formats.likely(v)]
    return sorted(found)


def with_spans(documents: DataFrame, formats: Formats | None) -> DataFrame:
    """All columns of the documents plus ``secret_spans``: array of (kind, begin, end)."""
    names = documents.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    shared = documents.sparkSession.sparkContext.broadcast(formats)
    span = pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())])

    def work(batch: pa.RecordBatch):
        column = batch.column(names.index("text"))
        spans: list[list[dict]] = [[] for _ in range(len(column))]
        for texts in slices(column):
            for i in suspects(texts):
                row = texts.row + int(i)
                found = find_spans(column[row].as_py() or "", shared.value)
                spans[row] = [{"kind": KINDS[k], "begin": a, "end": b} for a, k, b in found]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(spans, pa.list_(span))], [*batch.schema.names, "secret_spans"]
        )

    return per_batch(documents, f"{kinds}, secret_spans array<struct<kind: string, begin: int, end: int>>", work)


def scan(documents: DataFrame) -> DataFrame:
    """Per document: counts of base findings, digest of them, all spans as text."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secret_spans", lambda s: s["kind"] != "format")
    return with_spans(documents.select("doc_id", "text"), learn(documents)).select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secret_spans")).alias("spans"),
    )


def redact(documents: DataFrame, mask: str = "[secret]") -> DataFrame:
    """The documents with every found span replaced by ``mask``; no document goes."""
    names = documents.columns
    shared = documents.sparkSession.sparkContext.broadcast(learn(documents))

    def work(batch: pa.RecordBatch):
        at = names.index("text")
        column = batch.column(at)
        changed: dict[int, str] = {}
        for texts in slices(column):
            for i in suspects(texts):
                row = texts.row + int(i)
                text = column[row].as_py() or ""
                parts, done = [], 0
                for begin, _, end in find_spans(text, shared.value):
                    if begin >= done:
                        parts += [text[done:begin], mask]
                    done = max(done, end)
                if parts:
                    changed[row] = "".join([*parts, text[done:]])
        if changed:
            values = column.to_pylist()
            for row, text in changed.items():
                values[row] = text
            column = pa.array(values, column.type)
        arrays = [column if i == at else c for i, c in enumerate(batch.columns)]
        yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return per_batch(documents, documents.schema, work)
