"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are covered by overlapping chunks of ``CHUNK`` bytes. Filters
of ``WIDTH`` bytes slide over a chunk in steps of ``STRIDE``; each filter's highest
response is kept (max-pooling). A hidden layer turns these into chunk features;
their mean and maximum over all chunks are combined into one probability. Only
the bytes of the text enter a score.

Learning uses a bounded sample: at most ``PER_CLASS`` labelled rows of each class,
each of at most ``MAX_BYTES`` bytes, from rows that are not held out. Scoring
covers every byte of every text, a bounded number of chunks at a time.

Null or empty texts are one chunk of zero bytes and get that chunk's score.
Without labels of both classes every score is the share of label 1 (0.5 without
any label). Repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefeed.llm.common import held_out, labelled_sample, per_batch, unused
from sitefeed.llm.words import slices

CHUNK, STEP, WIDTH, STRIDE = 256, 192, 8, 4
FILTERS, HIDDEN = 24, 12
PER_CLASS, MAX_BYTES, EPOCHS, BATCH_DOCS = 1200, 1 << 15, 12, 24
#: Modulus of the crc32 split for quality labels.
SPLIT = 4
#: Chunks scored at a time.
CHUNKS_AT_ONCE = 256
_AT = np.arange(0, CHUNK - WIDTH + 1, STRIDE)


def chunk_spans(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and byte range within the text of every chunk; one chunk at least."""
    count = 1 + np.maximum(0, -(-(lengths - CHUNK) // STEP))
    text = np.repeat(np.arange(len(lengths)), count)
    begin = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * STEP
    return text, begin, np.minimum(begin + CHUNK, lengths[text])


def chunk_bytes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Matrix of chunks; zero beyond a text's end."""
    padded = np.concatenate([data, np.zeros(CHUNK, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[begin]
    short = np.flatnonzero(end - begin < CHUNK)
    out[short] *= np.arange(CHUNK) < (end - begin)[short, None]
    return out


class ByteCNN:
    """Weights and passes; ``filters`` holds a number for each offset, byte and filter."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.filters = r.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.w1 = r.normal(0, (2 / FILTERS) ** 0.5, (FILTERS, HIDDEN)).astype(np.float32)
        self.b1 = np.zeros(HIDDEN, np.float32)
        self.w2 = r.normal(0, 0.3, 2 * HIDDEN).astype(np.float32)
        self.b2 = np.zeros(1, np.float32)
        self.shift = 0.0

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.w1, self.b1, self.w2, self.b2]

    def pair_tables(self) -> np.ndarray:
        """Responses of every two adjacent bytes: half as many look-ups as bytes."""
        pairs = self.filters[0::2, :, None, :] + self.filters[1::2, None, :, :]
        return pairs.reshape(WIDTH // 2, 65536, FILTERS)

    def responses(self, chunks: np.ndarray, tables: np.ndarray | None = None) -> np.ndarray:
        if tables is None:
            out = self.filters[0][chunks[:, _AT]]
            for j in range(1, WIDTH):
                out += self.filters[j][chunks[:, _AT + j]]
            return out
        pairs = chunks[:, 0::2].astype(np.uint16) << np.uint16(8) | chunks[:, 1::2]
        out = tables[0][pairs[:, _AT // 2]]
        for j in range(1, WIDTH // 2):
            out += tables[j][pairs[:, _AT // 2 + j]]
        return out

    def hidden(self, chunks: np.ndarray, tables: np.ndarray) -> np.ndarray:
        pooled = np.maximum(self.responses(chunks, tables).max(axis=1) + self.bias, 0)
        return np.maximum(pooled @ self.w1 + self.b1, 0)

    def logits(self, mean: np.ndarray, top: np.ndarray) -> np.ndarray:
        return np.concatenate([mean, top], axis=1) @ self.w2 + self.b2[0] + self.shift

    def gradients(self, chunks: np.ndarray, text: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss over texts; ``text`` numbers the chunks' texts from 0."""
        rows, n = np.arange(len(chunks)), len(label)
        raw = self.responses(chunks)
        best = raw.argmax(axis=1)
        pooled = np.take_along_axis(raw, best[:, None, :], 1)[:, 0] + self.bias
        active = np.maximum(pooled, 0)
        inner = active @ self.w1 + self.b1
        hidden = np.maximum(inner, 0)
        first = np.searchsorted(text, np.arange(n))
        count = np.diff(np.append(first, len(text)))[:, None]
        mean = np.add.reduceat(hidden, first, axis=0) / count
        top = np.maximum.reduceat(hidden, first, axis=0)
        both = np.concatenate([mean, top], axis=1)
        p = 1 / (1 + np.exp(-np.clip(both @ self.w2 + self.b2[0], -30, 30)))
        d = ((p - label) / n).astype(np.float32)
        d_both = d[:, None] * self.w2
        is_top = hidden == top[text]
        d_hidden = d_both[text, :HIDDEN] / count[text] + d_both[text, HIDDEN:] * is_top
        d_inner = d_hidden * (inner > 0)
        d_pooled = (d_inner @ self.w1.T) * (pooled > 0)
        at = _AT[best][:, :, None] + np.arange(WIDTH)
        cell = (np.arange(WIDTH) * 256 + chunks[rows[:, None, None], at]) * FILTERS
        cell += np.arange(FILTERS)[None, :, None]
        weight = np.broadcast_to(d_pooled[:, :, None], cell.shape)
        d_filters = np.bincount(cell.ravel(), weight.ravel(), WIDTH * 256 * FILTERS)
        return [
            d_filters.reshape(self.filters.shape).astype(np.float32),
            d_pooled.sum(0), active.T @ d_inner, d_inner.sum(0), both.T @ d, d.sum(keepdims=True),
        ]


def cropped(text: bytes, r: np.random.Generator) -> bytes:
    """A fourth of the looks at a text show some of its words only, so short texts are known too."""
    if r.random() >= 0.25 or len(text) < 64:
        return text
    size = int(r.integers(16, 320))
    begin = text.find(b" ", int(r.integers(0, max(1, len(text) - size)))) + 1
    return text[begin : begin + size]


def fit(texts: list[bytes], labels: list[int], counts: dict[int, int], seed: int = 5) -> ByteCNN | float:
    """Adam on batches of texts; a constant if only one class is known."""
    if len(set(labels)) < 2:
        return counts.get(1, 0) / sum(counts.values()) if sum(counts.values()) else 0.5
    model, r = ByteCNN(seed), np.random.default_rng(seed)
    first = [np.zeros_like(p) for p in model.parts]
    second = [np.zeros_like(p) for p in model.parts]
    label, step = np.array(labels, np.float32), 0
    for epoch in range(EPOCHS):
        rate = 0.01 * (1 - epoch / EPOCHS) + 0.0005
        order = r.permutation(len(texts))
        for begin in range(0, len(order), BATCH_DOCS):
            batch = order[begin : begin + BATCH_DOCS]
            chosen = [cropped(texts[i], r) for i in batch]
            lengths = np.array([len(t) for t in chosen])
            data = np.frombuffer(b"".join(chosen), np.uint8)
            text, low, high = chunk_spans(lengths)
            offset = (np.cumsum(lengths) - lengths)[text]
            step += 1
            grads = model.gradients(chunk_bytes(data, low + offset, high + offset), text, label[batch])
            for part, g, m, v in zip(model.parts, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                part -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    # The sample is balanced; the corpus is not.
    share = np.log(max(counts[1], 1) / max(counts[0], 1)) - np.log(label.sum() / (1 - label).sum())
    model.shift = float(share)
    return model


def score_texts(model: ByteCNN, tables: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Probability of each text; chunks of a text may come in several rounds."""
    n = len(offsets) - 1
    text, low, high = chunk_spans(np.diff(offsets))
    low, high = low + offsets[text], high + offsets[text]
    total, top = np.zeros((n, HIDDEN)), np.full((n, HIDDEN), -np.inf)
    for begin in range(0, len(text), CHUNKS_AT_ONCE):
        part = slice(begin, begin + CHUNKS_AT_ONCE)
        hidden = model.hidden(chunk_bytes(data, low[part], high[part]), tables)
        owner = text[part]
        heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        total[owner[heads]] += np.add.reduceat(hidden, heads, axis=0)
        top[owner[heads]] = np.maximum(top[owner[heads]], np.maximum.reduceat(hidden, heads, axis=0))
    mean = total / np.bincount(text, minlength=n)[:, None]
    return 1 / (1 + np.exp(-np.clip(model.logits(mean, top), -30, 30)))


def train(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ByteCNN | float:
    rows, counts = labelled_sample(documents, labels, "quality", SPLIT, per_class, MAX_BYTES)
    found = rows.toPandas().sort_values("doc_id")
    return fit([t.encode() for t in found.text], [int(x) for x in found.label], counts)


def with_quality(
    documents: DataFrame, model: ByteCNN | float, threshold: float = 0.7,
    scored: str = "quality_score", predicted: str = "quality_predicted",
) -> DataFrame:
    """All columns of the documents plus two, which by default are ``quality_score`` and ``quality_predicted``."""
    names = documents.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    tables: list[np.ndarray] = []

    def work(batch: pa.RecordBatch):
        net = shared.value
        if isinstance(net, float):
            score = np.full(batch.num_rows, net)
        else:
            if not tables:
                tables.append(net.pair_tables())
            column = batch.column(names.index("text"))
            score = np.concatenate([score_texts(net, tables[0], t.data, t.offsets) for t in slices(column)])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))],
            [*batch.schema.names, scored, predicted],
        )

    return per_batch(documents, f"{kinds}, {scored} double, {predicted} int", work)


def quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = train(documents, labels)
    return with_quality(documents.select("doc_id", "text"), model, threshold).select(
        "doc_id",
        held_out("doc_id", SPLIT).alias("held_out"),
        F.col("quality_score").alias("score"),
        F.col("quality_predicted").alias("predicted"),
    )


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents that the classifier accepts, with their own columns only."""
    score, predicted = (unused(documents.columns, n) for n in ("quality_score", "quality_predicted"))
    scored = with_quality(documents, train(documents, labels), threshold, score, predicted)
    return scored.where(F.col(predicted) == 1).drop(score, predicted)
