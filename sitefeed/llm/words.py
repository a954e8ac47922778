"""Vectorised words of Arrow text columns: byte spans and 64-bit hashes.

A column of strings is one buffer of UTF-8 bytes plus offsets. Word boundaries,
word hashes and hashes of word windows are computed for thousands of texts at
once, with no loop over texts or words. All hashes are polynomials modulo 2^64,
read off prefix sums, and mixed afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
#: Text bytes worked on at a time; a longer text is taken alone.
SLICE_BYTES = 2 << 20
_BASE = U(0x9E3779B97F4A7C15)  # odd, so powers can be undone
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything that is not part of a lower-cased word of letters, digits, non-ASCII.
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD6E8FEB86659FD93))


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: U) -> np.ndarray:
        steps = np.full(size, base)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    return run(_BASE), run(_INVERSE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(1 << max(SLICE_BYTES.bit_length(), int(n).bit_length()))
    return up[:n], down[:n]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def window_hashes(values: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of every ``width`` consecutive values; empty if there are fewer."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    sums = prefix_sums(mix(values + U(salt)) if salt else values)
    return mix((sums[width:] - sums[:-width]) * powers(len(values) - width + 1)[1] + U(width))


@dataclass
class Texts:
    """Some consecutive texts of a batch: bytes, offsets, and the first one's row."""

    row: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


@dataclass
class Words:
    """Byte spans of all words of some texts; words of text i are first[i]:first[i+1]."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def slices(column: pa.Array, lower: bool = False, limit: int | None = None) -> Iterator[Texts]:
    """Texts in groups of about ``limit`` bytes; null reads as empty."""
    limit = limit or SLICE_BYTES
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, ends, content = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(max(stop, row + 1), len(column))
        part = data[offsets[row] : offsets[stop]]
        yield Texts(row, TO_LOWER[part] if lower else part, offsets[row : stop + 1] - offsets[row])
        row = stop


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal stretches of True that never cross a text's end."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begin[heads] = inside[heads]
    tails = offsets[1:][np.diff(offsets) > 0] - 1
    finish[tails] = inside[tails]
    return np.flatnonzero(begin), np.flatnonzero(finish) + 1


def split(texts: Texts, separators: np.ndarray = SPACE) -> Words:
    start, end = runs(~separators[texts.data], texts.offsets)
    return Words(start, end, np.searchsorted(start, texts.offsets))


def word_hashes(texts: Texts, words: Words) -> np.ndarray:
    if not len(words.start):
        return np.zeros(0, np.uint64)
    sums = prefix_sums(_BYTE[texts.data])
    down = powers(len(texts.data))[1]
    return mix((sums[words.end] - sums[words.start]) * down[words.start] + (words.end - words.start).astype(np.uint64))


def windows_within(first: np.ndarray, width: int, total: int) -> np.ndarray:
    """For each window start, whether the window stays within one text."""
    if total < width:
        return np.zeros(0, bool)
    ends = np.repeat(first[1:], np.diff(first))
    return np.arange(total - width + 1) + width <= ends[: total - width + 1]
