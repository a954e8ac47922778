"""Questions of many document blocks, answered by key, in packed form.

Documents are dealt into blocks by their ids. A block asks about its distinct
64-bit keys; keys are dealt into buckets, so all blocks' questions about a key
meet in one place. A row of the exchange is one block's sorted keys for one
bucket, packed: about five bytes a key instead of a row a key. The answers go
back to the blocks, where the documents are read again. No task holds more than
one block's documents or one bucket's keys, however often a key occurs: a block
asks about it once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefeed.llm.words import U

#: Rows per block, and about how many blocks' keys make a bucket.
BLOCK_ROWS, BLOCKS_PER_BUCKET, LEAST_BUCKETS = 1024, 2, 64

QUESTION = "bucket int, block int, part int, packed binary"


def pack(keys: np.ndarray, *values: np.ndarray) -> bytes:
    """Ascending keys and values of the same length, all unsigned 64-bit numbers."""
    columns = [np.diff(keys, prepend=U(0)), *[v.astype(np.uint64) for v in values]]
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(packed: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    parts = raw.reshape(columns, 8, -1)
    found = [np.ascontiguousarray(p.T).view(np.uint64).ravel() for p in parts]
    return [np.cumsum(found[0], dtype=np.uint64), *found[1:]]


def in_blocks(documents: DataFrame, *by: str) -> tuple[DataFrame, int]:
    """The documents with their block number, and the number of buckets for their keys."""
    n = max(1, -(-documents.count() // BLOCK_ROWS))
    block = F.pmod(F.xxhash64(*by, F.lit(5)), F.lit(n)).cast("int")
    return documents.withColumn("block", block), max(LEAST_BUCKETS, n // BLOCKS_PER_BUCKET)


def questions(block: int, part: int, buckets: int, keys: np.ndarray, *values: np.ndarray) -> pa.Table:
    """Rows of the exchange from ascending keys; a bucket is a range of keys."""
    edges = (np.arange(buckets + 1, dtype=object) * (1 << 64) // buckets)[1:-1].astype(np.uint64)
    cuts = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
    full = np.flatnonzero(np.diff(cuts))
    packed = [pack(*[c[cuts[b] : cuts[b + 1]] for c in (keys, *values)]) for b in full]
    return pa.table(
        {
            "bucket": pa.array(full, pa.int32()),
            "block": pa.array(np.full(len(full), block), pa.int32()),
            "part": pa.array(np.full(len(full), part), pa.int32()),
            "packed": pa.array(packed, pa.binary()),
        }
    )


def gathered(table: pa.Table, columns: int) -> tuple[list[np.ndarray], np.ndarray, list[int]]:
    """Keys and values of a bucket, ascending by key, the row of each, and rows' sizes."""
    rows = [unpack(p.as_py(), columns) for p in table["packed"]]
    sizes = [len(r[0]) for r in rows]
    merged = [np.concatenate(c) for c in zip(*rows, strict=True)]
    order = np.argsort(merged[0], kind="stable")
    owner = np.repeat(np.arange(len(rows)), sizes)
    return [c[order] for c in merged], owner[order], sizes


def answer(asked: DataFrame, columns: int, reply: Callable) -> DataFrame:
    """Answers per bucket: those keys that ``reply`` selects go back to the blocks that asked.

    ``reply`` gets the keys and values of all blocks, ascending by key, and
    returns a mask and the values to send back with the keys.
    """

    def work(table: pa.Table) -> pa.Table:
        merged, owner, sizes = gathered(table, columns)
        keep, values = reply(merged)
        owner, key, values = owner[keep], merged[0][keep], [v[keep] for v in values]
        by_row = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[by_row], np.arange(len(sizes) + 1))
        full = np.flatnonzero(np.diff(cuts))
        chosen = [by_row[cuts[r] : cuts[r + 1]] for r in full]
        packed = [pack(key[c], *[v[c] for v in values]) for c in chosen]
        named = {n: table[n].take(full) for n in ("bucket", "block", "part")}
        return pa.table({**named, "packed": pa.array(packed, pa.binary())})

    return asked.groupBy("bucket", "part").applyInArrow(work, QUESTION)


def received(table: pa.Table, part: int, columns: int) -> list[np.ndarray]:
    """A block's answers of one part, ascending by key."""
    of_part = table.filter(pc.equal(table["part"], part))
    rows = [unpack(p.as_py(), columns) for p in of_part.sort_by("bucket")["packed"]]
    if not rows:
        return [np.zeros(0, np.uint64) for _ in range(columns)]
    return [np.concatenate(c) for c in zip(*rows, strict=True)]


def heads(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])


def spread(values: np.ndarray, first: np.ndarray, total: int) -> np.ndarray:
    """One value per run, repeated for each member."""
    return np.repeat(values, np.diff(np.append(first, total)))


def look_up(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Position of each key in an ascending table, -1 if it is absent."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)

