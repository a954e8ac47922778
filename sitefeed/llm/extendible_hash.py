"""Exact dedup over an extendible-hash index on shared files, DataFrame operations only.

The key of a text is a 63-bit hash of it with every run of blanks as one space.
A directory of 2^depth pointers, one for every value of a key's leading bits, leads
to buckets. A bucket that holds more than ``CAPACITY`` keys splits on the next bit;
where its own depth was the directory's, the directory doubles. The directory starts
at the depth that the number of keys asks for, so few rounds of splitting follow, and
each looks at the overfull buckets' keys only. Rows of one key can't be split by any
bit: they were counted together before, so they are one entry of their bucket.

Entries are written to the shared folder in key order; the tasks that write and
number them own a range of keys each. Bytes decide what is equal: the texts of a key
are compared with each other, after the copies a task reads have been put together.
Where a key has several texts, they form its chain, numbered by their least doc_id, and
the rows of that key look for their own text in the chain.

A document asks the directory for its bucket and the bucket for its key. Copies are
never gathered: a text shared by a third of all rows is one row per task in every
shuffle of texts, and a join of narrow rows with one entry, which may be split.

Null counts as an empty text, and an empty text is one like any other; very long
texts are compared whole. Of equal texts the least doc_id stays, of rows that repeat
it exactly one; a missing doc_id comes after all others. Extra columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitefeed.runtime import discard, materialize

#: Keys that a bucket holds before it splits; bits of a key.
CAPACITY, KEY_BITS = 4096, 63


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def hash_key(text: Column, bits: int = KEY_BITS) -> Column:
    """The leading ``bits`` of the hash, as the leading bits of a 63-bit number."""
    key = F.shiftrightunsigned(F.xxhash64(text), 1)
    return key if bits == KEY_BITS else key.bitwiseAND(F.lit((1 << KEY_BITS) - (1 << (KEY_BITS - bits))))


def _prefix(depth: int) -> Column:
    """A key's leading bits: the place of its pointer in a directory of that depth."""
    return F.shiftrightunsigned("key", KEY_BITS - depth) if depth else F.lit(0).cast("bigint")


@dataclass(frozen=True)
class Index:
    """The directory (pointer, bucket, depth) of ``depth`` bits, and the entries of all buckets.

    Entries: bucket, key, chain, keep_id, keep_row, group_size. ``texts`` has the
    text of those entries whose key has several.
    """

    depth: int
    directory: DataFrame
    entries: DataFrame
    texts: DataFrame


def grow_directory(keys: DataFrame, capacity: int = CAPACITY, bits: int = KEY_BITS) -> tuple[int, DataFrame]:
    """Depth and pointers (pointer, bucket, depth) for a table of distinct keys.

    A bucket's number has a one before its prefix, so prefixes of any length differ.
    """
    depth, n = 0, keys.count()
    while depth < bits and n > capacity << depth:
        depth += 1
    made, still, written = [], keys.select("key"), []
    while True:
        sizes = still.groupBy(_prefix(depth).alias("prefix")).agg(F.count("*").alias("n"))
        sizes = materialize(sizes, "bucket-sizes")
        written.append(sizes)
        overfull = sizes.where(F.col("n") > capacity)
        # Keys that agree in all their bits stay together, however many they are.
        last = depth == bits or overfull.isEmpty()
        made.append((depth, sizes if last else sizes.where(F.col("n") <= capacity)))
        if last:
            break
        still = still.join(overfull.select("prefix"), _prefix(depth) == F.col("prefix"), "left_semi")
        depth += 1

    def pointers(own: int, buckets: DataFrame) -> DataFrame:
        wide = 1 << (depth - own)
        first = F.col("prefix") * F.lit(wide)
        return buckets.select(
            F.explode(F.sequence(first, first + F.lit(wide - 1))).alias("pointer"),
            (F.col("prefix") + F.lit(1 << own)).alias("bucket"),
            F.lit(own).alias("depth"),
        )

    out = pointers(*made[0])
    for own, buckets in made[1:]:
        out = out.unionByName(pointers(own, buckets))
    out = materialize(out, "directory")
    discard(*written)
    return depth, out


def _placed(rows: DataFrame, depth: int, directory: DataFrame) -> DataFrame:
    """The rows with the bucket that the directory names for their key."""
    asked = rows.withColumn("pointer", _prefix(depth))
    return asked.join(directory.select("pointer", "bucket"), "pointer").drop("pointer")


def _first(rows: DataFrame, *by: str) -> DataFrame:
    """Per group: least doc_id, one of its rows, number of rows."""
    row = F.coalesce(F.min_by("row", "doc_id"), F.min("row"))
    return rows.groupBy(*by).agg(F.min("doc_id").alias("keep_id"), row.alias("keep_row"), F.count("*").alias("group_size"))


def build_index(documents: DataFrame, rows: DataFrame, capacity: int = CAPACITY, bits: int = KEY_BITS) -> tuple[Index, DataFrame]:
    """The index of all texts, and the rows (doc_id, row, text) whose key has several texts.

    ``rows``: doc_id, row, key of every document, written before.
    """
    firsts = materialize(_first(rows, "key"), "keys")
    depth, directory = grow_directory(firsts, capacity, bits)
    texts = documents.select(normalised("text").alias("norm"))
    # Equal bytes of a key meet here; a task's copies are one row before the shuffle.
    several = (
        texts.groupBy(hash_key(F.col("norm"), bits).alias("key"), "norm").agg(F.lit(1).alias("one"))
        .groupBy("key").agg(F.count("*").alias("n_texts")).where(F.col("n_texts") > 1).select("key")
    )
    several = materialize(several, "chained-keys")
    chained = documents.select("doc_id", normalised("text").alias("norm"))
    chained = chained.withColumn("key", hash_key(F.col("norm"), bits)).join(several, "key", "left_semi")
    chained = materialize(chained.withColumn("row", F.monotonically_increasing_id()), "chained-rows")
    links = materialize(_first(chained, "key", "norm"), "chained-texts")
    alone = firsts.join(several, "key", "left_anti")
    every = alone.unionByName(links.drop("norm"))
    order = Window.partitionBy("bucket", "key").orderBy(F.col("keep_id").asc_nulls_last(), "keep_row")
    entries = (
        _placed(every, depth, directory)
        .repartitionByRange("bucket", "key")
        .withColumn("chain", (F.row_number().over(order) - 1).cast("int"))
    )
    entries = materialize(entries.select("bucket", "key", "chain", "keep_id", "keep_row", "group_size"), "index")
    return Index(depth, directory, entries, links), chained


def look_up(rows: DataFrame, index: Index) -> DataFrame:
    """The rows with the entry of their key: by directory, bucket and key. Keys with a chain have no row."""
    chained = index.texts.select("key").distinct()
    heads = index.entries.where(F.col("chain") == 0).drop("chain").join(chained, "key", "left_anti")
    return _placed(rows, index.depth, index.directory).join(heads, ["bucket", "key"])


def look_up_chained(rows: DataFrame, index: Index) -> DataFrame:
    """The rows (key, norm, ...) with the entry of their own text in their key's chain."""
    return rows.join(index.texts, ["key", "norm"])


def exact_duplicates(documents: DataFrame, capacity: int = CAPACITY, bits: int = KEY_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    documents = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = documents.select("doc_id", normalised("text").alias("norm")).select(
        "doc_id", hash_key(F.col("norm"), bits).alias("key"), F.unhex(F.sha2("norm", 256)).alias("sha")
    )
    rows = materialize(keyed.withColumn("row", F.monotonically_increasing_id()), "keyed")
    index, chained = build_index(documents, rows.select("doc_id", "row", "key"), capacity, bits)
    found = look_up(rows, index).drop("bucket", "key")
    own = chained.withColumn("sha", F.unhex(F.sha2("norm", 256)))
    found = found.unionByName(look_up_chained(own, index).drop("norm", "key"))
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


#: Needs a view documents.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) keep_id, count(*) OVER (PARTITION BY norm) group_size,
  row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 kept, sha256(norm) text_sha256
FROM d
"""
