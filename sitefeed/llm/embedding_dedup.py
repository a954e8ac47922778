"""Embedding near-dedup by PCA-ordered tiled comparison.

Vectors of a label are rotated into the corpus's principal axes, strongest
first. Equal vectors are one unit with a number of copies. The units of a label
are cut into tiles; each pair of tiles is one task's work. A task adds up the
products of the leading axes, a few at a time, and bounds what the remaining
ones can add by the product of the suffix norms; pairs that cannot reach the
threshold any more are left, and once none is open the tile pair is done. Pairs
that stay open to the end are decided by the cosine of the original vectors in
double precision, so neither rotation nor bounds decide a link. A task returns
the number of links of each unit and one link per unit to the least one it
reaches, not the pairs.

Units are tiled by their place on the first axis, and tile pairs further apart
there than linked unit vectors can be are never formed. Groups that lie closer
are compared tile by tile: the work is quadratic in such a group, but no task
holds more than two tiles.

Null, empty or zero vectors, vectors with a null or non-finite number, and rows
without label link with nothing; so do vectors of different lengths. Rows
without vec_id have no links and no component. Repeated rows of one vec_id are
copies of each other. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitefeed.llm.common import per_batch
from sitefeed.llm.graph import components
from sitefeed.llm.ngram_jaccard import least_reached
from sitefeed.runtime import materialize

THRESHOLD = 0.93
#: Units per tile, axes added at a time.
TILE, AXES = 1024, 8
#: Grid on the first axis that tiles are cut along.
CELLS = 1024
#: Slack of the bounds for rounding; links themselves have none.
SLACK = 1e-9


def _is_usable(embeddings: DataFrame) -> Column:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists("embedding", lambda x: x != 0)
    known = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return F.coalesce(known & finite & some, F.lit(False))


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, v: rows that can link, as doubles."""
    return embeddings.where(_is_usable(embeddings)).select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("v"),
    )


def principal_axes(rows: DataFrame, size: int) -> np.ndarray:
    """Axes (columns) of the directions' second moments, strongest first; sums per batch only."""

    def work(batch: pa.RecordBatch):
        x = unit(np.stack(batch.column(0).to_numpy(zero_copy_only=False)))
        yield pa.table({"i": np.arange(size, dtype=np.int32), "row": pa.array((x.T @ x).tolist(), pa.list_(pa.float64()))})

    parts = per_batch(rows.where(F.size("v") == size).select("v"), "i int, row array<double>", work)
    cells = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    moments = np.zeros((size, size))
    for c in cells:
        moments[c.i, c.j] = c.x
    return np.linalg.eigh(moments)[1][:, ::-1].copy()


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so very large and very small numbers stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def close_pairs(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of rotated unit vectors whose product may reach the threshold."""
    rest_a = np.sqrt(np.maximum(np.cumsum((a * a)[:, ::-1], axis=1)[:, ::-1], 0))
    rest_b = np.sqrt(np.maximum(np.cumsum((b * b)[:, ::-1], axis=1)[:, ::-1], 0))
    done = min(AXES, a.shape[1])
    sums = a[:, :done] @ b[:, :done].T
    if done < a.shape[1]:
        bound = sums + rest_a[:, done][:, None] * rest_b[:, done][None, :]
    else:
        bound = sums
    i, j = np.nonzero(bound >= threshold - SLACK)
    sums = sums[i, j]
    while done < a.shape[1] and len(i):
        more = min(done + AXES, a.shape[1])
        sums = sums + np.einsum("ij,ij->i", a[i, done:more], b[j, done:more])
        done = more
        bound = sums + rest_a[i, done] * rest_b[j, done] if done < a.shape[1] else sums
        open_ = bound >= threshold - SLACK
        i, j, sums = i[open_], j[open_], sums[open_]
    return i, j


def _placed(units: DataFrame, size: int, axes: np.ndarray) -> DataFrame:
    """Units with their place on the first axis, and the cell of a fine grid that it lies in."""
    shared = units.sparkSession.sparkContext.broadcast(axes[:, 0].copy())

    def work(batch: pa.RecordBatch):
        place = []
        for v in batch.column(2):
            x = unit(np.array(v.as_py(), float)[None])[0]
            place.append(float(x @ shared.value) if len(x) == size else float(x[0]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "place"])

    kinds = "unit bigint, label string, v array<double>, copies bigint, place double"
    rows = per_batch(units, kinds, work, "unit", "label", "v", "copies")
    return rows.withColumn("size", F.size("v")).withColumn("cell", F.floor((F.col("place") + 1) * CELLS / 2))


def _tiled(placed: DataFrame) -> DataFrame:
    """Units with a tile number; tiles of a label follow the first axis, full cells are split."""
    group = ["label", "size"]
    cells = placed.groupBy(*group, "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*group).orderBy("cell")) - F.col("n")
    cells = cells.select(
        *group, "cell", F.floor(before / TILE).alias("at"), F.ceil(F.col("n") / TILE).alias("parts")
    )
    part = F.pmod(F.xxhash64("unit", F.lit(9)), F.col("parts"))
    return placed.join(cells, [*group, "cell"]).withColumn("tile", (F.col("at") + part).cast("int"))


def _compared(tiled: DataFrame, size: int, axes: np.ndarray, threshold: float) -> DataFrame:
    """Per tile pair and unit: linked rows, least unit reached."""
    shared = tiled.sparkSession.sparkContext.broadcast(axes)
    group = ["label", "size"]
    ranges = materialize(
        tiled.groupBy(*group, "tile").agg(F.min("place").alias("from"), F.max("place").alias("to")), "tiles"
    )
    reach = float(np.sqrt(max(2 - 2 * threshold, 0)) + 1e-6)
    other = ranges.select(*group, F.col("tile").alias("high"), F.col("from").alias("from2"), F.col("to").alias("to2"))
    pairs = ranges.withColumnRenamed("tile", "low").join(other, group)
    pairs = pairs.where(f"low <= high AND from2 - to <= {reach} AND from - to2 <= {reach}").select(*group, "low", "high")
    sides = pairs.select("*", F.col("low").alias("tile"), F.lit(0).alias("side")).unionByName(
        pairs.where("low < high").select("*", F.col("high").alias("tile"), F.lit(1).alias("side"))
    )
    rows = tiled.select(*group, "tile", "unit", "copies", "v").join(sides, [*group, "tile"])

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("unit", "ascending")])
        ids, copies = table["unit"].to_numpy(), table["copies"].to_numpy().astype(np.int64)
        x = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        # Powers of two only: the numbers' digits stay as they are.
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])
        norm = np.sqrt((x * x).sum(axis=1))
        turned = x / norm[:, None]
        turned = turned @ shared.value if x.shape[1] == size else turned
        own = table["low"][0].as_py() == table["high"][0].as_py()
        cut = 0 if own else int(np.searchsorted(table["side"].to_numpy(), 1))
        i, j = close_pairs(turned[: len(ids) if own else cut], turned[cut:], threshold)
        j = j + cut
        i, j = (a[i < j] for a in (i, j)) if own else (i, j)
        cosine = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j])
        i, j = i[cosine >= threshold], j[cosine >= threshold]
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        linked = np.zeros((len(ids), len(ids)), bool)
        linked[i, j] = linked[j, i] = True
        return pa.table({"unit": ids, "links": links.astype(np.int64), "low": least_reached(linked, ids)})

    return rows.groupBy(*group, "low", "high").applyInArrow(compare, "unit bigint, links bigint, low bigint")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    rows = usable(embeddings)
    units = materialize(
        rows.groupBy("label", "v").agg(F.min("vec_id").alias("unit"), F.count("*").alias("copies")), "units"
    )
    common = units.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").first()
    size = common["size"] if common else 1
    axes = principal_axes(units, size)
    tiled = materialize(_tiled(_placed(units, size, axes)), "tiled")
    found = materialize(_compared(tiled, size, axes, threshold), "compared")
    links = found.groupBy("unit").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("unit").alias("a"), F.col("low").alias("b")))
    results = (
        units.join(links, "unit", "left")
        .join(reached.withColumnRenamed("node", "unit"), "unit", "left")
        .select("label", "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
                F.coalesce("component", "unit").alias("component"))
    )
    linked = rows.join(results, ["label", "v"]).select("vec_id", "links", "component")
    named = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", "embedding")
    rest = named.select("vec_id", _is_usable(named).alias("_ok")).where(~F.col("_ok"))
    alone = rest.select("vec_id", F.lit(0).cast("bigint").alias("links"), F.col("vec_id").alias("component"))
    return linked.unionByName(alone).select(
        "vec_id",
        F.col("links").alias("n_links"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component"), F.lit(True)).alias("kept"),
    )


#: All pairs of a label by brute force, then the closure of the links.
SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) v FROM embeddings),
link AS (SELECT x.vec_id a, y.vec_id b FROM e x JOIN e y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM e UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) n_links, c.component_id, vec_id = c.component_id kept
FROM e JOIN (SELECT a, min(b) component_id FROM reach GROUP BY a) c ON c.a = vec_id
"""
