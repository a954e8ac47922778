"""Vector codes by product quantisation over memoised grid cells.

Components become integers, vectors are cut into ``PARTS`` equal consecutive parts,
and every part position has a codebook. Finding a part's nearest entry: the part lies
in a coarse cell, a box of the grid of width ``CELL``. The least and the greatest
squared distance between the box and each entry are known from its corners; an entry
whose least distance exceeds another's greatest is nearest to no point of the box.
The entries that are left are remembered under the cell's hash, so the
next part of that cell evaluates only them, exactly, in integers; equal distances go
to the lower index. The memory of cells holds at most ``REMEMBERED`` cells per part
position and starts anew beyond; it changes no result.

Each round is one map-only pass over the integer vectors; tasks send sums and counts
per entry, whose number is fixed by parts, entries and dimensions. Nothing else
leaves a task but its rows.

Vectors that are null or hold null or non-finite components are dropped. Shorter
vectors are read as if filled up with zeros to the longest of the table, and all to a
multiple of ``PARTS``, which changes no distance between vectors of one length.
Components are held within +-``LARGEST`` so that sums of squares stay exact. Repeated vec_ids are
rows of their own; of equal ones the lesser vector comes first in the first codebook,
a missing vec_id comes last. Null labels are one label. With fewer rows than entries,
codebooks are that much smaller. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefeed.llm.common import per_batch, per_task
from sitefeed.llm.words import U, mix
from sitefeed.runtime import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Width of a grid cell in integer steps; cells remembered per part position.
CELL, REMEMBERED = 24, 1 << 16
LARGEST = 1 << 24
#: Rows times entries evaluated at a time.
EVALUATED = 1 << 20


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id, label, v: the integer components of the vectors that are not dropped."""

    def work(batch: pa.RecordBatch):
        vectors = batch.column("v")
        size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(size)
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
        good = vectors.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - size])
        with np.errstate(all="ignore"):
            whole = np.clip(np.floor(np.nan_to_num(flat) * SCALE), -LARGEST, LARGEST).astype(np.int32)
        rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(whole))
        table = pa.table({"vec_id": batch.column("vec_id"), "label": batch.column("label"), "v": rows})
        yield table.filter(pa.array(good))

    named = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    kinds = dict(named.dtypes)
    return per_batch(named, f"vec_id {kinds['vec_id']}, label {kinds['label']}, v array<int>", work)


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled up with zeros to ``width``."""
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), width), np.int64)
    out[np.arange(width) < size[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


class CellMemory:
    """Nearest entries of one part position, for parts as rows of integers."""

    def __init__(self, entries: np.ndarray, cell: int = CELL):
        self.entries, self.cell, self.evaluated = entries, cell, 0
        self.forget()

    def forget(self) -> None:
        """Cells by hash: place in the lists of their coordinates and of their entries."""
        self.place: dict[int, int] = {}
        self.cells: list[np.ndarray] = []
        self.held: list[np.ndarray] = []

    def undominated(self, cells: np.ndarray) -> list[np.ndarray]:
        """For boxes (rows of cell numbers): the entries that may be nearest to some point of the box."""
        out = []
        for some in np.array_split(cells, max(1, len(cells) // 1024)):
            low = some[:, None, :] * self.cell
            high = low + self.cell - 1
            entry = self.entries[None]
            outside = np.maximum(np.maximum(low - entry, entry - high), 0)
            across = np.maximum(np.abs(entry - low), np.abs(entry - high))
            least, greatest = (outside**2).sum(axis=2), (across**2).sum(axis=2)
            out += [np.flatnonzero(row) for row in least <= greatest.min(axis=1, keepdims=True)]
        return out

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and squared distance to it, for each part."""
        if not parts.size:
            return np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        cells = np.floor_divide(parts, self.cell)
        hashed = np.zeros(len(parts), np.uint64)
        for column in cells.T:
            hashed = mix(hashed * U(0x9E3779B97F4A7C15) + column.astype(np.uint64))
        keys, first, of_row = np.unique(hashed, return_index=True, return_inverse=True)
        fresh = [i for i, key in enumerate(keys.tolist()) if key not in self.place]
        if len(self.place) + len(fresh) > REMEMBERED:
            self.forget()
            fresh = list(range(len(keys)))
        self.place.update((int(keys[i]), len(self.held) + n) for n, i in enumerate(fresh))
        if fresh:
            self.cells += list(cells[first[fresh]])
            self.held += self.undominated(cells[first[fresh]])
        places = [self.place[key] for key in keys.tolist()]
        lists = [self.held[p] for p in places]
        # A cell whose hash is another's has no memory: its parts are compared with every entry.
        other = (cells != np.stack([self.cells[p] for p in places])[of_row]).any(axis=1)
        if other.any():
            of_row = np.where(other, len(lists), of_row)
            lists.append(np.arange(len(self.entries)))
        sizes = np.array([len(x) for x in lists])
        begin, flat = np.cumsum(sizes) - sizes, np.concatenate(lists)
        code, error = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
        step = max(1, EVALUATED // int(sizes.max()))
        for at in range(0, len(parts), step):
            some = of_row[at : at + step]
            row = np.repeat(np.arange(len(some)), sizes[some])
            head = np.cumsum(sizes[some]) - sizes[some]
            entry = flat[begin[some][row] + np.arange(len(row)) - head[row]]
            distance = ((parts[at : at + step][row] - self.entries[entry]) ** 2).sum(axis=1)
            self.evaluated += len(row)
            least = np.minimum.reduceat(distance, head)
            # Entries of a cell ascend, so the first equal one has the lowest index.
            hit = np.flatnonzero(distance == least[row])
            code[at : at + step] = entry[hit[np.unique(row[hit], return_index=True)[1]]]
            error[at : at + step] = least
        return code, error


class Assignment:
    """Codes and distances (rows x parts) of integer vectors; cells are remembered from call to call."""

    def __init__(self, books: np.ndarray):
        self.memories, self.width = [CellMemory(b) for b in books], books.shape[2]

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [m.nearest(x[:, p * self.width : (p + 1) * self.width]) for p, m in enumerate(self.memories)]
        return np.stack([c for c, _ in found], axis=1), np.stack([e for _, e in found], axis=1)


def first_books(rows: DataFrame, width: int) -> np.ndarray:
    """Parts x entries x components: the parts of the rows with the smallest vec_ids."""
    chosen = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").toArrow()
    x = matrix(chosen["v"].combine_chunks(), PARTS * width)
    return x.reshape(len(x), PARTS, width).transpose(1, 0, 2)


def refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks with each entry at the floor of the mean of the parts nearest to it."""
    parts, entries, width = books.shape

    def work(batch: pa.RecordBatch, assign: Assignment):
        x = matrix(batch.column(0), parts * width)
        codes, _ = assign(x)
        for p in range(parts):
            used, of_row = np.unique(codes[:, p], return_inverse=True)
            sums = np.zeros((len(used), width), np.int64)
            np.add.at(sums, of_row, x[:, p * width : (p + 1) * width])
            n = np.bincount(of_row)
            yield pa.table({"cell": np.repeat(p * entries + used, width + 1), "at": np.tile(np.arange(width + 1), len(used)), "x": np.hstack([sums, n[:, None]]).ravel()})

    found = per_task(rows.select("v"), "cell bigint, at bigint, x bigint", lambda: Assignment(books), work)
    sums = found.groupBy("cell", "at").agg(F.sum("x").alias("x"))
    out = books.copy()
    found = sums.toArrow()  # at most parts x entries x (width + 1) rows
    table = np.zeros((parts * entries, width + 1), np.int64)
    table[found["cell"].to_numpy(), found["at"].to_numpy()] = found["x"].to_numpy()
    table = table.reshape(parts, entries, width + 1)
    used = table[:, :, width] > 0
    out[used] = np.floor_divide(table[:, :, :width][used], table[:, :, width][used][:, None])
    return out


def compress(embeddings: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that is not dropped."""
    rows = materialize(quantised(embeddings), "integer-vectors")
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // PARTS)
    books = first_books(rows, width)
    for _ in range(rounds if books.shape[1] else 0):
        books = refined(rows, books)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    kinds = dict(rows.dtypes)

    def work(batch: pa.RecordBatch, assign: Assignment):
        codes, errors = assign(matrix(batch.column("v"), PARTS * width))
        text = codes.astype(np.uint8).tobytes().hex()
        yield pa.table({
            "vec_id": batch.column("vec_id"),
            "label": batch.column("label"),
            "code": pa.array([text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)], pa.string()),
            "error": pa.array(errors.sum(axis=1), pa.int64()),
        })

    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint"
    coded = per_task(rows, schema, lambda: Assignment(books), work)
    coded = materialize(coded, "codes")
    totals = coded.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("of_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """Brute force: every part against every entry, round after round. Needs a view embeddings."""

    def assign(n: int) -> str:
        return (
            f"n{n} AS (SELECT rid, p, e, dist FROM (SELECT x.rid, x.p, b.e, list_sum(list_transform(list_zip(x.v, b.v), "
            f"lambda z: (z[1] - z[2]) * (z[1] - z[2]))) dist FROM x JOIN b{n} b USING (p)) "
            "QUALIFY row_number() OVER (PARTITION BY rid, p ORDER BY dist, e) = 1)"
        )

    def refine(n: int) -> str:
        return (
            f"m{n} AS (SELECT p, e, list(s ORDER BY i) v FROM (SELECT p, e, i, CAST(floor(sum(c) / count(*)) AS BIGINT) s FROM "
            f"(SELECT x.p, n.e, unnest(x.v) c, generate_subscripts(x.v, 1) i FROM x JOIN n{n} n USING (rid, p)) GROUP BY ALL) GROUP BY ALL), "
            f"b{n + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) v FROM b{n} b LEFT JOIN m{n} m USING (p, e))"
        )

    steps = ", ".join([assign(0), *[f"{refine(n)}, {assign(n + 1)}" for n in range(ROUNDS)]])
    return (
        f"WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) rid, vec_id, label, "
        f"list_transform(embedding, lambda c: CAST(floor({SCALE} * CAST(c AS DOUBLE)) AS BIGINT)) q FROM embeddings WHERE embedding IS NOT NULL "
        "AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0), "
        f"x AS (SELECT rid, p, list_slice(q, p * len(q) // {PARTS} + 1, (p + 1) * len(q) // {PARTS}) v FROM k, range({PARTS}) r(p)), "
        f"b0 AS (SELECT p, rid - 1 e, v FROM x WHERE rid <= {ENTRIES}), {steps}, "
        f"sums AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) code, CAST(sum(dist) AS BIGINT) error FROM n{ROUNDS} GROUP BY rid), "
        f"books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) codebooks_sha256 FROM b{ROUNDS}) "
        "SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) label_error, codebooks_sha256 FROM sums JOIN k USING (rid), books"
    )


SQL = _sql()
