"""Vector codes by parts, with nearest entries looked up through memoised grid cells.

Vectors become integers, floor(scale * x), and are cut into equal consecutive parts.  Every
part position has a codebook of entries.  A round of fitting assigns each part to the nearest
entry of its codebook (squared distance, ties to the lower index) and replaces the entries by
the floored means of their parts; tasks add up sums and counts, Spark adds up the tasks'.

Nearest entries come from a cache.  A part's coarse cell is its components shifted right; for
every cell met, the task keeps the entries that are not dominated there: an entry whose
least distance to the cell's box is above another entry's greatest distance to it is never
nearest inside the box.  Only entries that are kept are evaluated exactly.  Cells are found by a
64-bit hash and compared; a part whose cell is another one of equal hash is evaluated with all entries.
The width of cells is a power of two, ``1 / FINENESS`` of the codebook's spread or less.

The driver holds codebooks (PARTS * ENTRIES entries) and their sums; nothing else leaves
the tasks.  A task's cache has ``MAX_CELLS`` cells per part position at most and then starts anew, which
changes no result.  A pass reads the table once; nothing is shuffled but sums and labels.

Defined results: a vector that is null or holds a null or a component that is not finite takes
no part; shorter vectors count as continued by zeros, to a multiple of the number of parts; a null
id counts as the greatest; rows that share an id are rows of their own, in the order of their
vectors where entries are chosen; equal vectors get equal codes; with fewer rows than entries there are fewer entries, an
empty table gives an empty result; components beyond ±1e30 are cut off there, and errors at 64 bits;
further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskweave.llm.common import cut, mix64
from maskweave.operators.joins import MAX_BROADCAST_ROWS, hot_split_join

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
FINENESS = 2
MAX_CELLS = 1 << 16
#: Rows whose parts are looked up at once.
STEP_ROWS = 4096
#: Components up to here have squared distances within 64 bits.
SAFE = 1 << 26
LARGEST = 1e30
MAX_LONG = 2**63 - 1


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """(id, label, vector) of the rows that take part."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    rows = vectors.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.filter(F.col("vector").isNotNull() & ~F.coalesce(bad, F.lit(False)))


def integers(column: pa.Array, width: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of every vector, continued by zeros to ``width``; Python integers where 64 bits may not hold."""
    lengths = column.value_lengths().to_numpy().astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = flat
    out = np.floor(np.clip(out, -LARGEST, LARGEST) * scale)
    if not out.size or np.abs(out).max() < SAFE:
        return out.astype(np.int64)
    return np.frompyfunc(int, 1, 1)(out)


class Cells:
    """The entries of one codebook that can be nearest, by coarse cell."""

    def __init__(self, entries: np.ndarray, max_cells: int = MAX_CELLS) -> None:
        self.entries, self.max_cells = entries, max_cells
        spread = int(entries.max() - entries.min()) if entries.size else 0
        self.shift = max(0, (spread // FINENESS).bit_length() - 1)
        self.clear()

    def clear(self) -> None:
        self.slots: dict[int, int] = {}
        self.cells = np.zeros((0, self.entries.shape[1]), self.entries.dtype)
        self.kept = np.zeros((0, len(self.entries)), bool)

    def undominated(self, cells: np.ndarray) -> np.ndarray:
        """Per cell, whether each entry may be nearest somewhere in its box."""
        low = (cells << self.shift)[:, None, :]
        high = low + ((1 << self.shift) - 1)
        below, above = low - self.entries, self.entries - high
        nearest = (np.maximum(np.maximum(below, above), 0) ** 2).sum(axis=2)
        farthest = (np.maximum(abs(below), abs(above)) ** 2).sum(axis=2)
        return nearest <= farthest.min(axis=1)[:, None]

    def assign(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the nearest entry, squared distance) of every part."""
        if len(self.slots) > self.max_cells:
            self.clear()
        cells = parts >> self.shift
        hashed = np.zeros(len(parts), np.uint64)
        for j in range(parts.shape[1]):
            hashed = mix64(hashed + (cells[:, j] & 0xFFFFFFFF).astype(np.uint64) + np.uint64(1))
        keys, first, which = np.unique(hashed, return_index=True, return_inverse=True)
        fresh = [i for i, k in enumerate(keys.tolist()) if k not in self.slots]
        if fresh:
            self.slots.update(zip(keys[fresh].tolist(), range(len(self.slots), len(self.slots) + len(fresh))))
            new = cells[first[fresh]]
            self.cells = np.concatenate([self.cells, new])
            self.kept = np.concatenate([self.kept, self.undominated(new)])
        slot = np.fromiter(map(self.slots.__getitem__, keys.tolist()), np.int64, len(keys))[which]
        kept = self.kept[slot]
        kept[(self.cells[slot] != cells).any(axis=1)] = True  # another cell of equal hash
        row, entry = np.nonzero(kept)
        distance = ((parts[row] - self.entries[entry]) ** 2).sum(axis=1)
        begins = np.searchsorted(row, np.arange(len(parts)))
        least = np.minimum.reduceat(distance, begins)
        hits = np.flatnonzero(distance == least[row])
        nearest = hits[np.searchsorted(row[hits], np.arange(len(parts)))]  # the lowest index of equal ones
        return entry[nearest], least


def _assigned(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, integers, codes, distances) with one row of the last three per vector, cut into parts."""
    tables = [Cells(b) for b in books]
    width = books[0].shape[1]
    for b in batches:
        for at in range(0, b.num_rows, STEP_ROWS):
            some = b.slice(at, STEP_ROWS)
            parts = integers(some.column("vector"), len(books) * width, scale).reshape(some.num_rows, len(books), width)
            found = [t.assign(parts[:, p]) for p, t in enumerate(tables)]
            yield some, parts, np.column_stack([f[0] for f in found]), np.column_stack([f[1] for f in found])


def first_books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> list[np.ndarray]:
    """The codebooks of the smallest ids' vectors; none for an empty table."""
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return []
    width = max(1, -(-longest // parts))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    start = integers(pa.array([r[0] for r in first], pa.list_(pa.float64())), parts * width, scale)
    return [start[:, p * width : (p + 1) * width] for p in range(parts)]


def fit(rows: DataFrame, rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> list[np.ndarray]:
    """The codebooks, one array (entry, component) per part position, after ``rounds`` rounds over ``usable`` rows."""
    books = first_books(rows, parts, entries, scale)
    for _ in range(rounds if books else 0):

        def run(batches: Iterator[pa.RecordBatch], books: list[np.ndarray] = books) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros(b.shape, object) for b in books]
            counts = [np.zeros(len(b), np.int64) for b in books]
            for _, values, codes, _ in _assigned(batches, books, scale):
                for p in range(len(books)):
                    for e in np.unique(codes[:, p]).tolist():
                        own = values[codes[:, p] == e, p]
                        sums[p][e] += own.sum(axis=0)
                        counts[p][e] += len(own)
            rows_ = [(p, e, j, int(counts[p][e]), int(s)) for p, e in zip(*np.nonzero(np.array(counts))) for j, s in enumerate(sums[p][e])]
            columns = list(zip(*rows_)) if rows_ else [()] * 5
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["part", "entry", "place", "n", "total"])

        totals = rows.mapInArrow(run, "part int, entry int, place int, n long, total decimal(38, 0)")
        totals = totals.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
        new = [b.astype(object) for b in books]
        for r in totals.collect():  # one row per component of the codebooks
            new[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
        books = [b.astype(np.int64) if abs(b).max() < SAFE else b for b in new]
    return books


def encode(rows: DataFrame, books: list[np.ndarray], scale: int = SCALE) -> DataFrame:
    """Per ``usable`` row: id, label, code (two hex digits per part) and error (sum of squared distances)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not books:
            return
        for b, _, codes, distances in _assigned(batches, books, scale):
            text = codes.astype(np.uint8).tobytes().hex()
            size = 2 * len(books)
            code = [text[i : i + size] for i in range(0, len(text), size)]
            error = [min(int(e), MAX_LONG) for e in distances.sum(axis=1).tolist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["id", "label", "code", "error"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.mapInArrow(run, f"id {types['id']}, label {types['label']}, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()


def compress_vectors(vectors: DataFrame) -> DataFrame:
    """The contract's columns: vec_id, code, error, label_error, codebooks_sha256."""
    rows = usable(vectors)
    books = fit(rows)
    coded = encode(rows, books)
    coded = cut(coded.withColumn("key", F.coalesce(F.col("label").cast("string"), F.lit(""))).withColumn("none", F.col("label").isNull()), "grid-codes")
    totals = cut(coded.groupBy("key", "none").agg(F.sum("error").alias("label_error")), "grid-labels")
    if totals.count() <= MAX_BROADCAST_ROWS:
        found = coded.join(F.broadcast(totals), ["key", "none"])
    else:  # too many labels: the few that hold many rows apart
        found = hot_split_join(coded, totals, ["key", "none"])
    return found.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql(width: int = 8) -> str:
    part = lambda i: f"sum(v[{i}])"
    square = " + ".join(f"(x.v[{i}] - b.v[{i}]) * (x.v[{i}] - b.v[{i}])" for i in range(1, width + 1))
    mean = ", ".join(f"CAST(floor({part(i)} / count(*)) AS BIGINT)" for i in range(1, width + 1))
    nearest = "(SELECT x.vec_id, x.p, any_value(x.v) AS v, min(({d}) * 16 + b.c) AS m FROM parts x JOIN cb{r} b ON x.p = b.p GROUP BY x.vec_id, x.p)"
    steps = [
        f"""cb{r + 1} AS MATERIALIZED (
  SELECT b.p, b.c, coalesce(n.v, b.v) AS v FROM cb{r} b LEFT JOIN (
    SELECT p, CAST(m % 16 AS INTEGER) AS c, [{mean}] AS v FROM {nearest.format(d=square, r=r)} GROUP BY ALL) n ON n.p = b.p AND n.c = b.c)"""
        for r in range(ROUNDS)
    ]
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS MATERIALIZED (SELECT vec_id, CAST(p AS INTEGER) AS p, e[p * {width} + 1 : p * {width} + {width}] AS v FROM kept, range({PARTS}) t(p)),
cb0 AS MATERIALIZED (SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS INTEGER) AS c, v FROM parts QUALIFY c < {ENTRIES}),
{", ".join(steps)},
coded AS MATERIALIZED (
  SELECT vec_id, string_agg(printf('%02x', CAST(m % 16 AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m // 16) AS BIGINT) AS error
  FROM {nearest.format(d=square, r=ROUNDS)} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, c)) FROM cb{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


SQL = _sql()
