"""Operator 12: vectors as codes of codebook entries, nearest entries by memoised grid cells.

Components become integers ``floor(1024 * x)``, so every sum and distance is exact and
does not depend on how Spark deals rows out. Vectors are cut into equal parts; every
part position has a codebook, which starts as that part of the first vectors (by id)
and is refined for some rounds: parts go to their nearest entry (squared distance, ties
to the lower index), entries become the rounded-down mean of their parts.

The nearest entry of a part is found over a grid. Its coarse cell is hashed; the first
part seen in a cell has the least and greatest distance of every entry to the cell's box
computed, and the entries whose least distance is not above the smallest greatest
distance are remembered: no other entry can be nearest anywhere in the box. Parts of the
cell are compared with those entries only, exactly. The cells' side is half the spread
of the codebook's components. Equal and close parts share a cell; the memory of a task
holds at most ``CELLS`` cells for each part position and starts anew when it is full.

A round is one pass over the table; tasks send sums and counts by entry, which Spark adds
up, so the driver gets one row an entry. Nothing else but the start vectors and the
table's dimension (one row each) reaches the driver.

Rows whose vector is null, empty or holds null or non-finite components are dropped; so
are vectors whose length is not the table's dimension, which is the commonest length that
the number of parts divides (ties: the greater). Integers beyond 2**26 in size are set to
that bound, so that distances stay exact. Null ids come last in the order of start
vectors, repeated ids are ordered by their vectors. A table of fewer vectors than entries
has smaller codebooks; an empty one gives an empty result. Repeated rows are coded each.
Outputs replace kept columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelens.llm.tables import map_rows, slices

SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Largest size of an integer component.
BOUND = 1 << 26
#: Cells that a task remembers for a part position.
CELLS = 1 << 15
#: Rows of one numpy step.
STEP = 1024


class Codebook:
    """The entries of one part position and what is known of the grid's cells."""

    def __init__(self, entries: np.ndarray, cells: int = CELLS):
        self.entries = entries
        self.side = max(1, int(entries.std() / 2)) if entries.size else 1
        self.limit = cells
        self.cells: dict[bytes, np.ndarray] = {}

    def undominated(self, cells: np.ndarray) -> np.ndarray:
        """For each cell the entries that may be nearest to some point of its box."""
        least = np.zeros((len(cells), len(self.entries)), np.int64)
        greatest = np.zeros_like(least)
        for low, entry in zip((cells * self.side).T, self.entries.T):
            below = low[:, None] - entry[None, :]
            above = -below - (self.side - 1)
            np.maximum(below, above, out=above)  # over 0: outside of the box by so much
            outside = np.maximum(above, 0)
            least += outside * outside
            farthest = np.maximum(np.abs(below), np.abs(below + (self.side - 1)))
            greatest += farthest * farthest
        return least <= greatest.min(axis=1)[:, None]

    def candidates(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The remembered entries of every part: how many, and all of them one after the other."""
        cells = np.floor_divide(parts, self.side)
        keys = np.ascontiguousarray(cells).view(np.dtype((np.void, cells.shape[1] * 8))).ravel()
        _, firsts, of = np.unique(keys, return_index=True, return_inverse=True)
        names = [keys[k].tobytes() for k in firsts]
        new = [k for k, name in enumerate(names) if name not in self.cells]
        if len(self.cells) + len(new) > self.limit:
            self.cells.clear()
            new = range(len(names))
        for start in range(0, len(new), 256):
            some = new[start:start + 256]
            for k, mask in zip(some, self.undominated(cells[firsts[list(some)]])):
                self.cells[names[k]] = np.flatnonzero(mask)
        found = [self.cells[name] for name in names]
        lists = [found[k] for k in of]
        return np.fromiter(map(len, lists), np.int64, len(lists)), np.concatenate(lists)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of each part's nearest entry."""
        counts, entries = self.candidates(parts)
        off = np.repeat(parts, counts, axis=0) - self.entries[entries]
        distances = np.einsum("ij,ij->i", off, off)
        starts = np.cumsum(counts) - counts
        best = np.minimum.reduceat(distances, starts)
        # candidates ascend, so the first at the least distance has the lowest index
        hits = np.flatnonzero(distances == np.repeat(best, counts))
        return entries[hits[np.searchsorted(hits, starts)]], best


@dataclass(frozen=True)
class Codebooks:
    """``entries``: integers of shape (part, entry, position)."""

    entries: np.ndarray

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _integers(column: pa.Array, dimension: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat * SCALE), -BOUND, BOUND).astype(np.int64).reshape(-1, dimension)


def dimension(df: DataFrame, vector: str, parts: int) -> int:
    """The commonest length of usable vectors that ``parts`` divides; 0 if there is none."""
    sizes = usable(df, vector).groupBy(F.size(vector).alias("n")).count().filter((F.col("n") > 0) & (F.col("n") % parts == 0))
    most = sizes.orderBy(F.desc("count"), F.desc("n")).first()
    return most["n"] if most else 0


def usable(df: DataFrame, vector: str) -> DataFrame:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.filter(F.col(vector).isNotNull() & finite)


def _sums(entries: np.ndarray, vector: str):
    parts, _, width = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(e) for e in entries]
        totals = np.zeros((parts, entries.shape[1], width), np.int64)
        counts = np.zeros((parts, entries.shape[1]), np.int64)
        for batch in slices(batches, STEP):
            rows = _integers(batch.column(0), parts * width)
            for p, book in enumerate(books):
                own = rows[:, p * width:(p + 1) * width]
                index, _ = book.nearest(own)
                np.add.at(totals[p], index, own)
                counts[p] += np.bincount(index, minlength=entries.shape[1])
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()),
            "n": pa.array(counts[part, entry], pa.int64()),
            "sums": pa.array(list(totals[part, entry]), pa.list_(pa.int64()))})

    return run


def fit(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES,
        rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of ``df``: its first ``entries`` vectors, refined over all rows for ``rounds`` rounds."""
    size = dimension(df, vector, parts)
    if not size:
        return Codebooks(np.zeros((parts, 0, 0), np.int64))
    kept = usable(df, vector).filter(F.size(vector) == size)
    first = kept.orderBy(F.asc_nulls_last(vec_id), vector).limit(entries).select(vector).toArrow()
    start = np.concatenate([_integers(c, size) for c in first.column(0).chunks])
    width = size // parts
    books = start.reshape(len(start), parts, width).transpose(1, 0, 2).copy()
    fields = [T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("n", T.LongType()),
              T.StructField("sums", T.ArrayType(T.LongType()))]
    for _ in range(rounds):
        partial = map_rows(kept.select(vector), _sums(books, vector), fields)
        added = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(width)])
        for row in added.collect():  # at most one row an entry
            books[row["part"], row["entry"]] = [row[f"s{d}"] // row["n"] for d in range(width)]
    return Codebooks(books)


def encode(df: DataFrame, books: Codebooks, vector: str = "embedding", keep: Sequence[str] = ("vec_id", "label")) -> DataFrame:
    """``keep`` and ``code`` (two hex digits a part, more for codebooks over 256 entries), ``error`` of every usable vector."""
    entries = books.entries
    parts, count, width = entries.shape
    kept = [c for c in keep if c not in ("code", "error")]
    digits = max(2, len(f"{max(count - 1, 0):x}"))
    rows = usable(df, vector).filter(F.size(vector) == F.lit(parts * width) if count else F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Codebook(e) for e in entries]
        for batch in slices(batches, STEP):
            own = _integers(batch.column(batch.num_columns - 1), parts * width)
            near = [book.nearest(own[:, p * width:(p + 1) * width]) for p, book in enumerate(found)]
            codes = ["".join(f"{k:0{digits}x}" for k in row) for row in zip(*(n[0].tolist() for n in near))]
            out = {c: batch.column(k) for k, c in enumerate(kept)}
            yield pa.RecordBatch.from_pydict(out | {"code": pa.array(codes, pa.string()),
                                                    "error": pa.array(sum(n[1] for n in near), pa.int64())})

    fields = [df.schema[c] for c in kept] + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    return map_rows(rows.select(*kept, F.col(vector)), run, fields)


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """Add ``label_error``: ``error`` summed over equal labels, nulls together.

    Sums are combined before the shuffle; the table of labels is broadcast if its measured size allows, else joined with
    hot labels split off. ``coded`` should be a written table.
    """
    from notelens.operators.scale import lookup_join

    key = F.concat(F.when(F.col(label).isNull(), "n").otherwise("v"), F.coalesce(F.col(label).cast("string"), F.lit("")))
    keyed = coded.withColumn("_label", key)
    sums = keyed.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n"))
    return lookup_join(keyed, sums, "_label", "left", weight="_n").drop("_label", "_n")
