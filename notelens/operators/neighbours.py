"""Nearest neighbours by cosine, of every vector among all vectors.

Equal vectors are one point, so a vector with very many copies is compared once; a point
keeps the ids that can be among the first. Points go to the cells of coarse centroids,
which a bounded sample of points gives (``SAMPLE``); every point is indexed. A query
visits cells in the order of their centroids' distance. Near cells form groups, and a group
and the queries that visit any of its cells meet in blocks of bounded size, so neither a
large cell nor a popular one is one task. A query's vector moves once for a group and not
once for a cell, with a bit for every cell it visits; in a block each cell meets its own
visitors only, in matrix products. Up to ``PARTS * BLOCK`` points the groups are about
``PARTS``, so what is shuffled grows as the points do, however many cells are visited.
There is no product of all points: a search visits
``probes`` cells, found on a bounded sample of queries for a wanted recall, and
``exact_neighbours`` goes on to those cells only that the triangle inequality
leaves: a cell with all its points within ``radius`` of its centroid cannot hold a nearer
point than the distance to the centroid less the radius.

Cosines are rounded to ``DIGITS`` digits before they are ranked; ties go to the smaller id.
Rows without an id, and vectors that are null, zero, of another than the commonest length
or hold null or non-finite values, have no neighbours and are nobody's. Ids are taken to
be unique; repeated rows count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelens.operators.scale import first_k_in_group, lookup_join, stage

#: Points that centroids are made from, queries that the number of probes is found on.
SAMPLE, TUNED = 8192, 256
#: Most cells; their centroids are sent to every task.
MAX_CELLS = 4096
#: Points of a group of cells, or queries that visit it, in one block; the numbers in the vectors of either.
BLOCK, NUMBERS = 65_536, 1 << 23
#: Blocks that the points are cut into, about, as long as these are not full.
PARTS = 12
#: Queries of a block that are looked at together.
CHUNK = 512
DIGITS = 6
#: Distances may be off by so much, by rounding.
SLACK = 1e-5


@dataclass(frozen=True)
class Index:
    """``points(digest, ids, vec, cell)``: ``ids`` are the first of the ids with that vector, ``vec`` is as it was given.

    ``groups`` tells the group of every cell, ``block`` how many points or queries make a block.
    """

    points: DataFrame
    rows: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray
    radii: np.ndarray
    groups: np.ndarray
    block: int
    k: int


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _unit(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    vectors = _matrix(column)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    square = (vectors**2).sum(1)[:, None] + (centroids**2).sum(1)[None] - 2 * vectors @ centroids.T
    return np.sqrt(np.maximum(square, 0))


def _centroids(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    found = sample[:cells].copy()
    for _ in range(rounds):
        near = _distances(sample, found).argmin(1)
        sums = np.zeros_like(found)
        np.add.at(sums, near, sample)
        counts = np.bincount(near, minlength=len(found))
        found[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return found


def _groups(centroids: np.ndarray, sizes: np.ndarray, block: int) -> np.ndarray:
    """The group of every cell: from cell to nearest cell, as long as a group has ``block`` points at most; a larger cell is alone."""
    groups, left = np.zeros(len(centroids), np.int32), np.ones(len(centroids), bool)
    cell = number = filled = 0
    while left.any():
        if filled and filled + sizes[cell] > block:
            number, filled = number + 1, 0
        groups[cell], left[cell] = number, False
        filled += sizes[cell]
        rest = np.flatnonzero(left)
        cell = rest[_distances(centroids[cell:cell + 1], centroids[rest])[0].argmin()] if len(rest) else 0
    return groups


def usable(df: DataFrame, key: str, vec: str) -> DataFrame:
    """``key``, ``vec``, ``digest`` of the rows that take part."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    good = df.filter(F.col(key).isNotNull() & F.col(vec).isNotNull() & F.forall(vec, number) & F.exists(vec, lambda x: x != 0))
    size = good.groupBy(F.size(vec).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    kept = good.filter(F.size(vec) == F.lit(size["n"] if size else 0))
    return kept.select(F.col(key).alias("key"), F.col(vec).alias("vec"), F.md5(F.col(vec).cast("string").cast("binary")).alias("digest"))


def build_index(df: DataFrame, key: str, vec: str, k: int = 5, cells: int | None = None) -> Index:
    """An index of all usable rows; ``cells``: about the root of the number of points, if not given."""
    rows = stage(usable(df, key, vec), "vectors")
    first = first_k_in_group(rows.select("digest", "key").distinct(), ["digest"], ["key"], k + 1)
    heads = stage(first.groupBy("digest").agg(F.array_sort(F.collect_list("key")).alias("ids")), "heads")
    own = rows.withColumnRenamed("digest", "own").dropDuplicates(["key", "own"])
    points = heads.join(own, (own["key"] == F.get("ids", 0)) & (own["own"] == heads["digest"])).select("digest", "ids", "vec")
    points = stage(points, "points")
    total = points.count()
    drawn = points.orderBy(F.xxhash64("digest")).limit(SAMPLE).select("vec").toArrow()
    if not total:
        return Index(points.withColumn("cell", F.lit(0)), rows, np.zeros((0, 1)), np.zeros(0, int), np.zeros(0), np.zeros(0, np.int32), 1, k)
    sample = _unit(drawn.column(0))
    centroids = _centroids(sample, min(cells or math.ceil(math.sqrt(total)), MAX_CELLS, len(sample)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            away = _distances(_unit(batch.column(2)), centroids)
            yield pa.RecordBatch.from_pydict({
                "digest": batch.column(0), "ids": batch.column(1), "vec": batch.column(2),
                "cell": pa.array(away.argmin(1), pa.int32()), "away": pa.array(away.min(1))})

    fields = [*points.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())]
    placed = stage(points.mapInArrow(place, T.StructType(fields)), "placed")
    sizes, radii = np.zeros(len(centroids), int), np.zeros(len(centroids))
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect():  # a row a cell
        sizes[r["cell"]], radii[r["cell"]] = r["n"], r["radius"]
    block = max(1, min(BLOCK, NUMBERS // centroids.shape[1], math.ceil(total / PARTS)))
    return Index(placed.drop("away"), rows, centroids, sizes, radii, _groups(centroids, sizes, block), block, k)


@dataclass(frozen=True)
class _Held:
    """The points of one block in the order of their cells; ``ids`` of point ``p`` are those from ``first[p]`` on, ``order`` ranks them."""

    vectors: np.ndarray
    cells: np.ndarray
    starts: np.ndarray
    ids: np.ndarray
    order: np.ndarray
    first: np.ndarray
    k: int

    @classmethod
    def of(cls, table: pa.Table, k: int) -> _Held:
        table = table.take(pa.array(np.argsort(table["cell"].to_numpy(), kind="stable")))
        lists = table["ids"].combine_chunks()
        cells, starts = np.unique(table["cell"].to_numpy(), return_index=True)
        first = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        return cls(_unit(table["vec"]), cells, np.append(starts, len(first) - 1), ids, np.unique(ids, return_inverse=True)[1], first, k)

    def nearest(self, asked: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every query the ``k`` first ids by cosine and id, of the cells in ``seen``: query, cosine and place in ``ids``."""
        best, place = np.full((len(asked), self.k), -np.inf), np.zeros((len(asked), self.k), int)
        for cell, low, high in zip(self.cells, self.starts, self.starts[1:]):
            rows = np.flatnonzero(seen[:, cell])
            if not len(rows):
                continue
            cosines = asked[rows] @ self.vectors[low:high].T
            least = best[rows, -1]
            new = np.isneginf(least)
            if new.any() and high - low > self.k:  # ids of the k best points are enough
                least[new] = np.partition(cosines[new], high - low - self.k, axis=1)[:, high - low - self.k]
            row, point = np.nonzero(cosines >= (least - 2 * 10.0**-DIGITS)[:, None])
            many = self.first[low + point + 1] - self.first[low + point]
            within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            hit = np.unique(row)
            all_rows = np.concatenate([np.repeat(hit, self.k), np.repeat(row, many)])
            values = np.concatenate([best[rows[hit]].ravel(), np.repeat(np.round(cosines[row, point], DIGITS), many)])
            places = np.concatenate([place[rows[hit]].ravel(), np.repeat(self.first[low + point], many) + within])
            ranked = np.lexsort((self.order[places], -values, all_rows))
            kept = ranked[np.searchsorted(all_rows[ranked], hit)[:, None] + np.arange(self.k)]
            best[rows[hit]], place[rows[hit]] = values[kept], places[kept]
        found = np.nonzero(best > -np.inf)
        return found[0], best[found], place[found]


def _blocks(index: Index, visits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(digest, vec, cells, group, a, b)`` of the queries and ``(ids, vec, cell, group, a, b)`` of the points that meet by group, a, b."""
    each = visits.select("digest", "vec", "cells", F.explode("groups").alias("group"))
    asked = {r["group"]: r["count"] for r in each.groupBy("group").count().collect()}  # a row a group
    held = np.bincount(index.groups, index.sizes).astype(int) if len(index.groups) else []
    split = {g: (math.ceil(n / index.block), math.ceil(held[g] / index.block)) for g, n in asked.items()}
    spark = visits.sparkSession
    shape = spark.createDataFrame([(g, q, v) for g, (q, v) in split.items()], "group int, n_asked int, n_held int")
    cells = spark.createDataFrame([(c, g, *split[g]) for c, g in enumerate(index.groups.tolist()) if g in split],
                                  "cell int, group int, n_asked int, n_held int")
    part = lambda n: F.pmod(F.xxhash64("digest"), F.col(n).cast("bigint")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # a row a group, and at most a row a cell
    queries = each.join(F.broadcast(shape), "group").select("digest", "vec", "cells", "group", part("n_asked").alias("a"), every("n_held").alias("b"))
    points = index.points.join(F.broadcast(cells), "cell").select("ids", "vec", "cell", "group", every("n_asked").alias("a"), part("n_held").alias("b"))
    return queries, points


def _search(index: Index, visits: DataFrame) -> DataFrame:
    """``found(digest, key, cosine)``: the first of each block that a query visits, for ``visits(digest, vec, cells, groups)``."""
    queries, points = _blocks(index, visits)
    k, n_cells = index.k + 1, len(index.sizes)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, cosines, keys = [np.zeros(0, int)], [np.zeros(0)], [np.zeros(0, int)]
        if left.num_rows and right.num_rows:
            held = _Held.of(right, k)
            for start in range(0, left.num_rows, CHUNK):
                some = left.slice(start, CHUNK)
                row, cosine, place = held.nearest(_unit(some["vec"]), _marks(some["cells"], n_cells))
                rows.append(row + start)
                cosines.append(cosine)
                keys.append(place)
        places = np.concatenate(keys)
        return pa.table({
            "digest": left["digest"].take(pa.array(np.concatenate(rows))),
            "key": pa.array(held.ids[places] if len(places) else [], right["ids"].type.value_type),
            "cosine": pa.array(np.concatenate(cosines), pa.float64())})

    key = index.rows.schema["key"].dataType
    fields = [T.StructField("digest", T.StringType()), T.StructField("key", key), T.StructField("cosine", T.DoubleType())]
    by = ["group", "a", "b"]
    return queries.groupBy(*by).cogroup(points.groupBy(*by)).applyInArrow(meet, T.StructType(fields))


def _firsts(found: DataFrame, k: int) -> DataFrame:
    """``near(digest, near)``: the first ``k`` of a query's finds; a visited block gives ``k`` at most."""
    pair = F.struct((-F.col("cosine")).alias("minus"), F.col("key").alias("key"))
    return found.groupBy("digest").agg(F.slice(F.array_sort(F.collect_list(pair)), 1, k).alias("near"))


#: A query's cells are a bit each.
VISITS = [T.StructField("digest", T.StringType()), T.StructField("cells", T.BinaryType()), T.StructField("groups", T.ArrayType(T.IntegerType()))]


def _marks(column: pa.Array | pa.ChunkedArray, n_cells: int) -> np.ndarray:
    """A row a query, a column a cell: whether it is visited."""
    packed = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.unpackbits(packed, axis=1, count=n_cells).astype(bool)


def _visit(batch: pa.RecordBatch, seen: np.ndarray, groups: np.ndarray) -> pa.RecordBatch:
    in_groups = seen.astype(np.float32) @ (groups[:, None] == np.arange(groups.max() + 1)).astype(np.float32) > 0
    offsets = np.append(0, np.cumsum(in_groups.sum(1)))
    return pa.RecordBatch.from_pydict({
        "digest": batch.column(0), "cells": pa.array([r.tobytes() for r in np.packbits(seen, axis=1)], pa.binary()),
        "groups": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.nonzero(in_groups)[1], pa.int32())),
        "vec": batch.column(1)})


def _visits(index: Index, queries: DataFrame, probes: int) -> DataFrame:
    centroids, groups = index.centroids, index.groups
    open_cells = np.flatnonzero(index.sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            order = _distances(_unit(batch.column(1)), centroids[open_cells]).argsort(1)[:, :probes]
            seen = np.zeros((batch.num_rows, len(centroids)), bool)
            np.put_along_axis(seen, open_cells[order], True, 1)
            yield _visit(batch, seen, groups)

    return queries.select("digest", "vec").mapInArrow(run, T.StructType([*VISITS, queries.schema["vec"]]))


def probes_for(index: Index, recall: float) -> int:
    """Cells a query must visit so that the first neighbours of ``TUNED`` sampled points are found at ``recall``.

    The sampled points meet all points in one pass; counted is how far down the order of cells their neighbours lie.
    """
    sampled = index.points.orderBy(F.xxhash64("digest", F.lit("tuned"))).limit(TUNED).select("digest", "vec").toArrow()
    names, asked, k = sampled["digest"].to_pylist(), _unit(sampled["vec"]), index.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            cosines = asked @ _unit(batch.column(1)).T
            own = {d: j for j, d in enumerate(batch.column(0).to_pylist())}
            for i, name in enumerate(names):
                if name in own:
                    cosines[i, own[name]] = -2
            top = np.argsort(-cosines, axis=1)[:, :k]
            yield pa.RecordBatch.from_pydict({
                "query": pa.array(np.repeat(np.arange(len(names)), top.shape[1]), pa.int32()),
                "cosine": pa.array(np.take_along_axis(cosines, top, 1).ravel()),
                "cell": batch.column(2).take(pa.array(top.ravel()))})

    fields = [T.StructField("query", T.IntegerType()), T.StructField("cosine", T.DoubleType()), T.StructField("cell", T.IntegerType())]
    near = index.points.select("digest", "vec", "cell").mapInArrow(run, T.StructType(fields))
    best = near.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct("cosine", "cell")), asc=False), 1, k).alias("top"))
    open_cells = np.flatnonzero(index.sizes)
    rank = np.argsort(np.argsort(_distances(asked, index.centroids[open_cells]), axis=1), axis=1)
    column = {c: j for j, c in enumerate(open_cells.tolist())}
    depths = sorted(int(rank[r["query"], column[x["cell"]]]) for r in best.collect() for x in r["top"] if x["cosine"] > -2)  # TUNED rows
    if not depths:
        return 1
    return 1 + depths[min(len(depths) - 1, math.ceil(recall * len(depths)) - 1)]


def _rows(index: Index, near: DataFrame, asked: DataFrame) -> DataFrame:
    """``(key, rank, neighbour, cosine)`` of every row in ``asked(key, digest)``, its own id left out."""
    lists = lookup_join(asked, stage(near, "near"), "digest")
    others = F.slice(F.filter("near", lambda x: x["key"] != F.col("key")), 1, index.k)
    ranked = lists.select("key", F.posexplode(others).alias("rank", "n"))
    return ranked.select("key", (F.col("rank") + 1).cast("bigint").alias("rank"), F.col("n.key").alias("neighbour"),
                         (-F.col("n.minus")).alias("cosine"))


def neighbours(index: Index, recall: float = 0.95, probes: int | None = None) -> DataFrame:
    """``(key, rank, neighbour, cosine)``: the ``k`` nearest of every row that visiting ``probes`` cells finds.

    Without ``probes`` as many cells are visited as ``recall`` needs on the sampled queries.
    """
    count = probes or (probes_for(index, recall) if len(index.centroids) else 1)
    visits = stage(_visits(index, index.points, count), "visits")
    near = _firsts(_search(index, visits), index.k + 1)
    return _rows(index, near, index.rows.select("key", "digest").distinct())


def exact_neighbours(index: Index, queries: DataFrame, probes: int = 4) -> DataFrame:
    """``(key, rank, neighbour, cosine)``: the ``k`` nearest of all rows, without a miss, for the rows named in ``queries(key)``.

    A first search visits ``probes`` cells; what it finds bounds how far a neighbour can be, and a second one visits the
    cells that the bound leaves.
    """
    asked = stage(index.rows.select("key", "digest").distinct().join(queries.select("key").distinct(), "key", "left_semi"), "asked")
    points = stage(index.points.join(asked.select("digest").distinct(), "digest", "left_semi").select("digest", "vec"), "queries")
    visits = stage(_visits(index, points, probes), "visits")
    found = stage(_search(index, visits), "found")
    k, centroids, radii, sizes, groups = index.k + 1, index.centroids, index.radii, index.sizes, index.groups
    bound = _firsts(found, k).select("digest", F.when(F.size("near") == k, -F.element_at("near", -1)["minus"]).alias("least"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            least = np.array([-1.0 if x is None else x for x in batch.column(3).to_pylist()])
            reach = np.sqrt(np.maximum(2 - 2 * (least - 10.0**-DIGITS), 0)) + SLACK
            left = _distances(_unit(batch.column(1)), centroids) - radii[None] <= reach[:, None]
            yield _visit(batch, left & (sizes > 0)[None] & ~_marks(batch.column(2), len(sizes)), groups)

    more = stage(visits.select("digest", "vec", "cells").join(bound, "digest").mapInArrow(run, visits.schema), "visits")
    near = _firsts(found.union(_search(index, more)), k)
    return _rows(index, near, asked)
