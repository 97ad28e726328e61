"""Operator 5: SimHash fingerprints and near-duplicate groups by vantage-point trees.

A fingerprint has 64 bits; a bit is set when it is set in over half of the XXH64
hashes of the text's word shingles. Equal fingerprints are one point. Points link
at ``RADIUS`` or fewer differing bits, and groups are the components of the links.

Of two linked points, some 16-bit quarter differs in at most RADIUS / 4 bits. For
each quarter a vantage-point tree cuts the points into shards: a node holds a
vantage value and a middle distance, and a point goes inside or outside by its
Hamming distance to the vantage value. By the triangle inequality the distances of
two points to a vantage value differ by no more than their own distance, so only
points at the boundary can have partners on the other side; these travel to both
sides, and no link is lost. Within a shard points are ordered by their distance to
another vantage point, and only those in reach by the same bound are compared. A
shard gives a spanning set of its links, not all its pairs.

The trees come from a bounded sample (``SAMPLE`` points of the smallest hashes) and
only decide the balance of the shards; their depth follows the number of points. A
shard with more than ``SHARD`` points is cut into blocks, and each pair of blocks is
a task of its own, so no task's memory grows with the data. Nothing but the sample
and the sizes of shards reaches the driver.

Nulls, empty texts and texts without words have fingerprint zero and are linked like
any other. Texts with fewer words than a shingle have one shingle. Repeated rows are
returned each. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelens.llm.components import components
from notelens.llm.tables import map_rows, slices, staged

WORDS_PER_SHINGLE = 4
SEED = 42
RADIUS = 4
#: Points that the trees are made from, the points meant for a shard, and the most that one task compares at once.
SAMPLE, LEAF, SHARD = 8192, 800, 4000
#: Levels of a tree, at most: a quarter has 2^16 values.
MAX_DEPTH = 12
QUARTERS = 4


def fingerprint(text: str | None, k: int = WORDS_PER_SHINGLE) -> bytes:
    """The 8 bytes of a text's fingerprint, most significant first."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(words) > k:
        starts, ends = starts[:len(words) - k + 1], ends[k - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashes = b"".join([xxhash.xxh64_digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())])
    bits = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    counts = sum((np.unpackbits(bits[i:i + 32768], axis=1).sum(0, dtype=np.int64) for i in range(0, len(bits), 32768)),
                 np.zeros(64, np.int64))
    return np.packbits(counts * 2 > len(bits)).tobytes()


def fingerprints(docs: DataFrame, k: int = WORDS_PER_SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, point)``: the fingerprint of every row as a signed 64-bit integer; then the columns of ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            raw = b"".join([fingerprint(t, k) for t in part.column(1).to_pylist()])
            points = np.frombuffer(raw, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(points), *part.columns[2:]], ["doc_id", "point", *keep])

    return map_rows(docs.select("doc_id", "text", *keep), run,
                    [docs.schema["doc_id"], T.StructField("point", T.LongType()), *[docs.schema[c] for c in keep]])


def quarter(points: np.ndarray, q: int) -> np.ndarray:
    return ((points.view(np.uint64) >> np.uint64(16 * q)) & np.uint64(0xFFFF)).astype(np.uint16)


def build_tree(values: np.ndarray, depth: int, rng: np.random.Generator) -> list[tuple[int, int]]:
    """A full tree in heap order, (vantage value, largest distance inside) by node; node i has children 2i+1 and 2i+2.

    A node tries a few vantage values and takes the one that leaves the fewest values of the larger side and boundary.
    """
    nodes: list[tuple[int, int]] = []
    members = [values]
    for _ in range(depth):
        below = []
        for own in members:
            best = None
            for vantage in rng.choice(own, 12) if len(own) else rng.integers(0, 1 << 16, 1, dtype=np.uint16):
                d = np.bitwise_count(own ^ vantage)
                for middle in ({int(np.median(d)), int(np.median(d)) - 1} if len(own) else {8}):
                    inside, outside = int((d <= middle).sum()), int((d >= middle).sum())
                    cost = inside ** 2 + outside ** 2
                    if best is None or cost < best[0]:
                        best = (cost, int(vantage), middle, d)
            nodes.append((best[1], best[2]))
            d = best[3]
            below += [own[d <= best[2]], own[d >= best[2]]]
        members = below
    return nodes


def shards_of(values: np.ndarray, nodes: list[tuple[int, int]], reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf that each value belongs to: its own side, and the other when at the boundary.

    Two values at most ``reach`` apart share a leaf: their distances to a vantage value differ by ``reach`` at most, so if
    they lie on different sides, the inner one is within ``reach`` of the middle and goes outside too.
    """
    vantage = np.array([n[0] for n in nodes], np.uint16)
    middle = np.array([n[1] for n in nodes], np.int16)
    rows, at = np.arange(len(values)), np.zeros(len(values), np.int64)
    while len(at) and at[0] < len(nodes):
        d = np.bitwise_count(values[rows] ^ vantage[at]).astype(np.int16)
        inside, outside = d <= middle[at], d > middle[at] - reach
        rows, at = (np.concatenate([rows[inside], rows[outside]]),
                    np.concatenate([2 * at[inside] + 1, 2 * at[outside] + 2]))
    return rows, at - len(nodes)


def spanning_links(points: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (point, root) that join the components of all points at most ``radius`` apart."""
    if len(points) < 2:
        return points[:0], points[:0]
    raw = points.view(np.uint64)
    d = np.bitwise_count(raw ^ raw[0]).astype(np.int16)
    order = np.argsort(d, kind="stable")
    raw, d = raw[order], d[order]
    label = np.arange(len(raw))
    found_a, found_b = [], []
    for start in range(0, len(raw), 256):
        own = raw[start:start + 256]
        stop = np.searchsorted(d, d[min(start + 256, len(raw)) - 1] + radius, "right")
        near = np.bitwise_count(own[:, None] ^ raw[None, start:stop]) <= radius
        a, b = np.nonzero(near)
        later = b > a
        found_a.append(a[later] + start)
        found_b.append(b[later] + start)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    if not len(a):
        return points[:0], points[:0]
    left, right = np.concatenate([a, b]), np.concatenate([b, a])
    by = np.argsort(left, kind="stable")
    left, right = left[by], right[by]
    first = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]]))
    nodes = left[first]
    while True:
        new = label.copy()
        new[nodes] = np.minimum(label[nodes], np.minimum.reduceat(label[right], first))
        new = new[new]
        if (new == label).all():
            break
        label = new
    apart = np.flatnonzero(label != np.arange(len(label)))
    out = raw.view(np.int64)
    return out[apart], out[label[apart]]


def link_points(points: DataFrame, n_points: int, radius: int = RADIUS, leaf: int | None = None, shard: int | None = None) -> DataFrame:
    """Links ``(left, right)`` that span the components of the distinct ``point`` values of a table."""
    leaf, shard = leaf or LEAF, shard or SHARD
    sample = points.orderBy(F.xxhash64("point"), "point").limit(SAMPLE).collect()
    sampled = np.array([r["point"] for r in sample], np.int64)
    depth = 0 if n_points <= leaf else min(MAX_DEPTH, math.ceil(math.log(n_points / leaf) / math.log(1 / 0.62)))
    rng = np.random.default_rng(0)
    trees = [build_tree(quarter(sampled, q), depth, rng) for q in range(QUARTERS)]
    reach, leaves = radius // QUARTERS, 1 << depth

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows=8192):
            own = part.column(0).to_numpy()
            for q in range(QUARTERS):
                rows, at = shards_of(quarter(own, q), trees[q], reach)
                yield pa.RecordBatch.from_arrays([pa.array((at + q * leaves).astype(np.int32)), pa.array(own[rows])],
                                                 ["shard", "point"])

    dealt = map_rows(points.select("point"), deal, [T.StructField("shard", T.IntegerType()), T.StructField("point", T.LongType())])
    # at most 4 * 2^MAX_DEPTH rows; only the shards over the bound are named in the plan
    large = [(r["shard"], -(-r["count"] // shard)) for r in dealt.groupBy("shard").count().filter(F.col("count") > shard).collect()]
    blocks = dealt.sparkSession.createDataFrame(large, "shard int, blocks int")
    own = F.pmod(F.xxhash64("point", F.lit(7)), F.col("blocks")).cast("int")
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = (dealt.join(F.broadcast(blocks), "shard", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .withColumn("own", own).withColumn("partner", partner)
             .select("shard", F.least("own", "partner").alias("a"), F.greatest("own", "partner").alias("b"), "point"))
    even = tasks.repartition("shard", "a", "b").sortWithinPartitions("shard", "a", "b")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _groups(batches):
            left, right = spanning_links(own, radius)
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], ["left", "right"])

    return map_rows(even, search, [T.StructField("left", T.LongType()), T.StructField("right", T.LongType())])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The points of one task key after the other, from rows sorted by key."""
    key, kept = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
        points = batch.column(3).to_numpy()
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for start, stop in zip([0, *cuts], [*cuts, len(keys)]):
            own = tuple(keys[start])
            if own != key and kept:
                yield np.concatenate(kept)
                kept = []
            key = own
            kept.append(points[start:stop])
    if kept:
        yield np.concatenate(kept)


def _members(rows: DataFrame, radius: int, leaf: int | None = None, shard: int | None = None) -> DataFrame:
    """``(point, smallest, root, component_id)`` of every fingerprint: its own smallest id, its component and the smallest id there."""
    points = staged(rows.groupBy("point").agg(F.min("doc_id").alias("smallest")), "points")
    found = components(link_points(points, points.count(), radius, leaf, shard))
    rooted = (points.join(found.withColumnRenamed("node", "point"), "point", "left")
              .select("point", "smallest", F.coalesce("root", "point").alias("root")))
    roots = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    return staged(rooted.join(roots, "root").select("point", "smallest", "root", "component_id"), "members")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, k: int = WORDS_PER_SHINGLE, leaf: int | None = None,
                    shard: int | None = None) -> DataFrame:
    """``(doc_id, point, component_id)`` of every row; the component's id is its smallest ``doc_id``."""
    rows = staged(fingerprints(docs, k), "fingerprints")
    members = _members(rows, radius, leaf, shard).select("point", "component_id")
    return rows.join(members, "point").select("doc_id", "point", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, k: int = WORDS_PER_SHINGLE) -> DataFrame:
    """Of each group one row: the one of the smallest id, then text, then other columns in their order (null ids and texts last).

    Groups are told apart by their root, not by ids, which may repeat or be null. Rows of one text have one digest, so
    one row for each digest is enough to choose from; both choices are aggregates, and no task holds the rows of an id or
    a group. Columns must have an order (no maps).
    """
    names = docs.columns
    digest = F.coalesce(F.md5("text"), F.lit(""))
    rows = staged(fingerprints(docs.select("doc_id", "text", digest.alias("digest")), k, keep=("digest",)), "fingerprints")
    members = _members(rows, radius)
    # texts whose smallest id is the smallest of their group; the id in the key spreads the texts of a common fingerprint
    texts = rows.groupBy("digest").agg(F.min("point").alias("point"), F.min("doc_id").alias("smallest")).alias("t")
    least = members.filter("smallest <=> component_id").select("point", "smallest", "root").alias("m")
    same = (F.col("t.point") == F.col("m.point")) & F.col("t.smallest").eqNullSafe(F.col("m.smallest"))
    chosen = texts.join(least, same).select("t.digest", "m.root")
    row = F.struct(F.col("doc_id").isNull().alias("_no_id"), F.col("doc_id").alias("_id"), F.col("text").isNull().alias("_no_text"),
                   F.col("text").alias("_text"), *[n for n in names if n not in ("doc_id", "text")])
    wide = docs.select(digest.alias("_digest"), row.alias("_row")).groupBy("_digest").agg(F.min("_row").alias("_row"))
    first = wide.join(chosen, F.col("_digest") == F.col("digest")).groupBy("root").agg(F.min("_row").alias("_row"))
    own = {"doc_id": "_id", "text": "_text"}
    return first.select(*[F.col("_row").getField(own.get(n, n)).alias(n) for n in names])
