"""Operator 4: quartile bucket digests of documents, and of texts edited with their neighbour's.

A digest counts hashed byte triplets of the UTF-8 text in 128 buckets. Each bucket is
written as the quartile of the counts it lies in (two bits), beside the length on a
log scale and the ratios of the quartiles. The difference of two digests adds the
distances of their buckets (opposite quartiles count double), lengths and ratios; it
is bounded by ``WORST``, about what unrelated texts have, and likeness is one minus
its share of the bound.

``with_next`` pairs every document with the next one in descending order of ``doc_id``
(after the last: the first). Ids are cut into ranges at the quantiles of a bounded
sample, of ``ROWS`` rows or so each; every range is sent to a task with the first
document of the next one, so texts are shuffled once, streamed in order, and neither
a window over all rows nor a second copy of the text is needed. An id with very many
rows, or none, is cut further, by the beginnings of its texts; only rows whose texts
begin alike over ``PREFIX`` code points stay together. Only the ranges' ends, and the
samples they are cut by, reach the driver (each of bounded size).

Nulls count as empty texts. Rows with equal ids are documents of their own, in the
order of their texts (nulls first); null ids come last. A single document is its own
next one. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelens.llm.tables import map_rows

BUCKETS = 128
WORST = 160
#: Rows meant for a range of ids, ranges at most, and ids that the ranges are cut by (about, at most).
ROWS, RANGES, SAMPLE = 1000, 5000, 100_000
#: Code points of a text that the rows of one id are cut by.
PREFIX = 100

_SPREAD = np.uint32(2654435761)
_APART = np.array([[6 if abs(a - b) == 3 else abs(a - b) for b in range(4)] for a in range(4)], np.int64)


def digest(text: str | None) -> str:
    """The digest of a whole text: length, two quartile ratios, and two bits a bucket, in hexadecimal digits."""
    raw = np.frombuffer((text or "").encode(), np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    if len(raw) >= 3:
        triplets = raw[:-2] | raw[1:-1] << np.uint32(8) | raw[2:] << np.uint32(16)
        counts = np.bincount((triplets * _SPREAD) >> np.uint32(25), minlength=BUCKETS)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    body = (codes.reshape(-1, 4) << np.array([6, 4, 2, 0], np.uint8)).sum(1).astype(np.uint8)
    length = min(255, round(8 * float(np.log2(1 + len(raw)))))
    ratios = (int(15 * q1 // q3) << 4 | int(15 * q2 // q3)) if q3 else 0
    return bytes([length, ratios]).hex() + body.tobytes().hex()


def _fields(found: str) -> tuple[int, int, int, np.ndarray]:
    raw = bytes.fromhex(found)
    body = np.frombuffer(raw[2:], np.uint8)
    return raw[0], raw[1] >> 4, raw[1] & 15, (body[:, None] >> np.array([6, 4, 2, 0], np.uint8)).ravel() & 3


def difference(a: str, b: str) -> int:
    """The bounded difference of two digests: 0 for equal ones, ``WORST`` at most."""
    if a == b:
        return 0
    length_a, q1_a, q2_a, codes_a = _fields(a)
    length_b, q1_b, q2_b, codes_b = _fields(b)
    apart = int(_APART[codes_a, codes_b].sum()) + abs(length_a - length_b) // 2
    return min(WORST, apart + abs(q1_a - q1_b) + abs(q2_a - q2_b))


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / WORST


def edit(text: str, following: str) -> str:
    """A text whose last half is replaced by as many first characters of the next one (or all of it)."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _text_cuts(docs: DataFrame, hot: dict, rows: int) -> dict:
    """For each id of very many rows the beginnings of texts that cut its rows, from a bounded sample."""
    if not hot:
        return {}
    share = min(1.0, SAMPLE / 10 / sum(hot.values()))
    ids = [i for i in hot if i is not None]
    of_hot = F.col("doc_id").isin(ids) if None not in hot else F.col("doc_id").isin(ids) | F.col("doc_id").isNull()
    start = F.coalesce(F.substring("text", 1, PREFIX), F.lit(""))
    drawn = F.pmod(F.xxhash64("text", F.lit(4)), F.lit(1 << 30)) <= int(share * (1 << 30))
    found: dict = {i: set() for i in hot}
    for r in docs.filter(of_hot & drawn).select("doc_id", start.alias("start")).distinct().collect():
        found[r["doc_id"]].add(r["start"])
    cuts = {}
    for i, n in hot.items():
        starts, parts = sorted(found[i]), min(RANGES, n // rows)
        cuts[i] = sorted({starts[k * len(starts) // parts] for k in range(1, parts)}) if starts else []
    return cuts


def _ranges(docs: DataFrame, rows: int) -> DataFrame:
    """``docs`` with ``part``, the number of each row's range; ranges with larger numbers come first in the order.

    Ids are cut at quantiles; the rows of an id (or of none) that has very many are cut by the beginnings of their texts.
    """
    counts = docs.groupBy("doc_id").count()
    total = docs.count()
    hot = {r["doc_id"]: r["count"] for r in counts.filter(F.col("count") > max(4 * rows, total // RANGES)).collect()}  # RANGES at most
    text_cuts = _text_cuts(docs, hot, rows)
    known = docs.filter("doc_id is not null").select("doc_id")
    parts = max(1, min(RANGES, total // rows))
    share = min(1.0, SAMPLE / max(total, 1))
    sample = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) <= int(share * (1 << 30))).distinct()
    ids = np.array([float(r["doc_id"]) for r in sample.collect()])
    cuts = set(np.quantile(ids, np.arange(1, parts) / parts, method="lower").tolist()) if parts > 1 and len(ids) else set()
    for i in hot:
        if i is not None:
            cuts |= {float(i), float(np.nextafter(float(i), np.inf))}
    wide = docs.select("doc_id", "text", F.col("doc_id").cast("double").alias("_id"))
    if cuts:
        splits = [-float("inf"), *sorted(cuts), float("inf")]
        wide = Bucketizer(splits=splits, inputCol="_id", outputCol="_range", handleInvalid="keep").transform(wide)
    else:
        wide = wide.withColumn("_range", F.lit(0))
    span = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.col("_range").cast("int"))
    if not hot:
        return wide.select("doc_id", "text", span.cast("bigint").alias("part"))
    step = max(map(len, text_cuts.values())) + 3
    # of two such ids that are one number as doubles (beyond 2^53) the first is cut
    listed: dict = {}
    for i in hot:
        listed.setdefault(None if i is None else float(i), i)
    table = docs.sparkSession.createDataFrame(
        [(key, i, text_cuts[i]) for key, i in listed.items()], "_key double, _hot long, _cuts array<string>")
    met = wide.join(F.broadcast(table), F.col("_id").eqNullSafe(F.col("_key")), "left")
    start = F.coalesce(F.substring("text", 1, PREFIX), F.lit(""))
    within = F.size(F.filter("_cuts", lambda c: c <= start)) + 1
    place = (F.when(F.col("_cuts").isNull() | (F.col("doc_id") > F.col("_hot")), 0)
             .when(F.col("doc_id") < F.col("_hot"), step - 1).otherwise(within))
    return met.select("doc_id", "text", (span.cast("bigint") * step + (step - 1 - place)).alias("part"))


def with_next(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """``doc_id``, ``n_chars``, ``edited`` text, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``."""
    spark = docs.sparkSession
    placed = _ranges(docs.select("doc_id", "text"), rows)
    heads = sorted(((r["part"], r["head"]) for r in placed.groupBy("part").agg(F.max("doc_id").alias("head")).collect()), reverse=True)
    order = [p for p, _ in heads]
    # the first document of each range is also the one after the last of the range above it
    sent = [(part, head, order[k - 1]) for k, (part, head) in enumerate(heads)]
    wanted = spark.createDataFrame(sent, "part long, head long, to long")
    first = (placed.join(F.broadcast(wanted), "part").filter(F.col("doc_id").eqNullSafe(F.col("head")))
             .groupBy("to").agg(F.min(F.struct("text", "doc_id")).alias("row"))
             .select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), F.col("to").alias("part"), F.lit(1).alias("last")))
    dealt = (placed.withColumn("last", F.lit(0)).unionByName(first).repartition("part")
             .sortWithinPartitions("part", "last", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first()))
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        before, size = None, 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for doc_id, text, last in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist()):
                    text = text or ""
                    own = digest(text)
                    if before is not None:
                        above, above_text, above_digest = before
                        edited = edit(above_text, text)
                        edited_digest = digest(edited)
                        out.append((above, len(above_text), edited, above_digest, edited_digest,
                                    likeness(above_digest, edited_digest), likeness(above_digest, own)))
                        size += len(edited)
                    before = None if last else (doc_id, text, own)
                    if len(out) >= 512 or size >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    kinds = [T.LongType(), T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.DoubleType(), T.DoubleType()]
    return map_rows(dealt.select("doc_id", "text", "part", "last"), run, [T.StructField(n, k) for n, k in zip(names, kinds)])
