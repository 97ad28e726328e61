"""Operator 10: removal of repeated word windows by super-k-mer partitioning.

A window is ``width`` consecutive words of one document. It goes when the same word
sequence also starts in a document with a smaller id, and a word goes when a window
that covers it goes. Windows are judged on the input.

The minimiser of a window is the smallest hash of the ``gram``-word sequences in it,
so equal windows have equal minimisers. Consecutive windows of a document that share
one form a super-k-mer:

1. every document gives its super-k-mers as (minimiser, digest of the words, place),
   without the words;
2. minimisers that occur in one document only cannot repeat and go no further. Equal
   super-k-mers become one, standing for the smallest id;
3. these travel as one packed string each to the bucket of their minimiser, where the
   windows are sorted by their words, which gives each window the smallest id it
   starts in, exactly. A minimiser with more than ``HOT`` windows is dealt out by
   window instead and grouped by Spark, exactly too;
4. every place of a super-k-mer gets the runs of windows with a smaller id, and each
   document its spans, which are cut from its words.

A copied passage thus costs a few numbers a document, whatever the number of copies,
and no group has to fit into memory. Digests are 128-bit XXH3 of the words.

Words are runs without ASCII white space. Nulls, empty and short texts have no window
and lose nothing. Rows with the same ``doc_id`` are parts of one document: none of
them removes words of another. A null ``doc_id`` is no document: such rows neither
remove nor lose words. Extra columns are not read; outputs replace kept columns of
the same name.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelens.llm.tables import map_rows, slices, staged
from notelens.operators.scale import lookup_join

WIDTH, GRAM = 50, 8
#: Windows in the distinct super-k-mers of a minimiser above which they are dealt out by their words.
HOT = 50_000
#: Words whose hashes a Python worker keeps.
CACHED_WORDS = 250_000
_MIX = np.uint64(0x9E3779B97F4A7C15)

LONG, INT, TEXT, BIN = T.LongType(), T.IntegerType(), T.StringType(), T.BinaryType()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_KNOWN = _Hashes()


def super_kmers(words: list[bytes], width: int = WIDTH, gram: int = GRAM) -> list[tuple[int, int, int]]:
    """(minimiser, first window, number of windows) of the runs of windows of a document that share a minimiser."""
    n = len(words) - width + 1
    if n < 1:
        return []
    if len(_KNOWN) > CACHED_WORDS:
        _KNOWN.clear()
    h = np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))
    grams = h[:len(h) - gram + 1].copy()
    for k in range(1, gram):
        grams *= _MIX
        grams ^= grams >> np.uint64(29)
        grams += h[k:len(h) - gram + 1 + k]
    grams *= _MIX
    grams ^= grams >> np.uint64(32)
    reach, low = width - gram + 1, grams  # smallest of the last ``size`` grams, by doubling
    size = 1
    while size < reach:
        step = min(size, reach - size)
        low = np.minimum(low[:-step], low[step:])
        size += step
    cuts = np.flatnonzero(low[1:] != low[:-1]) + 1
    starts = np.concatenate([[0], cuts])
    lengths = np.diff(np.concatenate([starts, [n]]))
    return list(zip(low[starts].view(np.int64).tolist(), starts.tolist(), lengths.tolist()))


def _places(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """Step 1: a row for every super-k-mer of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = ([], [], [], [], [])
            for doc_id, text, text_key in zip(*(c.to_pylist() for c in part.columns)):
                if doc_id is None or not text:
                    continue
                words = text.encode().split()
                found = super_kmers(words, width, gram)
                if not found:
                    continue
                joined = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                firsts = np.concatenate([[0], ends[:-1] + 1]).tolist()
                ends = ends.tolist()
                for minimiser, start, count in found:
                    packed = joined[firsts[start]:ends[start + count + width - 2]]
                    out[0].append(minimiser)
                    out[1].append(xxhash.xxh3_128_digest(packed))
                    out[2].append(doc_id)
                    out[3].append(text_key)
                    out[4].append((start << 32) | count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64()),
                 pa.array(out[3], pa.int64()), pa.array(out[4], pa.int64())],
                ["minimiser", "digest", "doc_id", "text_key", "place"])

    return map_rows(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")), run, [
        T.StructField("minimiser", LONG), T.StructField("digest", BIN), T.StructField("doc_id", LONG),
        T.StructField("text_key", LONG), T.StructField("place", LONG)])


def _packed(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Step 3, first part: the words of the chosen super-k-mers, cut from the documents that stand for them."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").join(wanted, ["doc_id", "text_key"])
    # equal rows of one id stand for their strings once
    rows = rows.groupBy("doc_id", "text_key").agg(F.first("text").alias("text"), F.first("chosen").alias("chosen")).select("text", "chosen")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = ([], [], [], [], [])
            for text, chosen in zip(*(c.to_pylist() for c in part.columns)):
                words = (text or "").encode().split()
                for c in chosen:
                    start, count = c["place"] >> 32, c["place"] & 0xFFFFFFFF
                    out[0].append(c["minimiser"])
                    out[1].append(c["digest"])
                    out[2].append(c["smallest"])
                    out[3].append(c["hot"])
                    out[4].append(b" ".join(words[start:start + count + width - 1]).decode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int64()),
                 pa.array(out[3], pa.bool_()), pa.array(out[4], pa.string())],
                ["minimiser", "digest", "smallest", "hot", "packed"])

    return map_rows(rows, run, [T.StructField("minimiser", LONG), T.StructField("digest", BIN), T.StructField("smallest", LONG),
                                T.StructField("hot", T.BooleanType()), T.StructField("packed", TEXT)])


def _windows(packed: str, width: int) -> Iterator[bytes]:
    """The windows of a packed string, in order."""
    words = packed.encode().split()
    joined = b" ".join(words)
    ends = (np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1).tolist()
    firsts = [0, *[e + 1 for e in ends[:-1]]]
    return (joined[firsts[i]:ends[i + width - 1]] for i in range(len(words) - width + 1))


def _runs(smallest: list[int]) -> list[dict]:
    """Runs of windows with the same smallest id."""
    a = np.array(smallest, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1])
    lengths = np.diff(np.concatenate([starts, [len(a)]]))
    return [{"first": int(s), "count": int(c), "smallest": int(a[s])} for s, c in zip(starts, lengths)]


_RUNS = T.ArrayType(T.StructType([T.StructField("first", INT), T.StructField("count", INT), T.StructField("smallest", LONG)]))
_ARROW_RUNS = pa.list_(pa.struct([("first", pa.int32()), ("count", pa.int32()), ("smallest", pa.int64())]))


def _bucket_runs(packed: DataFrame, width: int) -> DataFrame:
    """Step 3: in the bucket of each minimiser the windows are sorted; each super-k-mer gets its runs of smallest ids."""
    dealt = (packed.select("minimiser", "digest", "smallest", "packed").repartition("minimiser")
             .sortWithinPartitions("minimiser", "smallest"))

    def bucket(rows: list[tuple]) -> list[tuple[bytes, list[dict]]]:
        entries = []
        for at, (_, smallest, packed) in enumerate(rows):
            entries += [(window, smallest, at, i) for i, window in enumerate(_windows(packed, width))]
        entries.sort()
        found = [[0] * (packed.count(" ") + 2 - width) for _, _, packed in rows]
        current, lowest = None, 0
        for window, smallest, at, i in entries:
            if window != current:
                current, lowest = window, smallest  # sorted by id within equal windows
            found[at][i] = lowest
        return [(rows[at][0], _runs(found[at])) for at in range(len(rows))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minimiser, rows = None, []

        def done(found):
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], _ARROW_RUNS)],
                                              ["digest", "runs"])

        found: list[tuple[bytes, list[dict]]] = []
        for part in slices(batches):
            for m, *row in zip(*(c.to_pylist() for c in part.columns)):
                if m != minimiser and rows:
                    found += bucket(rows)
                    rows = []
                    if len(found) >= 2000:
                        yield done(found)
                        found = []
                minimiser = m
                rows.append(tuple(row))
        if rows:
            found += bucket(rows)
        if found:
            yield done(found)

    return map_rows(dealt, run, [T.StructField("digest", BIN), T.StructField("runs", _RUNS)])


def _hot_runs(packed: DataFrame, width: int) -> DataFrame:
    """Step 3 for minimisers of very many strings: a row for each window, grouped by its words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, rows=64):
            for digest, smallest, packed in zip(*(c.to_pylist() for c in part.columns)):
                windows = _windows(packed, width)
                first = 0
                while keys := [xxhash.xxh3_128_digest(w) for w in itertools.islice(windows, 65_536)]:
                    n = len(keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.binary()), pa.array([digest] * n, pa.binary()), pa.array([smallest] * n, pa.int64()),
                         pa.array(range(first, first + n), pa.int32())], ["window", "digest", "smallest", "first"])
                    first += n

    windows = map_rows(packed.select("digest", "smallest", "packed"), cut, [
        T.StructField("window", BIN), T.StructField("digest", BIN), T.StructField("smallest", LONG), T.StructField("first", INT)])
    windows = staged(windows, "hot-windows")
    # a window with one smallest id takes no words; very frequent ones are split off by the join
    lowest = windows.groupBy("window").agg(
        F.min("smallest").alias("lowest"), F.max("smallest").alias("highest"), F.count(F.lit(1)).alias("n"))
    lowest = staged(lowest.filter("lowest < highest").select("window", "lowest", "n"), "hot-lowest")
    run = F.struct("first", F.lit(1).alias("count"), F.col("lowest").alias("smallest"))
    # a super-k-mer has no more windows than a document has words
    return (lookup_join(windows, lowest, "window", weight="n").filter("lowest < smallest")
            .groupBy("digest").agg(F.collect_list(run).alias("runs")))


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int | None = None) -> DataFrame:
    """``(doc_id, text_key, spans)`` of the documents that lose words; a span is (first word, number of words)."""
    places = staged(_places(docs, width, gram), "places")
    shared = (places.groupBy("minimiser").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
              .filter("a < b").select("minimiser"))
    kept = staged(places.join(shared, "minimiser"), "shared-places")
    pick = F.min(F.struct("doc_id", "text_key", "place")).alias("pick")
    strings = staged(kept.groupBy("minimiser", "digest").agg(pick).select("minimiser", "digest", "pick.*"), "strings")
    count = F.col("place").bitwiseAND(0xFFFFFFFF)
    sizes = strings.groupBy("minimiser").agg(F.count(F.lit(1)).alias("strings"), F.sum(count).alias("windows"))
    heavy = sizes.filter("strings > 1").select("minimiser", (F.col("windows") > (HOT if hot is None else hot)).alias("hot"))
    chosen = F.struct("minimiser", "digest", "place", F.col("doc_id").alias("smallest"), "hot")
    # a document has no more super-k-mers than words
    wanted = (strings.join(heavy, "minimiser").groupBy("doc_id", "text_key").agg(F.collect_list(chosen).alias("chosen")))
    packed = staged(_packed(docs.filter("doc_id is not null"), wanted, width), "packed")
    runs = _bucket_runs(packed.filter("not hot"), width).union(_hot_runs(packed.filter("hot"), width))
    runs = runs.groupBy("digest").agg(F.first("runs").alias("runs"))
    # of a copy of a string that stands for a smaller id all windows go, of the one that stands for itself those of the runs
    tagged = kept.join(strings.select("digest", F.col("doc_id").alias("own")), "digest").join(runs, "digest", "left")
    start = F.shiftright("place", 32)
    lost = F.when(F.col("own") < F.col("doc_id"), F.array(F.struct(start.cast("int").alias("first"), (count + (width - 1)).cast("int").alias("count"))))
    lost = lost.otherwise(F.transform(
        F.filter(F.coalesce("runs", F.array().cast(_RUNS)), lambda r: r["smallest"] < F.col("doc_id")),
        lambda r: F.struct((start + r["first"]).cast("int").alias("first"), (r["count"] + (width - 1)).cast("int").alias("count"))))
    return (tagged.select("doc_id", "text_key", lost.alias("lost")).filter(F.size("lost") > 0)
            .groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("lost")).alias("spans")))


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int | None = None,
                   keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns, ``n_words``, ``n_removed``, ``removed`` (spans) and ``kept`` (the words left, joined by spaces)."""
    new = ("n_words", "n_removed", "removed", "kept")
    names = [n for n in keep if n not in new]
    spans = repeated_spans(docs, width, gram, hot)
    spans = spans.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("spans").alias("_spans"))
    # a kept text goes to Python once
    own = [] if "text" in names else [F.col("text").alias("_text")]
    wide = docs.select(*names, F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), *own)
    wide = wide.join(spans, ["_id", "_key"], "left").drop("_id", "_key")
    text_at = wide.columns.index("_text" if own else "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n_words, n_removed, removed, kept = [], [], [], []
            for text, found in zip(part.column(text_at).to_pylist(), part.column(part.num_columns - 1).to_pylist()):
                words = (text or "").encode().split()
                spans = _union(found or [])
                at, left = 0, []
                for first, count in spans:
                    left += words[at:first]
                    at = first + count
                left += words[at:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                removed.append([{"first": f, "count": c} for f, c in spans])
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:len(names)], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(removed, pa.list_(pa.struct([("first", pa.int32()), ("count", pa.int32())]))), pa.array(kept, pa.string())],
                [*names, *new])

    span = T.ArrayType(T.StructType([T.StructField("first", INT), T.StructField("count", INT)]))
    return map_rows(wide, run, [docs.schema[n] for n in names] + [
        T.StructField("n_words", LONG), T.StructField("n_removed", LONG), T.StructField("removed", span), T.StructField("kept", TEXT)])


def _union(spans: list[dict]) -> list[tuple[int, int]]:
    """Spans without overlaps, in order."""
    out: list[list[int]] = []
    for s in sorted(spans, key=lambda s: s["first"]):
        first, stop = s["first"], s["first"] + s["count"]
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([first, stop])
    return [(a, b - a) for a, b in out]
