"""Operator 11: spelling variants by frontiers in a relational trie.

Words are distinct results of whole texts' letter runs (see ``words``) with their counts.
Two words are near if they differ by one inserted, deleted or replaced code point. A
word's form is its near word of the largest count, if that is ``TIMES`` its own or more;
following forms leads to its root.

The trie is a table. Its nodes are prefixes where words part, named by a 64-bit hash; a
row of the edge table has a node, the first character and the whole label of an edge, and
its child or, at a word's end, the word. Two words with one edit part at a node, exactly
where their common prefix ends. A frontier of states (word, position, node, edits) meets
the edges of its nodes in one join a level. States without edits lie at all nodes of a
word's own path, so they start the frontier; their join tries edges with another first
character as a replaced, inserted or deleted code point. States with one edit go on where
an edge's label is what comes next in the word, level by level, until none is left. States that
reach a word's end are near words.

Every word is searched twice: in a trie of words from their middle on, and in a trie of
reversed words for edits in the first half. So the frontier starts at deep nodes with few
branches, and only prefixes of at least half of a word are ever made. A pair found on both
sides counts once. The number of levels follows the branching of the trie, not the length of words.
A state has at most as many edges as the alphabet has letters, so nothing grows with the
square of a group. Hashes that collide add states, never lose one; results are compared
exactly at the end. All levels are written tables; nothing but counts reaches the driver.

Null texts have no runs; a null id counts as an empty one. Repeated rows count each. Very
long runs are words like any other. An empty table gives an empty result. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelens.llm.tables import map_rows, slices, staged

LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form occurs at least so many times as often as the word.
TIMES = 10
#: Of so many occurrences one loses a code point.
DROP = 31

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """``word``, ``n``: letter runs in lower case, with a code point dropped where the hash of id and run says so.

    Shorter runs than ``length`` cannot give a word and are never made rows; counts are combined before the shuffle.
    """
    runs = F.regexp_extract_all(F.col(text), F.lit(f"[A-Za-zÀ-ÿ]{{{length},}}"), F.lit(0))
    key = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"))
    each = df.select(key.alias("key"), F.explode(runs).alias("run"))
    low = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    # an array of one is worked out once; else Spark works a column out anew wherever a later one or a filter names it
    once = lambda value: F.explode(F.array(value))
    h = each.select("key", once(low).alias("run")).select("run", once(F.crc32(F.concat("key", "run"))).alias("h"))
    at = F.pmod(F.col("h"), F.length("run").cast("bigint")).cast("int")
    cut = F.concat(F.substring("run", 1, at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % DROP == 0, cut).otherwise(F.col("run"))
    counted = h.select(once(word).alias("word")).filter(F.length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= count)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit keys (finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash and next character of every prefix of at least half of a word."""
    for batch in slices(batches, 2048, 1 << 18):
        texts = batch.column(2).to_pylist()
        sizes = np.array([len(t) for t in texts], np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
        starts = np.cumsum(sizes) - sizes
        position = np.arange(len(codes)) - np.repeat(starts, sizes)
        side = np.repeat(batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64), sizes)
        # what a character at a position adds to a prefix is as good as random
        added = _mixed(_mixed((position.astype(np.uint64) << np.uint64(1)) | side) + codes)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(added, dtype=np.uint64)])
        least = np.maximum(sizes - 1, 0) // 2
        many = sizes - least + 1
        of = np.repeat(np.arange(len(texts)), many)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + least[of]
        # the empty prefixes of both sides are told apart, too
        node = sums[starts[of] + at] - sums[starts[of]] + batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)[of]
        ended = at == sizes[of]
        following = np.where(ended, -1, np.concatenate([codes, [0]])[starts[of] + at].astype(np.int64))
        for k in range(0, len(of), 1 << 17):
            part = slice(k, k + (1 << 17))
            yield pa.RecordBatch.from_pydict({
                "wid": batch.column(0).take(pa.array(of[part])), "at": pa.array(at[part], pa.int32()),
                "node": pa.array(node[part].view(np.int64)), "following": pa.array(following[part], pa.int32())})


def trie(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``paths`` (word, side, half, nodes on its way) and ``edges`` of both tries of the words in ``found``."""
    word = F.col("word")
    both = found.select(F.lit(0).alias("side"), word.alias("o")).union(found.select(F.lit(1), F.reverse(word)))
    oriented = staged(both.select(F.xxhash64("o", "side").alias("wid"), "side", "o"), "oriented")
    prefixes = map_rows(oriented, _prefixes, [
        T.StructField("wid", T.LongType()), T.StructField("at", T.IntegerType()),
        T.StructField("node", T.LongType()), T.StructField("following", T.IntegerType())])
    branching = staged(
        prefixes.groupBy("node").agg(F.min("following").alias("a"), F.max("following").alias("b")).filter("a <> b").select("node"), "nodes")
    on_way = prefixes.select("wid", "at", "node").join(branching, "node")
    ways = on_way.groupBy("wid").agg(F.array_sort(F.collect_list(F.struct("at", "node"))).alias("way"))
    size = F.length("o")
    # an edit behind the first half is found forwards, one in the first half backwards
    half = F.when(F.col("side") == 0, F.floor(size / 2)).otherwise(size - F.floor(size / 2)).cast("int")
    paths = staged(oriented.join(ways, "wid").select("side", "o", half.alias("half"), "way"), "paths")

    def edge(x: Column, i: Column) -> Column:
        following = F.get("way", i + 1)
        rest = F.substring(F.col("o"), x["at"] + 1, F.length("o"))
        label = F.when(following.isNull(), rest).otherwise(F.substring(F.col("o"), x["at"] + 1, following["at"] - x["at"]))
        return F.struct(x["node"].alias("node"), F.substring(rest, 1, 1).alias("c"), label.alias("label"),
                        following["node"].alias("child"), F.when(following.isNull(), F.col("o")).alias("end"))

    edges = paths.select(F.inline(F.transform("way", edge)))
    edges = staged(edges.distinct(), "edges")
    # what may follow behind an edge, so that a state that cannot go on there is not made
    following = edges.groupBy(F.col("node").alias("child")).agg(F.bit_or(_bit(F.col("c"))).alias("following"))
    inner = edges.filter(F.col("end").isNull()).join(following, "child").select(*edges.columns, "following")
    last = edges.filter(F.col("end").isNotNull()).withColumn("following", F.lit(0).cast("bigint"))
    return paths, staged(inner.union(last), "edges")


def _bit(text: Column) -> Column:
    """One of 64 bits for the first character of a text, or for its end."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.ascii(text).bitwiseAND(63))


def near_words(found: DataFrame) -> DataFrame:
    """``word``, ``near``: all ordered pairs of words in ``found`` that differ by exactly one code point."""
    paths, edges = trie(found)
    start = paths.select("side", "o", "half", F.explode("way").alias("x")).filter(F.col("x.at") >= F.col("half"))
    rest = F.col("rest")
    start = start.select("side", "o", F.col("x.node").alias("node"), F.substring(F.col("o"), F.col("x.at") + 1, F.length("o")).alias("rest"))

    def left(text: Column, label: Column) -> Column:
        """What is left of ``text`` behind a label; null if the label is not what comes next, if it is not all at a word's
        end, or if no edge behind it can go on."""
        behind = F.substring(text, F.length(label) + 1, F.length(text))
        goes_on = F.startswith(text, label) & (F.col("following").bitwiseAND(_bit(behind)) != 0)
        fits = F.when(F.col("end").isNull(), goes_on).otherwise(text == label)
        return F.when(fits, behind)

    tail = lambda text: F.substring(text, F.lit(2), F.length(text))
    replaced = F.when((F.col("c") != "") & (rest != ""), left(tail(rest), tail(F.col("label"))))
    inserted = F.when(F.col("c") != "", left(rest, tail(F.col("label"))))
    deleted = F.when(rest != "", left(tail(rest), F.col("label")))
    parted = start.withColumn("first", F.substring(rest, 1, 1)).join(edges, "node").filter(
        (F.col("c") != F.col("first")) & (replaced.isNotNull() | inserted.isNotNull() | deleted.isNotNull()))
    frontier = staged(
        parted.select("side", "o", "child", "end", F.explode(F.array(replaced, inserted, deleted)).alias("rest")).filter(rest.isNotNull()), "level")
    ends = []
    while True:
        ends.append(frontier.filter(F.col("end").isNotNull()).select("side", "o", "end"))
        going = frontier.filter(F.col("end").isNull()).select("side", "o", F.col("child").alias("node"), "rest", F.substring(rest, 1, 1).alias("c"))
        if going.isEmpty():
            break
        met = going.join(edges, ["node", "c"]).select("side", "o", "child", "end", left(rest, F.col("label")).alias("rest"))
        frontier = staged(met.filter(rest.isNotNull()), "level")
    turned = lambda c: F.when(F.col("side") == 0, F.col(c)).otherwise(F.reverse(c))
    pairs = reduce(DataFrame.union, ends).select("side", turned("o").alias("word"), turned("end").alias("near"))
    half = F.floor(F.length("word") / 2).cast("int")
    again = (F.col("side") == 1) & (F.substring("word", F.lit(1), half) == F.substring("near", F.lit(1), half))
    return pairs.filter(~again & (F.levenshtein("word", "near", 1) == 1)).select("word", "near").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word``, ``root`` for every word with a form: forms are followed to the last, in doubling steps."""
    to = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if to.join(step, "root", "left_semi").isEmpty():
            return to
        to = staged(to.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")


def group(found: DataFrame, times: int = TIMES) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for every row of ``found`` (``word``, ``n``; a written table)."""
    near = near_words(found).join(found.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near"))).alias("best"))
    is_form = -F.col("best.minus") >= times * F.col("n")
    joined = staged(found.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"),
        F.when(is_form, -F.col("best.minus")).alias("form_n")), "forms")
    last = roots(joined.filter(F.col("form").isNotNull()))
    return joined.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
