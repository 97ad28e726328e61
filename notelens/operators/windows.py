"""Metadata carried along token streams, and context windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelens.functions import text as tx
from notelens.operators.scale import carry_last, stage


def fill_metadata(ids: DataFrame, kind: str = "section", name: str = "metadata_id", across: bool = False) -> DataFrame:
    """Carry the latest metadata id of ``kind`` over the following positions; 0 before the first.

    ``across`` lets a note inherit the last value of the notes before it: one
    row per note is carried along the corpus, never the tokens.
    """
    by_doc = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("kind") == kind, F.col("id"))
    filled = ids.withColumn(name, F.last(own, ignorenulls=True).over(by_doc))
    zero = F.lit(0).cast("bigint")
    if not across:
        return filled.withColumn(name, F.coalesce(name, zero))
    ends = stage(ids.groupBy("doc_id").agg(F.max_by(own, F.when(own.isNotNull(), F.col("pos"))).alias("own")), "ends")
    carried = carry_last(ends, ["doc_id"], "own", "carried").select("doc_id", "carried")
    return filled.join(carried, "doc_id").withColumn(name, F.coalesce(name, "carried", zero)).drop("carried")


def fill_section_and_category(ids: DataFrame) -> DataFrame:
    """Carry section and category ids; a new category starts without a section."""
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(F.when(F.col("kind") == "category", 1).otherwise(0)).over(upto)
    in_run = Window.partitionBy("doc_id", "category_run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("bigint")

    def latest(kind: str, window) -> Column:
        own = F.when(F.col("kind") == kind, F.col("id"))
        return F.coalesce(F.last(own, ignorenulls=True).over(window), zero)

    return (
        ids.withColumn("category_run", run)
        .withColumn("section_id", latest("section", in_run))
        .withColumn("category_id", latest("category", in_run))
        .drop("category_run")
    )


def token_metadata(filled: DataFrame, metadata: str = "metadata_id", compat: bool = False) -> DataFrame:
    """``(id, metadata_id, n)``: how often each word stands under each metadata value.

    ``compat`` counts the category tokens as words, too.
    """
    rows = filled.where(F.col("kind") != "section") if compat else filled.where(F.col("kind") == "token")
    return rows.groupBy("id", metadata).agg(F.count(F.lit(1)).alias("n"))


def context_windows(ids: DataFrame, size: int, keep: tuple[str, ...] = (), value: str = "id") -> DataFrame:
    """Ids (or another ``value``) up to ``size`` positions left and right of each word, not crossing metadata tokens."""
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    is_meta = F.col("kind") != "token"
    in_run = Window.partitionBy("doc_id", "run").orderBy("pos")
    return (
        ids.withColumn("run", F.sum(F.when(is_meta, 1).otherwise(0)).over(upto))
        .withColumn("context_id", F.when(~is_meta, F.col(value)))
        .withColumn("left_ids", F.collect_list("context_id").over(in_run.rowsBetween(-size, -1)))
        .withColumn("right_ids", F.collect_list("context_id").over(in_run.rowsBetween(1, size)))
        .where(~is_meta)
        .select("doc_id", "pos", "gpos", F.col("id").alias("center_id"), "left_ids", "right_ids", *keep)
    )


def window_around(tokens: Column, target: Column, size: int, low: Column | None = None,
                  high: Column | None = None, with_target: bool = False) -> Column:
    """Tokens within ``size`` of the 0-based index ``target``, inside ``[low, high)``."""
    start = F.greatest(target - size, F.lit(0), low if low is not None else F.lit(0))
    end = F.least(target + size + 1, F.size(tokens), high if high is not None else F.size(tokens))
    left = F.slice(tokens, start + 1, F.greatest(target - start, F.lit(0)))
    right = F.slice(tokens, target + 2, F.greatest(end - target - 1, F.lit(0)))
    if with_target:
        return F.concat(left, F.slice(tokens, target + 1, F.lit(1)), right)
    return F.concat(left, right)


def header_positions(tokens: Column) -> Column:
    """0-based positions of the section tokens in an array."""
    marks = F.transform(tokens, lambda t, i: F.when(tx.is_section_token(t), i))
    return F.filter(marks, lambda i: i.isNotNull())


def nearest_headers(tokens: Column, target: Column) -> Column:
    """``struct(left, right)``: nearest header position before and after ``target``, null if none."""
    at = header_positions(tokens)
    return F.struct(
        F.array_max(F.filter(at, lambda p: p < target)).alias("left"),
        F.array_min(F.filter(at, lambda p: p > target)).alias("right"),
    )


def last_before(events: DataFrame, probes: DataFrame, key: str, at: str, value: str, default: str) -> DataFrame:
    """As-of lookup: for each probe the last event of its key at or before its position.

    Events and probes are merged and filled in one ordered pass, so the pairs
    of a key are never built.
    """
    marks = events.select(key, at, F.lit(0).alias("_side"), F.col(value), F.lit(None).alias("_probe"))
    asks = probes.select(
        key, at, F.lit(1).alias("_side"), F.lit(None).cast("string").alias(value), F.struct(*probes.columns).alias("_probe")
    )
    marks = marks.withColumn("_probe", F.lit(None).cast(asks.schema["_probe"].dataType))
    order = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return (
        marks.unionByName(asks)
        .withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(order), F.lit(default)))
        .where(F.col("_side") == 1)
        .select("_probe.*", value)
    )


#: Characters of names in one automaton, and of the names that it reads in one task.
PART_CHARS = 4_000_000


def contained_names(names: DataFrame, name: str = "section") -> DataFrame:
    """``pairs(container, inside)``: names that occur in another one behind its first character.

    Names are dealt into parts; the automaton of a part reads every name once, in blocks, so the work follows the total
    length of the names and the rows are the pairs themselves. With few names there is one part, and blocks for all cores.
    """
    import ahocorasick
    import pyarrow as pa

    whole = names.select(F.col(name).alias("name")).where(F.length(name) > 0).distinct()
    chars = whole.agg(F.sum(F.length("name"))).first()[0] or 0
    parts = max(1, -(-chars // PART_CHARS))
    blocks = max(parts, names.sparkSession.sparkContext.defaultParallelism)
    deal = lambda n, seed: F.pmod(F.xxhash64("name", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    known = whole.select("name", deal(parts, 1).alias("part")).select("name", "part", every(blocks).alias("block"))
    read = whole.select("name", deal(blocks, 2).alias("block")).select("name", every(parts).alias("part"), "block")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        automaton = ahocorasick.Automaton()
        for text in left["name"].to_pylist():
            automaton.add_word(text, text)
        containers, inside = [], []
        if left.num_rows:
            automaton.make_automaton()
            for text in right["name"].to_pylist():
                found = {word for end, word in automaton.iter(text) if end >= len(word)}
                containers += [text] * len(found)
                inside += sorted(found)
        return pa.table({"container": pa.array(containers, pa.string()), "inside": pa.array(inside, pa.string())})

    by = ["part", "block"]
    return known.groupBy(*by).cogroup(read.groupBy(*by)).applyInArrow(meet, "container string, inside string")


def header_levels(sections: DataFrame, max_levels: int = 10) -> DataFrame:
    """``(section, level)``: names that lie inside a longer name come on later levels.

    A name is contained when it occurs in the other behind its first
    character. The level is the length of the longest chain of containing
    names.
    """
    names = sections.select("section")
    pairs = stage(contained_names(sections), "section-pairs")
    level = names.select("section", F.lit(0).alias("level"))
    for _ in range(max_levels - 1):
        deeper = (
            pairs.join(level.withColumnRenamed("section", "container"), "container")
            .groupBy(F.col("inside").alias("section"))
            .agg((F.max("level") + 1).alias("below"))
        )
        raised = level.join(deeper, "section", "left").select(
            "section", F.coalesce("below", F.lit(0)).alias("level")
        )
        level = stage(raised, "section-levels")
        if level.agg(F.max("level")).first()[0] < _ + 1:
            break
    return level


def occurrence_ordinal(text: Column, word: Column, start: Column) -> Column:
    """0-based ordinal of the whole-word occurrence of ``word`` that starts at ``start``; null if none does.

    The text before ``start`` tells the ordinal: it is the number of
    occurrences that end there, given that one begins at ``start``.
    """
    edge = rf"(?<![{tx.WORD_CHARS}])"
    pattern = F.concat(F.lit(edge + r"\Q"), word, F.lit(rf"\E(?![{tx.WORD_CHARS}])"))
    here = F.regexp_count(F.substring(text, F.lit(1), start + F.length(word) + 1), pattern)
    before = F.regexp_count(F.substring(text, F.lit(1), F.greatest(start + F.length(word) - 1, F.lit(0))), pattern)
    fits = F.substring(text, start + 1, F.length(word)) == word
    return F.when(fits & (here == before + 1), before)


def nth_position(tokens: Column, word: Column, ordinal: Column) -> Column:
    """0-based index of the ``ordinal``-th (0-based) token equal to ``word``; null if there is none."""
    at = F.filter(F.transform(tokens, lambda t, i: F.when(t == word, i)), lambda i: i.isNotNull())
    return F.get(at, ordinal)
