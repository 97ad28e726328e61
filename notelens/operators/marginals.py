"""How metadata depends on the sense: counts, probabilities, pruning, smoothed splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelens.functions.hashing import uniform
from notelens.operators.scale import rank_in_group, stage


def _shares(counts: DataFrame, group: list[str]) -> DataFrame:
    totals = counts.groupBy(*group).agg(F.sum("n").alias("_total"))
    return counts.join(totals, group).withColumn("p", F.col("n") / F.col("_total")).drop("_total")


def marginals(examples: DataFrame, lf: str, metadata: list[str]) -> DataFrame:
    """``(kind, lf, metadata, n, p)`` for several metadata columns in one pass over the examples."""
    pairs = F.inline(F.array(*[F.struct(F.lit(m).alias("kind"), F.col(m).alias("metadata")) for m in metadata]))
    counts = examples.select(F.col(lf).alias("lf"), pairs).groupBy("kind", "lf", "metadata").agg(F.count(F.lit(1)).alias("n"))
    return _shares(counts, ["kind", "lf"])


def prune_singletons(counts: DataFrame) -> DataFrame:
    """Drop metadata seen once with a sense, unless the sense has nothing else; renormalize."""
    largest = counts.groupBy("lf").agg(F.max("n").alias("_most"))
    kept = counts.join(largest, "lf").where((F.col("n") > 1) | (F.col("_most") == 1)).drop("_most", "p")
    return _shares(kept, ["lf"])


#: Observations that one row expands to.
UNITS = 10_000


def split_marginals(counts: DataFrame, share: float = 0.75, seed: int = 0) -> DataFrame:
    """``(lf, metadata, part, n, p)``: the counted observations split in two, one added on both sides.

    Each observation gets a hash rank inside its sense; a sense with very many
    observations is ranked in slices.
    """
    # blocks first, so that no row holds an array as long as a count
    blocks = counts.select("lf", "metadata", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("n") - 1).cast("bigint"), F.lit(UNITS))).alias("at"))
    units = blocks.select("lf", "metadata", F.explode(F.sequence(F.col("at") + 1, F.least(F.col("at") + UNITS, F.col("n")))).alias("unit"))
    drawn = stage(units.withColumn("_u", uniform("lf", "metadata", "unit", seed=seed)), "units")
    ranked = rank_in_group(drawn, ["lf"], "_u", ["metadata", "unit"], "_rank")
    sizes = counts.groupBy("lf").agg(F.floor(F.sum("n") * share).alias("_cut"))
    parts = ranked.join(sizes, "lf").groupBy("lf", "metadata").agg(
        F.count_if(F.col("_rank") <= F.col("_cut")).alias("train"), F.count_if(F.col("_rank") > F.col("_cut")).alias("val")
    )
    long = parts.select("lf", "metadata", F.inline(F.array(
        F.struct(F.lit("train").alias("part"), (F.col("train") + 1).alias("n")),
        F.struct(F.lit("val").alias("part"), (F.col("val") + 1).alias("n")),
    )))
    return _shares(long, ["lf", "part"])


#: Cells of a sense that are drawn one after the other.
CELLS = 4096


def _drawn(key: list[str], seed: int):
    """A function of pandas groups: how many of each row's ``n`` are among the ``take`` drawn of all, one row after the other."""
    import hashlib

    import numpy as np
    import pandas as pd

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("order", kind="stable")
        name = ":".join(str(rows[c].iloc[0]) for c in key)
        generator = np.random.default_rng(int.from_bytes(hashlib.sha256(f"{name}:{seed}".encode()).digest()[:8], "big"))
        left, take, taken = int(rows["n"].sum()), int(rows["take"].iloc[0]), []
        for n in rows["n"].tolist():
            # beyond a billion the generator has no such draw; a row in shares of its own is as good there
            drawn = _hypergeometric(generator, n, left - n, take)
            taken.append(drawn)
            left, take = left - n, take - drawn
        return rows.assign(taken=np.array(taken, dtype=np.int64))

    return one


def _hypergeometric(generator, good: int, bad: int, take: int) -> int:
    """How many of ``take`` drawn things are among ``good`` ones; very large counts by the normal limit, kept in bounds."""
    least, most = max(0, take - bad), min(good, take)
    if least == most:
        return least
    if good + bad < 1_000_000_000:
        return int(generator.hypergeometric(good, bad, take))
    total = good + bad
    share = good / total
    deviation = (take * share * (1 - share) * (total - take) / (total - 1)) ** 0.5
    return min(most, max(least, round(take * share + deviation * generator.standard_normal())))


def draw_split(counts: DataFrame, share: float = 0.75, seed: int = 0) -> DataFrame:
    """``(lf, metadata, part, n, p)`` as ``split_marginals``, drawn from the counts without a row for each observation.

    How many of a cell's observations fall to the first part is hypergeometric, given what earlier cells took; a sense's
    cells are drawn in blocks of at most about ``CELLS``, whose totals are drawn the same way first. So the rows are the
    cells, no group is unbounded, and a sense's parts have their exact sizes. Draws depend on names, order and seed only.
    """
    cells = counts.select("lf", "metadata", F.col("n").cast("bigint").alias("n"))
    sizes = cells.groupBy("lf").agg(F.count(F.lit(1)).alias("cells"), F.floor(F.sum("n") * share).cast("bigint").alias("take"))
    many = F.ceil(F.col("cells") / CELLS)
    placed = stage(cells.join(sizes, "lf").withColumn("block", F.pmod(F.xxhash64("metadata"), many)), "cells")
    blocks = placed.groupBy("lf", "block").agg(F.sum("n").alias("n"), F.first("take").alias("take"))
    of_block = blocks.withColumn("order", F.col("block")).groupBy("lf").applyInPandas(
        _drawn(["lf"], seed), "lf string, block long, n long, take long, order long, taken long")
    asked = placed.drop("take", "cells").join(of_block.select("lf", "block", F.col("taken").alias("take")), ["lf", "block"])
    drawn = asked.withColumn("order", F.col("metadata").cast("string")).groupBy("lf", "block").applyInPandas(
        _drawn(["lf", "block"], seed), T.StructType([*asked.schema.fields, T.StructField("order", T.StringType()), T.StructField("taken", T.LongType())]))
    long = drawn.select("lf", "metadata", F.inline(F.array(
        F.struct(F.lit("train").alias("part"), (F.col("taken") + 1).alias("n")),
        F.struct(F.lit("val").alias("part"), (F.col("n") - F.col("taken") + 1).alias("n")),
    )))
    return _shares(long, ["lf", "part"])


def sense_breakdown(examples: DataFrame, metadata: str = "section") -> DataFrame:
    """Counts per short form, sense and metadata value, with subtotals per sense and short form."""
    return examples.rollup("sf", "target_lf", metadata).agg(F.count(F.lit(1)).alias("n")).where(F.col("sf").isNotNull())


def baseline_means(report: DataFrame) -> DataFrame:
    """Means of the baseline's metrics over the short forms."""
    names = ("accuracy", "macro_f1", "weighted_f1")
    return report.agg(*[F.avg(c).alias(c) for c in names], F.count(F.lit(1)).alias("n_sf"))


def dominant_metadata_baseline(train: DataFrame, val: DataFrame, senses: DataFrame) -> DataFrame:
    """``(sf, accuracy, macro_f1, weighted_f1)`` when the metadata value alone picks the sense.

    Every value predicts the sense with the largest p(metadata | sense), an
    unseen value the sense with the most observations; ties go to the later
    sense. Inputs are counts per ``(lf, metadata)``, never single rows.
    """
    from notelens.operators.evaluation import class_report, sf_report

    senses = senses.select("sf", "lf", "lf_idx")
    known = train.join(senses, "lf")
    totals = senses.join(train.groupBy("lf").agg(F.sum("n").alias("n")), "lf", "left").groupBy("sf").agg(
        F.max_by("lf_idx", F.struct(F.coalesce("n", F.lit(0)), "lf_idx")).alias("default_idx")
    )
    best = known.groupBy("sf", "metadata").agg(F.max_by("lf_idx", F.struct("p", "lf_idx")).alias("best_idx"))
    seen = val.join(senses.withColumnRenamed("lf_idx", "target"), "lf")
    outcome = (
        seen.join(best, ["sf", "metadata"], "left").join(totals, "sf")
        .select("sf", "target", F.coalesce("best_idx", "default_idx").alias("pred"), "n")
        .groupBy("sf", "target", "pred").agg(F.sum("n").alias("n"))
    )
    report = sf_report(class_report(outcome))
    return report.select("sf", F.col("micro_f1").alias("accuracy"), "macro_f1", "weighted_f1")
