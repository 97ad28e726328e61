"""Evaluation of rankings: accuracy, top-k, per-class and per-short-form reports, bootstrap, comparison."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelens.functions.hashing import uniform
from notelens.operators.scale import sized


def rank_candidates(scores: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per example: best sense, rank of the target, number of candidates.

    ``scores(row_idx, lf_idx, score, target, ...)``. One grouping brings the
    few candidates of an example together; the target's rank counts those
    ahead of it. A target that is no candidate ranks behind all of them.
    """
    order = F.struct((-F.col("score")).alias("s"), "lf_idx")
    own = F.min(F.when(F.col("lf_idx") == F.col("target"), order))
    grouped = scores.groupBy("row_idx", *(keep or [])).agg(
        F.first("target").alias("target"), F.min_by("lf_idx", order).alias("pred"),
        own.alias("_own"), F.collect_list(order).alias("_all"), F.count(F.lit(1)).alias("n_candidates"),
    )
    ahead = F.size(F.filter("_all", lambda c: F.coalesce(c < F.col("_own"), F.lit(True)))).cast("bigint")
    return grouped.withColumn("rank", ahead + 1).drop("_own", "_all")


def accuracy(ranked: DataFrame) -> DataFrame:
    return ranked.agg(F.avg((F.col("pred") == F.col("target")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def top_k_accuracy(ranked: DataFrame, ks: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Share of targets among the first k; a k beyond the candidates counts as a hit."""
    known = F.col("rank") <= F.col("n_candidates")
    hit = lambda k: known & ((F.col("rank") <= k) | (F.lit(k) > F.col("n_candidates")))
    return ranked.agg(*[(F.count_if(hit(k)) / F.count(F.lit(1))).alias(f"top_{k}") for k in ks])


def confusion(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("sf", "target", "pred").agg(F.count(F.lit(1)).alias("n"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def class_report(cells: DataFrame) -> DataFrame:
    """``(sf, lf_idx, support, predicted, hits, precision, recall, f1)`` from confusion cells ``(sf, target, pred, n)``.

    Each cell feeds its true and its predicted class, so one grouping gives
    both margins. Undefined ratios are 0.
    """
    n, none = F.col("n"), F.lit(0).cast("bigint")
    hit = F.col("target") == F.col("pred")
    sides = F.inline(F.array(
        F.struct(F.col("target").alias("lf_idx"), n.alias("support"), none.alias("predicted"), F.when(hit, n).otherwise(none).alias("hits")),
        F.struct(F.col("pred").alias("lf_idx"), none.alias("support"), n.alias("predicted"), none.alias("hits")),
    ))
    sums = cells.select("sf", sides).groupBy("sf", "lf_idx").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "hits")]
    )
    precision, recall = _ratio(F.col("hits"), F.col("predicted")), _ratio(F.col("hits"), F.col("support"))
    return sums.withColumn("precision", precision).withColumn("recall", recall).withColumn(
        "f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )


def sf_report(classes: DataFrame) -> DataFrame:
    """Macro (classes with support only), weighted and micro averages per short form."""
    out = []
    for m in ("precision", "recall", "f1"):
        out.append(_ratio(F.sum("hits"), F.sum("support")).alias(f"micro_{m}"))
        out.append(F.avg(F.when(F.col("support") > 0, F.col(m))).alias(f"macro_{m}"))
        out.append(_ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(f"weighted_{m}"))
    return classes.groupBy("sf").agg(F.sum("support").alias("support"), *out)


def with_target_counts(report: DataFrame, senses: DataFrame) -> DataFrame:
    sizes = senses.groupBy("sf").agg(F.count(F.lit(1)).alias("num_targets"))
    return report.join(sized(sizes), "sf")


def global_means(report: DataFrame) -> DataFrame:
    """Means over short forms, per number of candidate senses and (null) over all."""
    names = [f"{a}_{b}" for a in ("weighted", "macro") for b in ("precision", "recall", "f1")]
    return report.rollup("num_targets").agg(*[F.avg(c).alias(c) for c in names], F.count(F.lit(1)).alias("n_sf"))


def rare_recall(classes: DataFrame, counted_senses: DataFrame, threshold: int = 5) -> DataFrame:
    """Mean recall of senses with some but fewer than ``threshold`` corpus contexts."""
    rare = counted_senses.where((F.col("count") > 0) & (F.col("count") < threshold)).select("sf", "lf_idx").distinct()
    return classes.join(rare, ["sf", "lf_idx"], "left_semi").agg(
        F.avg("recall").alias("recall"), F.count(F.lit(1)).alias("n_rare")
    )


def example_report(ranked: DataFrame) -> DataFrame:
    """Correctness flag and a readable line per example (``sf, context, target_lf, pred_lf``)."""
    line = F.format_string(
        "SF=%s. Target LF=%s. Predicted LF=%s. Context: %s", "sf", "target_lf", "pred_lf", "context"
    )
    return ranked.select("row_idx", "sf", (F.col("pred") == F.col("target")).alias("is_correct"), line.alias("line"))


def chance_statistics(examples: DataFrame, senses: DataFrame) -> DataFrame:
    """Accuracy of always taking the commonest sense, and expected accuracy of guessing."""
    per_class = examples.groupBy("sf", "target").agg(F.count(F.lit(1)).alias("n"))
    per_sf = per_class.groupBy("sf").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    both = with_target_counts(per_sf, senses)
    return both.agg(
        (F.sum("most") / F.sum("n")).alias("dominant_accuracy"),
        (F.sum(F.col("n") / F.col("num_targets")) / F.sum("n")).alias("random_accuracy"),
    )


def bootstrap(outcomes: DataFrame, iterations: int = 100, share: float = 0.8, seed: int = 0) -> DataFrame:
    """Metrics on random subsets, one row per iteration, in one pass over ``(row_idx, sf, target, pred, loss)``.

    ``accuracy``, ``weighted_f1``, ``macro_f1`` (means over short forms) and ``log_loss``, with the rows ``n``. A row's part
    in all iterations is one vector of zeros and ones, and one of its losses; these are summed by confusion cell. No row
    becomes one for each iteration, and only cells are shuffled.
    """
    every = F.sequence(F.lit(0), F.lit(iterations - 1))
    one, zero = F.lit(1.0), F.lit(0.0)
    drawn = outcomes.select("sf", "target", "pred", F.coalesce("loss", zero).alias("loss"), F.transform(
        every, lambda i: F.when(uniform("row_idx", i, seed=seed) < share, one).otherwise(zero)).alias("kept"))
    lost = F.transform("kept", lambda k: F.when(k > 0, F.col("loss")).otherwise(zero))
    total = vector_to_array(Summarizer.sum(array_to_vector(F.concat("kept", lost))))
    sums = drawn.groupBy("sf", "target", "pred").agg(total.alias("total"))
    cells = sums.select("sf", "target", "pred", F.inline(F.transform(every, lambda i: F.struct(
        i.alias("iteration"), F.round(F.get("total", i)).cast("bigint").alias("n"), F.get("total", i + iterations).alias("loss"))))).where("n > 0")
    n, none = F.col("n"), F.lit(0).cast("bigint")
    hits = F.when(F.col("target") == F.col("pred"), n).otherwise(none)
    sides = F.inline(F.array(
        F.struct(F.col("target").alias("lf_idx"), n.alias("support"), none.alias("predicted"), hits.alias("hits"), F.col("loss").alias("loss")),
        F.struct(F.col("pred").alias("lf_idx"), none.alias("support"), n.alias("predicted"), none.alias("hits"), zero.alias("loss")),
    ))
    classes = cells.select("iteration", "sf", sides).groupBy("iteration", "sf", "lf_idx").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "hits", "loss")])
    f1 = _ratio(2.0 * F.col("hits"), F.col("support") + F.col("predicted"))
    per_sf = classes.groupBy("iteration", "sf").agg(
        *[F.sum(c).alias(c) for c in ("support", "hits", "loss")], F.avg(F.when(F.col("support") > 0, f1)).alias("macro_f1"),
        _ratio(F.sum(f1 * F.col("support")), F.sum("support")).alias("weighted_f1"))
    return per_sf.groupBy("iteration").agg(
        (F.sum("hits") / F.sum("support")).alias("accuracy"), F.avg("weighted_f1").alias("weighted_f1"),
        F.avg("macro_f1").alias("macro_f1"), (F.sum("loss") / F.sum("support")).alias("log_loss"), F.sum("support").alias("n"))


def describe(values: DataFrame, column: str) -> DataFrame:
    """Count, extremes, mean, sample variance, skewness and kurtosis in one aggregate."""
    c = F.col(column)
    return values.agg(
        F.count(c).alias("n"), F.min(c).alias("least"), F.max(c).alias("most"), F.avg(c).alias("mean"),
        F.var_samp(c).alias("variance"), F.skewness(c).alias("skewness"), F.kurtosis(c).alias("kurtosis"),
    )


def canonical_labels(labels: DataFrame) -> DataFrame:
    """The one label of each sense; fails when a sense has two.

    Two aggregates tell whether there is more than one, so labels are never collected.
    """
    ends = labels.groupBy("target_lf_sense").agg(F.min("target_label").alias("low"), F.max("target_label").alias("high"))
    guard = F.raise_error(F.concat(F.lit("more than one label for "), F.col("target_lf_sense"))).cast("string")
    return ends.select("target_lf_sense", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(guard).alias("target_label"))


def paired_outcomes(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(row_idx, a, b)``; rows known to one side only fail, as both sides must hold the same rows."""
    pairs = a.select("row_idx", F.col("is_correct").alias("a")).join(
        b.select("row_idx", F.col("is_correct").alias("b")), "row_idx", "full"
    )
    guard = F.raise_error(F.lit("outcomes of different rows")).cast("boolean")
    return pairs.select("row_idx", F.coalesce("a", guard).alias("a"), F.coalesce("b", guard).alias("b"))


def comparison_sets(pairs: DataFrame) -> DataFrame:
    """Which rows both, none or only one of the experiments got right."""
    part = (
        F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "only_a").when(F.col("b"), "only_b").otherwise("neither")
    )
    return pairs.select("row_idx", part.alias("part"))


def agreement(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def disagreement_draw(pairs: DataFrame, k: int = 10, seed: int = 0) -> DataFrame:
    """``k`` hash-drawn rows of each kind of disagreement."""
    u = uniform("row_idx", seed=seed)
    only = lambda cond, name: (
        pairs.where(cond).select("row_idx", F.lit(name).alias("part"), u.alias("u")).orderBy("u", "row_idx").limit(k)
    )
    both = only(F.col("a") & ~F.col("b"), "only_a").unionByName(only(~F.col("a") & F.col("b"), "only_b"))
    return both.select("row_idx", "part")


