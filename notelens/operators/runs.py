"""Queries over the metrics that training runs leave behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of a stretch that one task orders.
STEPS = 200_000
STATS = ["log_loss", "accuracy", "weighted_f1", "macro_f1"]


def best_step(metrics: DataFrame) -> DataFrame:
    """Per experiment and dataset the row at the experiment's least joint loss (first by ``examples``)."""
    joint = metrics.withColumn("joint_loss", F.col("lm_kl") + F.col("lm_recon"))
    least = joint.groupBy("experiment").agg(F.min("joint_loss").alias("joint_loss"))
    at_best = joint.join(least, ["experiment", "joint_loss"])
    row = F.min_by(F.struct("examples", *STATS), "examples").alias("row")
    return at_best.groupBy("experiment", "dataset").agg(row).select("experiment", "dataset", "row.*")


def spread_of_models(best: DataFrame) -> DataFrame:
    """Per dataset and statistic: value of the worst, the average and the best model by log-loss."""
    worst = [F.max_by(s, F.struct("log_loss", "experiment")).alias(f"{s}_worst") for s in STATS]
    mean = [F.avg(s).alias(f"{s}_mean") for s in STATS]
    good = [F.min_by(s, F.struct("log_loss", "experiment")).alias(f"{s}_best") for s in STATS]
    wide = best.groupBy("dataset").agg(*worst, *mean, *good)
    rows = F.inline(F.array(*[F.struct(
        F.lit(s).alias("stat"), F.col(f"{s}_worst").alias("worst"), F.col(f"{s}_mean").alias("mean"), F.col(f"{s}_best").alias("best")
    ) for s in STATS]))
    return wide.select("dataset", rows)


def cross_selected(metrics: DataFrame, one: str, other: str) -> DataFrame:
    """Metrics of each dataset at the step where the *other* dataset has its least loss."""
    chosen = metrics.where(F.col("dataset").isin(one, other)).groupBy("experiment", "dataset").agg(
        F.min_by("examples", F.struct("log_loss", "examples")).alias("examples"))
    swapped = chosen.select("experiment", "examples", F.when(F.col("dataset") == one, F.lit(other)).otherwise(F.lit(one)).alias("dataset"))
    return metrics.join(swapped, ["experiment", "dataset", "examples"])


def examples_seen(epoch: Column, step: Column, batches: int, batch_size: int) -> Column:
    """Examples seen after the 0-based ``step`` of the 1-based ``epoch``."""
    return ((epoch - 1) * batches + step + 1) * batch_size


def running_mean(losses: DataFrame) -> DataFrame:
    """Mean loss so far inside each epoch; an epoch holds one row per training step.

    Steps are cut into stretches: the sums of the earlier stretches of an epoch are added to the running sums inside each,
    so an epoch of any length is ordered in parts.
    """
    placed = losses.withColumn("_stretch", F.floor(F.col("step") / STEPS))
    group = ["experiment", "epoch"]
    sums = placed.groupBy(*group, "_stretch").agg(F.sum("loss").alias("_sum"), F.count("loss").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sums.select(*group, "_stretch", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_sum", "_n")])
    upto = Window.partitionBy(*group, "_stretch").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("_sum_before") + F.coalesce(F.sum("loss").over(upto), F.lit(0.0))
    seen = F.col("_n_before") + F.count("loss").over(upto)
    a, b = placed.alias("a"), earlier.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*group, "_stretch")]
    joined = a.join(b, same).select("a.*", "_sum_before", "_n_before")
    return joined.withColumn("mean_loss", total / F.nullif(seen, F.lit(0))).drop("_stretch", "_sum_before", "_n_before")
