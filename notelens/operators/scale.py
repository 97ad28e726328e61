"""Building blocks that keep plans whole and even when keys are hot.

* ``stage``        writes a table once and reads it back, so that several users
                   of an expensive result do not recompute it and a lost
                   executor costs one stage only.
* ``stage_by``     the same, bucketed and sorted by a key.
* ``lookup_join``  joins a keyed table; it broadcasts it when its measured size
                   allows, else splits the hottest keys off.
* ``number_rows``, ``running_total``, ``carry_last``
                   totally ordered results without a one-task window.
* ``rank_in_group``, ``first_k_in_group``
                   ranks inside groups of any size.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelens.session import stage_dir

#: Largest measured payload that is broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024
#: Rows one task may order in a window.
ROWS_PER_TASK = 200_000
#: Most ranges an order is cut into; also bounds the rows of the table of ranges. Beyond ROWS_PER_TASK * MAX_BUCKETS rows
#: a task sorts more rows (sorts spill to disk).
MAX_BUCKETS = 100_000
#: A key is hot when it holds at least this share of the total weight, so at
#: most 1 / HOT_SHARE keys can be hot.
HOT_SHARE = 1e-4


#: How stage tables are written: their disk space counts, and each is read a few times only. Numbers that rise are kept as
#: differences, and words as places in a dictionary that may be larger than usual.
STAGE_FORMAT = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.dictionary.page.size": str(8 << 20)}


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` below the shared stage folder and read it back."""
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**STAGE_FORMAT).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, key: str, order: str, name: str = "stage") -> DataFrame:
    """As ``stage``, but bucketed by ``key`` and sorted: windows and groups by ``key`` then need no exchange.

    The buckets are as many as the session has shuffle partitions. Where ``df`` comes out of a grouping by ``key``, or out
    of such a table, its tasks hold whole buckets already and nothing is moved for the write.
    """
    spark = df.sparkSession
    unique = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = f"{stage_dir(spark)}/{unique}"
    rising = {f"parquet.enable.dictionary#{order}": "false"}  # places of a group: their differences are shorter
    df.write.format("parquet").options(path=path, **STAGE_FORMAT, **rising).bucketBy(buckets, key).sortBy(key, order).saveAsTable(unique)
    return spark.table(unique)


def _cell_bytes(field: T.StructField) -> Column:
    cell = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(cell), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.NumericType):
        return F.coalesce(F.size(cell), F.lit(0)) * 8 + 24
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(cell))), F.lit(0)) + 24
    return F.lit(8)


def payload_bytes(df: DataFrame) -> int:
    """The measured payload of ``df``; numbers in arrays count eight bytes each."""
    size = sum((_cell_bytes(f).cast("bigint") for f in df.schema.fields), F.lit(16).cast("bigint"))
    return df.agg(F.sum(size)).first()[0] or 0


def fits_broadcast(df: DataFrame, max_bytes: int | None = None) -> bool:
    """Whether the measured payload of ``df`` stays below the broadcast bound."""
    return payload_bytes(df) <= (BROADCAST_BYTES if max_bytes is None else max_bytes)


def sized(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint when its measured size allows one."""
    return F.broadcast(df) if fits_broadcast(df) else df


#: Keys that the sketch of frequent keys tracks; its counts are too high by at most 3.5 / TRACKED of all rows.
TRACKED = 1 << 17


def frequent_keys(df: DataFrame, key: str, share: float) -> list:
    """All keys that hold at least ``share`` of the rows with a key, and maybe a few that hold nearly as much.

    One pass with a mergeable sketch of bounded size. What it counts too much is bounded, and it counts nothing too little,
    so no frequent key is missed; the list is no longer than the keys that can hold the share less that bound.
    """
    slack = 3.5 / TRACKED
    if share <= 2 * slack:
        raise ValueError(f"shares of {2 * slack} and less are too small for the sketch")
    most = math.ceil(1 / (share - slack))
    rows, found = df.where(F.col(key).isNotNull()).agg(
        F.count(F.lit(1)), F.expr(f"approx_top_k(`{key}`, {min(most, TRACKED)}, {TRACKED})")).first()
    return [x["item"] for x in found if x["count"] >= share * rows]


def lookup_join(
    left: DataFrame, right: DataFrame, on: str, how: str = "inner", weight: str | None = None
) -> DataFrame:
    """Join ``left`` to the keyed table ``right`` (one row per key, already staged).

    Beyond the broadcast bound, ``weight`` (a column of ``right``: how often
    each key occurs on the left; none: a sketch of the left side finds the frequent ones) tells the hot keys. There are at most ``1 / HOT_SHARE`` of them, and
    their rows are broadcast if their measured size allows it; the other keys
    are shuffled. Rows already served, and rows with a null key, get
    spread-out keys that match nothing. A key without a weight is not hot.
    """
    if fits_broadcast(right):
        return left.join(F.broadcast(right), on, how)
    payload = [c for c in right.columns if c != on]
    if weight is None:
        keys = [(k, True) for k in frequent_keys(left, on, HOT_SHARE)]
        schema = T.StructType([T.StructField(on, left.schema[on].dataType), T.StructField("_is_hot", T.BooleanType())])
        listed = left.sparkSession.createDataFrame(keys, schema)  # 1 / HOT_SHARE rows, about, at most
        right = right.join(F.broadcast(listed), on, "left")
        is_hot = F.coalesce("_is_hot", F.lit(False))
    else:
        cut = (right.agg(F.sum(weight)).first()[0] or 0) * HOT_SHARE
        is_hot = F.coalesce(F.col(weight) >= F.lit(cut), F.lit(False)) & F.lit(cut > 0)
    if not fits_broadcast(right.where(is_hot)):
        is_hot = F.lit(False)
    hot = right.where(is_hot).select(on, F.struct(*payload).alias("_hot"))
    cold = right.where(~is_hot).select(
        F.col(on).cast("string").alias("_cold_key"), F.struct(*payload).alias("_cold")
    )
    spread = F.concat(F.lit("\u0000"), F.xxhash64(*left.columns).cast("string"))
    marked = left.join(F.broadcast(hot), on, "left").withColumn(
        "_key", F.when(F.col("_hot").isNotNull() | F.col(on).isNull(), spread).otherwise(F.col(on).cast("string"))
    )
    found = marked.join(cold, F.col("_key") == F.col("_cold_key"), "left").withColumn(
        "_found", F.coalesce("_hot", "_cold")
    )
    if how == "inner":
        found = found.where(F.col("_found").isNotNull())
    return found.select(*left.columns, *[F.col(f"_found.{c}").alias(c) for c in payload])


#: Most parts a table of wide rows is broadcast in.
WIDE_PARTS = 8


def wide_lookup(left: DataFrame, right: DataFrame, on: dict[str, str], payload: Sequence[str]) -> DataFrame | None:
    """``left`` with the struct ``name`` of a row of ``right(id, ...)`` for each ``name: column of left`` in ``on``; null where none is.

    Where the looked-up rows are much wider than those of ``left``, moving them to each of its rows costs many times
    the input. The table (one row per ``id``, staged) is broadcast instead, in up to ``WIDE_PARTS`` parts within the broadcast
    bound each, and the rows of ``left`` stay where they are. None if it is larger than that.
    """
    parts = max(1, math.ceil(payload_bytes(right) / (BROADCAST_BYTES * 0.9)))
    if parts > WIDE_PARTS:
        return None
    rows, part = left, F.pmod(F.xxhash64("id"), F.lit(parts))
    for name, column in on.items():
        for k in range(parts):
            one = right.where(part == k) if parts > 1 else right
            side = one.select(F.col("id").alias(f"_id_{name}_{k}"), F.struct(*payload).alias(f"_{name}_{k}"))
            rows = rows.join(F.broadcast(side), F.col(column) == F.col(f"_id_{name}_{k}"), "left")
    return rows.select(*left.columns, *[F.coalesce(*[F.col(f"_{name}_{k}") for k in range(parts)]).alias(name) for name in on])


def _order(df: DataFrame, order: Sequence[str | Column]) -> list[Column]:
    """``order``, ties by a hash of the row, so that equal keys need not share a task and results repeat."""
    return [F.col(c) if isinstance(c, str) else c for c in order] + [F.xxhash64(*df.columns)]


def _ranges(df: DataFrame, order: Sequence[str | Column]) -> tuple[int, DataFrame]:
    """How many ranges, and ``df`` cut into them and sorted inside of each.

    The ranges are cut from a sample of the keys themselves, so any columns will do, of any types, falling or with nulls;
    every task sorts one range of about ``ROWS_PER_TASK`` rows. ``df`` should be staged: it is read for its size, for the
    sample and once more. Small tables are one range.
    """
    ranges = max(1, min(MAX_BUCKETS, math.ceil(df.count() / ROWS_PER_TASK)))
    keys = _order(df, order)
    cut = df.repartitionByRange(ranges, *keys) if ranges > 1 else df.repartition(1)
    return ranges, cut.sortWithinPartitions(*keys)


def in_order(df: DataFrame, order: Sequence[str | Column], name: str = "ordered") -> DataFrame:
    """``df`` with ``_bucket`` and ``_place``: ranges of the order, and places inside of them; written if there are several."""
    ranges, placed = _ranges(df, order)
    # the id counts the rows of a task from its number times 2^33 on
    wide = F.lit(1 << 33).cast("bigint")
    numbered = placed.withColumn("_id", F.monotonically_increasing_id()).select(
        *df.columns, F.floor(F.col("_id") / wide).alias("_bucket"), (F.col("_id") % wide).alias("_place"))
    return stage(numbered, name) if ranges > 1 else numbered


def _before(column: str) -> Column:
    window = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def running_total(df: DataFrame, order: Sequence[str | Column], value: Column, name: str, inclusive: bool = False) -> DataFrame:
    """Add the total of ``value`` over all rows before (or up to) each row along ``order``.

    Sums per range are added up first (at most ``MAX_BUCKETS`` rows); each range then only adds up its own rows.
    """
    placed = in_order(df.withColumn("_value", value), order)
    sums = placed.groupBy("_bucket").agg(F.sum("_value").alias("_sum"))
    offsets = sums.select("_bucket", _before("_sum").alias("_offset"))
    end = 0 if inclusive else -1
    within = Window.partitionBy("_bucket").orderBy("_place").rowsBetween(Window.unboundedPreceding, end)
    return (
        placed.join(F.broadcast(offsets), "_bucket")
        .withColumn(name, F.col("_offset") + F.coalesce(F.sum("_value").over(within), F.lit(0)))
        .drop("_bucket", "_place", "_value", "_offset")
    )


def number_rows(df: DataFrame, order: Sequence[str | Column], name: str, start: int = 0) -> DataFrame:
    """Number all rows along ``order``, first row = ``start``: places in a range behind the sizes of earlier ranges."""
    placed = in_order(df, order)
    sizes = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_bucket", _before("_n").alias("_offset"))
    return placed.join(F.broadcast(offsets), "_bucket").withColumn(
        name, F.col("_offset") + F.col("_place") + F.lit(start)).drop("_bucket", "_place", "_offset")


def carry_last(df: DataFrame, order: Sequence[str | Column], value: str, name: str) -> DataFrame:
    """Add the last non-null ``value`` of all earlier rows along ``order``."""
    placed = in_order(df, order)
    lasts = placed.groupBy("_bucket").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("_place"))).alias("_last"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lasts.select("_bucket", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    within = Window.partitionBy("_bucket").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.join(F.broadcast(earlier), "_bucket")
        .withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(within), F.col("_carried")))
        .drop("_bucket", "_place", "_carried")
    )


def rank_in_group(
    df: DataFrame, group: Sequence[str], draw: str, ties: Sequence[str], name: str
) -> DataFrame:
    """Rank rows inside each group along the uniform column ``draw`` (ties by ``ties``).

    A group too large for one task is cut into equal slices of [0, 1): sizes
    of earlier slices give each slice its offset, so no group is ever ordered
    whole. ``df`` should be staged.
    """
    largest = df.groupBy(*group).count().agg(F.max("count")).first()[0] or 0
    slices = math.ceil(largest / ROWS_PER_TASK)
    if slices <= 1:
        window = Window.partitionBy(*group).orderBy(draw, *ties)
        return df.withColumn(name, F.row_number().over(window).cast("bigint"))
    sliced = df.withColumn("_slice", F.floor(F.col(draw) * slices))
    sizes = sliced.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*group, "_slice").orderBy(draw, *ties)
    return (
        sliced.join(offsets, [*group, "_slice"])
        .withColumn(name, F.col("_offset") + F.row_number().over(within))
        .drop("_slice", "_offset")
    )


def first_k_in_group(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], k: int, salts: int = 256
) -> DataFrame:
    """The first ``k`` rows of each group, for groups of any size.

    Each salted part keeps its own first ``k``; the second pass then sees at
    most ``salts * k`` rows of a group.
    """
    parts = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    inner = Window.partitionBy(*group, "_salt").orderBy(*order)
    outer = Window.partitionBy(*group).orderBy(*order)
    kept = parts.withColumn("_rn", F.row_number().over(inner)).where(F.col("_rn") <= k)
    return kept.withColumn("_rn", F.row_number().over(outer)).where(F.col("_rn") <= k).drop("_rn", "_salt")
