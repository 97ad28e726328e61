import pytest
from pyspark.sql import functions as F

from notelens.functions.hashing import uniform
from notelens.operators import scale
from notelens.operators import vocabulary as vo
from notelens.session import stage_dir


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(scale, "ROWS_PER_TASK", 7)


def rows(spark, n=100):
    return spark.range(n).select((F.col("id") * 37 % 101).alias("k"), F.col("id"), (F.col("id") % 5).alias("g"))


def test_number_rows_in_buckets(spark, small_tasks):
    got = scale.number_rows(rows(spark), ["k"], "n", 3).orderBy("k").collect()
    assert [r.n for r in got] == list(range(3, 103))


def test_running_total_in_buckets(spark, small_tasks):
    got = scale.running_total(rows(spark), ["k"], F.col("id"), "before").orderBy("k").collect()
    total = 0
    for r in got:
        assert r.before == total
        total += r.id


def test_carry_last_in_buckets(spark, small_tasks):
    data = rows(spark).withColumn("v", F.when(F.col("k") % 23 == 0, F.col("k")))
    last = None
    for r in scale.carry_last(data, ["k"], "v", "c").orderBy("k").collect():
        assert r.c == last
        last = r.v if r.v is not None else last


def composite(spark, n=400):
    """Sources that share their first letters, ties, nulls and numbers of both signs."""
    name = F.when(F.col("id") % 9 > 0, F.concat(F.lit("source_with_long_prefix_"), F.col("id") % 4))
    number = F.when(F.col("id") % 11 > 0, F.col("id") * 7919 % 101 - 50)
    return spark.range(n).select("id", name.alias("name"), number.alias("number")).repartition(5)


@pytest.mark.parametrize("size", [50, 10_000])
def test_orders_of_any_columns(spark, monkeypatch, size):
    monkeypatch.setattr(scale, "ROWS_PER_TASK", size)
    data = scale.stage(composite(spark), "composite")
    last = lambda x: (x is not None, x or 0)
    text = lambda x: (x is not None, x or "")
    got = scale.number_rows(data, ["name", F.desc("number"), "id"], "n", 5).orderBy("n").collect()
    # nulls come first when rising and last when falling
    want = sorted(data.collect(), key=lambda r: (text(r.name), r.number is None, -(r.number or 0), r.id))
    assert [r.n for r in got] == list(range(5, 405)) and [r.id for r in got] == [r.id for r in want]
    want = sorted(want, key=lambda r: (text(r.name), last(r.number), r.id))
    total, carried = 0, None
    sums = {r.id: r.sum for r in scale.running_total(data, ["name", "number", "id"], F.col("id"), "sum", inclusive=True).collect()}
    lasts = {r.id: r["last"] for r in scale.carry_last(data, ["name", "number", "id"], "number", "last").collect()}
    for r in want:
        total += r.id
        assert sums[r.id] == total and lasts[r.id] == carried
        carried = r.number if r.number is not None else carried


def test_ties_and_empty_tables_in_order(spark, small_tasks):
    tied = scale.stage(spark.range(100).select(F.lit(None).cast("string").alias("k"), F.lit(1).alias("v")), "tied")
    assert sorted(r.n for r in scale.number_rows(tied, ["k"], "n").collect()) == list(range(100))
    assert sorted(r.s for r in scale.running_total(tied, ["k"], F.col("v"), "s").collect()) == list(range(100))
    assert scale.number_rows(tied.limit(0), ["k"], "n").count() == 0


def test_rank_in_group_in_slices(spark, small_tasks):
    from notelens.functions.hashing import uniform

    data = rows(spark).withColumn("u", uniform("id", seed=1))
    got = scale.rank_in_group(data, ["g"], "u", ["id"], "r").collect()
    for g in range(5):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.u)
        assert [r.r for r in mine] == list(range(1, len(mine) + 1))


def test_first_k_in_group(spark):
    got = scale.first_k_in_group(rows(spark), ["g"], [F.desc("k")], 3, salts=4).collect()
    want = {g: sorted((i * 37 % 101 for i in range(100) if i % 5 == g), reverse=True)[:3] for g in range(5)}
    assert {g: sorted((r.k for r in got if r.g == g), reverse=True) for g in range(5)} == want


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_join_splits_hot_keys(spark, monkeypatch, how):
    left = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("key"))
    right = spark.range(30).select(F.col("id").alias("key"), (F.col("id") * 2).alias("twice"), F.when(F.col("id") == 0, 100).otherwise(1).alias("w"))
    want = sorted(map(tuple, left.join(right, "key", how).select("id", "key", "twice", "w").collect()))
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 1)
    monkeypatch.setattr(scale, "HOT_SHARE", 0.3)
    got = scale.lookup_join(left, right, "key", how, weight="w").select("id", "key", "twice", "w")
    assert sorted(map(tuple, got.collect())) == want


class Session:
    """Just enough of a session to tell where stage tables go."""

    def __init__(self, folder, master):
        self.conf = self
        self.folder = folder
        self.sparkContext = self
        self.master = master
        self.applicationId = f"{folder}-{master}"

    def get(self, key, default=None):
        return self.folder if key == "spark.checkpoint.dir" and self.folder else default


def test_stage_folder_comes_from_the_session():
    assert stage_dir(Session("hdfs://shared/stage", "yarn")) == "hdfs://shared/stage"
    local = Session(None, "local[2]")
    assert stage_dir(local) == stage_dir(local)
    with pytest.raises(RuntimeError):
        stage_dir(Session(None, "yarn"))


def test_lookup_join_keeps_rows_without_weight_or_key(spark, monkeypatch):
    left = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 40).alias("key"))
    for weight in (F.lit(None).cast("int"), F.lit(0), F.when(F.col("id") == 0, 100)):
        right = spark.range(30).select(F.col("id").alias("key"), (F.col("id") * 2).alias("twice"), weight.alias("w"))
        want = sorted(map(str, left.join(right, "key", "left").select("id", "key", "twice", "w").collect()))
        monkeypatch.setattr(scale, "BROADCAST_BYTES", 1)
        got = scale.lookup_join(left, right, "key", "left", weight="w").select("id", "key", "twice", "w").collect()
        monkeypatch.undo()
        assert sorted(map(str, got)) == want


def test_null_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 1)
    left = spark.range(2000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).alias("key"))
    right = spark.range(2000).select(F.col("id").alias("key"), F.col("id").alias("v"), F.lit(1).alias("w"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = scale.lookup_join(left, right, "key", "left", weight="w").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert max(r["count"] for r in sizes) < 600


def test_slices_of_draws_have_no_gaps(spark, small_tasks):
    dist = spark.range(1, 101).select("id", (F.col("id") / 5050.0).alias("p"))
    slices = vo.cumulative(dist).orderBy("id").collect()
    assert len(slices) == 100 and slices[0].lo == 0
    assert all(a.hi == b.lo for a, b in zip(slices, slices[1:]))
    draws = spark.range(5000).select(F.col("id").alias("n"), uniform("id", seed=3).alias("u"))
    drawn = vo.weighted_draw(draws, scale.stage(vo.cumulative(dist), "slices"), "u", "drawn").collect()
    assert len(drawn) == len({r.n for r in drawn}) == 5000


def test_uniforms_use_52_bits(spark):
    values = [r.u * 2**52 for r in spark.range(200).select(uniform("id", seed=1).alias("u")).collect()]
    assert all(v == int(v) and 0 <= v < 2**52 for v in values) and any(v % 2**20 for v in values)


def test_lookup_join_counts_keys_itself(spark, monkeypatch):
    left = spark.range(300).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40).alias("key"))
    right = spark.range(30).select(F.col("id").alias("key"), (F.col("id") * 2).alias("twice"))
    want = sorted(map(str, left.join(right, "key", "left").select("id", "key", "twice").collect()))
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 1000)
    monkeypatch.setattr(scale, "HOT_SHARE", 0.2)
    assert sorted(map(str, scale.lookup_join(left, scale.stage(right, "right"), "key", "left").select("id", "key", "twice").collect())) == want


def test_scores_are_the_same_beyond_the_broadcast_bound(spark, monkeypatch):
    from notelens.operators import scoring as sc

    examples = spark.createDataFrame([(i, "hot" if i % 4 else f"s{i}", 0, [float(i), 1.0], [0.5]) for i in range(40)],
                                     "row_idx long, sf string, target long, mu array<double>, var array<double>")
    senses = spark.createDataFrame([(sf, k, [k + 0.5, 2.0], [1.0]) for sf in ["hot", *[f"s{i}" for i in range(0, 40, 4)]] for k in range(3)],
                                   "sf string, lf_idx long, mu array<double>, var array<double>")
    want = sorted(map(str, sc.score_by_kl(examples, senses).collect()))
    for module in (scale, sc):
        if hasattr(module, "BROADCAST_BYTES"):
            monkeypatch.setattr(module, "BROADCAST_BYTES", 1)
    assert sorted(map(str, sc.score_by_kl(examples, senses).collect())) == want


def test_frequent_keys_are_a_superset(spark, monkeypatch):
    monkeypatch.setattr(scale, "TRACKED", 1 << 10)
    rows = spark.range(200_000).repartition(7).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).when(
        F.col("id") % 3 == 1, F.concat(F.lit("k"), F.floor(F.sqrt("id")) % 90)).otherwise(F.col("id").cast("string")).alias("k"))
    rows = rows.union(spark.range(5000).select(F.lit(None).cast("string")))
    counts = {r.k: r["count"] for r in rows.where("k is not null").groupBy("k").count().collect()}
    for share in (0.3, 0.01, 0.0078):
        found = set(scale.frequent_keys(rows, "k", share))
        must = {k for k, n in counts.items() if n >= share * 200_000}
        assert must <= found and len(found) <= 1 / (share - 3.5 / (1 << 10)) + 1
        assert all(counts[k] >= (share - 3.5 / (1 << 10)) * 200_000 for k in found)
    assert scale.frequent_keys(rows.limit(0), "k", 0.1) == []
    with pytest.raises(ValueError):
        scale.frequent_keys(rows, "k", 1e-4)


@pytest.mark.parametrize("weights", [[1], [5, 5, 5], [1, 1, 98], [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9], [*range(1, 60), 0, 4000], [10] * 7 + [9] * 3 + [13]])
def test_alias_tables_hold_the_masses(spark, small_tasks, weights):
    total = sum(weights)
    dist = scale.stage(spark.createDataFrame([(k + 1, w / total) for k, w in enumerate(weights)], "id long, p double"), "dist")
    table = scale.stage(vo.alias_table(dist), "alias").orderBy("cell").collect()
    assert [r.cell for r in table] == list(range(sum(w > 0 for w in weights))) and all(0 < r.cut <= 1 for r in table)
    held = dict.fromkeys(range(1, len(weights) + 1), 0.0)
    for r in table:
        held[r.id] += r.cut / len(table)
        held[r.other] += (1 - r.cut) / len(table)
    assert all(abs(held[k + 1] - w / total) < 1e-8 for k, w in enumerate(weights))


def test_alias_draws_follow_the_masses(spark):
    weights = [1, 2, 3, 4, 30, 7, 0, 53]
    dist = scale.stage(spark.createDataFrame([(k, w / 100) for k, w in enumerate(weights)], "id long, p double"), "dist")
    draws = spark.range(20_000).select("id", uniform("id", seed=8).alias("u"))
    drawn = vo.alias_draw(draws.withColumnRenamed("id", "n"), scale.stage(vo.alias_table(dist), "alias"), "u", "id")
    seen = {r.id: r["count"] for r in drawn.groupBy("id").count().collect()}
    chi = sum((seen.get(k, 0) - 200 * w) ** 2 / (200 * w) for k, w in enumerate(weights) if w)
    assert sum(seen.values()) == 20_000 and 6 not in seen and chi < 22  # 6 degrees of freedom: 0.1 %
    assert vo.alias_table(scale.stage(dist.where("p > 2"), "none")).count() == 0


def test_stage_tables_of_a_scope_are_removed(spark):
    import os

    from notelens.session import stage_scope

    kept = scale.stage(spark.range(5), "kept")
    with stage_scope(spark) as folder:
        inside = scale.stage(spark.range(7), "inside")
        bucketed = scale.stage_by(spark.range(9).selectExpr("id as doc_id", "id as pos"), "doc_id", "pos", "inside")
        assert inside.count() == 7 and bucketed.count() == 9 and folder in inside.inputFiles()[0] + bucketed.inputFiles()[0]
        with stage_scope(spark) as inner:
            assert inner.startswith(folder) and scale.stage(spark.range(3)).count() == 3
        assert inside.count() == 7
        assert os.path.isdir(folder) and not os.path.isdir(inner)
    assert not os.path.isdir(folder) and kept.count() == 5
    assert stage_dir(spark) != folder and not [t for t in spark.catalog.listTables() if t.name.startswith("inside")]
