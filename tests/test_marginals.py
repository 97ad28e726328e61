from pyspark.sql import functions as F

from notelens.operators import examples as ex
from notelens.operators import marginals as ma
from notelens.operators import scale
from notelens.operators import scoring as sc


def cells(spark, senses=400):
    rows = [(f"s{k}", m, n) for k in range(senses) for m, n in (("a", 40), ("b", 1), ("c", 19), ("d", 60))]
    return spark.createDataFrame(rows, "lf string, metadata string, n long").repartition(5)


def test_margins_and_distribution_of_the_drawn_split(spark):
    counts = cells(spark)
    got = ma.draw_split(counts, 0.75, 1).orderBy("lf", "metadata", "part").collect()
    assert got == ma.draw_split(counts.repartition(3), 0.75, 1).orderBy("lf", "metadata", "part").collect()
    n = {(r.lf, r.metadata, r.part): r.n for r in got}
    for k in range(400):
        assert sum(n[f"s{k}", m, "train"] - 1 for m in "abcd") == 90
        assert all(n[f"s{k}", m, "train"] + n[f"s{k}", m, "val"] - 2 == c for m, c in zip("abcd", (40, 1, 19, 60)))
    for m, c in zip("abcd", (40, 1, 19, 60)):
        taken = [n[f"s{k}", m, "train"] - 1 for k in range(400)]
        mean, variance = sum(taken) / 400, c * 0.75 * 0.25 * (120 - c) / 119
        assert abs(mean - 0.75 * c) < 4 * (variance / 400) ** 0.5
        assert 0.7 * variance < sum((t - mean) ** 2 for t in taken) / 399 < 1.4 * variance


def test_blocks_of_cells(spark, monkeypatch):
    monkeypatch.setattr(ma, "CELLS", 7)
    rows = [("big", f"m{k}", 1 + k % 5) for k in range(200)] + [("one", "x", 1), ("huge", "x", 3_000_000_000), ("huge", "y", 1_000_000_000)]
    counts = spark.createDataFrame(rows, "lf string, metadata string, n long")
    got = {(r.lf, r.metadata, r.part): r.n - 1 for r in ma.draw_split(counts).collect()}
    assert len(got) == 2 * len(rows) and all(got[lf, m, "train"] + got[lf, m, "val"] == n for lf, m, n in rows)
    assert sum(v for (lf, _, part), v in got.items() if (lf, part) == ("big", "train")) == 450
    assert sum(v for (lf, _, part), v in got.items() if (lf, part) == ("huge", "train")) == 3_000_000_000
    assert (got["one", "x", "train"], got["one", "x", "val"]) == (0, 1)


def test_frequent_ids_are_split_off(spark, monkeypatch):
    slots = scale.stage(spark.range(200).select(
        F.col("id").alias("gpos"), F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 50).alias("center_id"),
        (F.col("id") % 40).alias("positive_id"), F.lit(3).cast("bigint").alias("negative_id")), "slots")
    gaussians = scale.stage(spark.range(50).select(
        "id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("mu"), F.array((F.col("id") + 1) / 10).alias("var")), "gaussians")
    samples = spark.range(0, 300).select((F.col("id") % 10).alias("id"), F.floor(F.col("id") / 30).alias("draw"),
                                         (F.floor(F.col("id") / 10) % 3).cast("int").alias("slot"), (F.col("id") * 7).alias("metadata_id"))
    words = scale.stage(slots.select((F.col("center_id") % 10).alias("id"), "gpos"), "words")
    samples = scale.stage(samples, "samples")
    loss = sc.hinge_loss(slots, gaussians, 0.1).first()
    robin = sorted(map(tuple, ex.round_robin(words, samples).select("gpos", "id", "draw", "slot", "metadata_id").collect()))
    assert len(robin) == 600 and loss.n == 200
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 1000)
    monkeypatch.setattr(scale, "HOT_SHARE", 0.05)
    again = sc.hinge_loss(slots, gaussians, 0.1).first()
    assert again.n == 200 and abs(again.hinge - loss.hinge) < 1e-9
    assert sorted(map(tuple, ex.round_robin(words, samples).select("gpos", "id", "draw", "slot", "metadata_id").collect())) == robin
