import random

from notelens.operators import windows as wi


def plain_levels(names):
    pairs = [(a, b) for a in names for b in names if b in a[1:]]
    level = dict.fromkeys(names, 0)
    for _ in names:
        for a, b in pairs:
            level[b] = max(level[b], level[a] + 1)
    return level


def levels(spark, names):
    df = spark.createDataFrame([(n,) for n in names], "section string")
    return {r.section: r.level for r in wi.header_levels(df).collect()}


def test_levels_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    names = {"".join(rng.choice("abé ") for _ in range(rng.randint(1, 6))) for _ in range(60)}
    assert levels(spark, names) == plain_levels(names)
    monkeypatch.setattr(wi, "PART_CHARS", 40)
    assert levels(spark, names) == plain_levels(names)


def test_long_names(spark):
    long = "".join(chr(97 + k * k % 17) for k in range(10_000))
    names = {long, long[1:], "x" + long + "y", long[20:9000], long[100:150], "q", "a" * 10_000}
    assert levels(spark, names) == plain_levels(names)
    assert levels(spark, ["only"]) == {"only": 0}
