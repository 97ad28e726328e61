import numpy as np
import pytest
from pyspark.sql import functions as F

from notelens.llm import mixing as op
from notelens.llm.mixing_queries import op8_mixing

SF = "/root/testdata/sf0.01"


def test_query_meets_targets_and_labels(spark):
    rows = op8_mixing(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    domains = sorted({d.lang for d in docs.values()})
    n = np.array([r.tokens for r in rows], float)
    p = np.array([r.posterior for r in rows])
    rate = np.array([r.rate for r in rows])
    assert np.allclose(p.sum(1), 1) and rate.min() >= 0
    own = n @ p
    target = np.array(op.smoothed(own.tolist(), 0.7)) * own.sum()
    assert np.allclose((rate * n) @ p, target, rtol=1e-4)
    right = [domains[int(np.argmax(r.posterior))] == docs[r.doc_id].lang for r in rows if r.tokens >= 20]
    assert np.mean(right) > 0.95
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)
    assert abs(sum(r.copies for r in rows) - rate.sum()) < 80


def plain_fit(n, p, target, least, rounds):
    """Projected gradient with small steps on the same objective."""
    own, r = n @ p, np.full(len(n), max(1.0, least))
    for _ in range(rounds):
        r = np.maximum(least, r - 0.5 * p @ (((r * n) @ p - target) / own))
    return r


@pytest.mark.parametrize("least,weights,rounds", [(0.0, [0.3, 0.4, 0.3], 3000), (0.0, [0.0, 0.5, 0.5], op.ROUNDS), (1.0, [0.1, 0.1, 0.8], op.ROUNDS)])
def test_fit_equals_plain_gradient(spark, least, weights, rounds):
    """As good as any number of small steps where the targets can be met, and as so many small steps elsewhere."""
    rng = np.random.default_rng(2)
    n = rng.integers(0, 200, 60).astype(float)
    p = rng.dirichlet([0.3, 0.3, 0.3], 60)
    frame = spark.createDataFrame([(float(a), [float(x) for x in b]) for a, b in zip(n, p)], "tokens double, posterior array<double>")
    found = op.fit(frame, 3, weights, least=least)
    rate = np.array([r[0] for r in frame.select(found.rate()).collect()])
    want = plain_fit(n, p, np.array(weights) * n.sum(), least, rounds)
    loss = lambda r: (((r * n) @ p - np.array(weights) * n.sum()) ** 2 / (n @ p)).sum() / n.sum()
    assert rate.min() >= least and loss(rate) <= loss(want) + 1e-6


def test_plan_is_native(spark):
    plan = op8_mixing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_rows(spark, documents):
    docs = documents([(1, "the cat of the town " * 30), (1, "the cat of the town " * 30), (2, None), (3, ""), (None, "le chat de la ville " * 30),
                      (5, "w " * 60_000)], extra=["rate", "posterior", "copies", "tokens", "_counts"])
    train = docs.withColumn("lang", F.when(F.col("text").startswith("le"), "fr").when(F.col("doc_id") == 1, "en"))
    got = op.mix(docs, train).collect()
    assert len(got) == 6 and all(abs(sum(r.posterior) - 1) < 1e-9 and r.rate >= 0 for r in got)
    assert [r.tokens for r in got if r.doc_id in (2, 3)] == [0, 0] and len({(r.rate, r.copies) for r in got if r.doc_id == 1}) == 1
    mixed = op.remix(docs, train, least=1.0, keep_all=True)
    assert mixed.columns == docs.columns
    assert {r.doc_id for r in mixed.collect()} == {1, 2, 3, 5, None}


def test_no_labels_one_label_and_empty(documents):
    docs = documents([(1, "a b"), (2, "c")])
    none = docs.withColumn("lang", F.lit(None).cast("string"))
    assert [(r.rate, r.copies, r.posterior) for r in op.mix(docs, none).collect()] == [(1.0, 1, []), (1.0, 1, [])]
    assert [(r.rate, r.posterior) for r in op.mix(docs, docs).collect()] == [(1.0, [1.0]), (1.0, [1.0])]
    assert op.remix(docs, none).count() == 2
    empty = documents([])
    assert op.mix(empty, empty).count() == 0 and op.mix(empty, docs).count() == 0 and op.remix(empty, docs).count() == 0


def test_weights_are_checked(documents):
    docs = documents([(1, "a b")])
    with pytest.raises(ValueError):
        op.mix(docs, docs, weights={"en": -1.0})


def test_rare_domains_are_learned_from_large_tables(documents):
    """Domains of few rows, also under one null id, among more rows of another than the sample has."""
    rows = [(k, "the cat of the town " * 3) for k in range(900)] + [(900 + k, "le chat de la ville " * 30) for k in range(2)]
    docs = documents(rows + [(None, "die katze in der stadt " * 30)] * 2)
    train = docs.withColumn("lang", F.when(F.col("text").startswith("le"), "fr").when(F.col("text").startswith("die"), "de").otherwise("en"))
    model = op.learn(train, sample=40)
    assert model.domains == ["de", "en", "fr"]
    for start, own in (("die", 0), ("the", 1), ("le", 2)):
        assert op.membership(docs.filter(F.col("text").startswith(start)), model).first().posterior[own] > 0.9
    members = op.membership(docs, model)
    found = op.fit(members, 3, [0.3, 0.3, 0.4])
    assert np.allclose(found.reached, found.targets, rtol=1e-3)


def test_shares_fill_the_sample():
    counts = {"a": 10, "b": 1000, "c": 100_000, "d": 3}
    share = op._shares(counts, 400)
    assert share["a"] == share["d"] == 1 and abs(sum(share[d] * n for d, n in counts.items()) - 400) < 1e-6
    assert abs(share["b"] * 1000 - share["c"] * 100_000) < 1e-6 and set(op._shares(counts, 200_000).values()) == {1.0}


def test_weights_of_domains_without_labels_are_refused(documents):
    docs = documents([(1, "a b")])
    for mixed in (op.mix, op.remix):
        with pytest.raises(ValueError):
            mixed(docs, docs, weights={"en": 0.5, "fr": 0.5})
    assert op.mix(docs, docs, weights={"en": 0.5, "fr": 0.0}).count() == 1


@pytest.mark.parametrize("sample", [100, 4000])
def test_a_domain_of_three_short_rows_meets_its_target(documents, sample):
    """No word of the rare domain occurs often; it has markers all the same, and its weight is met or refused."""
    rows = [(k, f"the cat of the town w{k % 7} and more of it") for k in range(3000)]
    docs = documents(rows + [(3000 + k, f"uno due tre{k} quattro cinque sei sette") for k in range(3)])
    train = docs.withColumn("lang", F.when(F.col("text").startswith("uno"), "xx").otherwise("en"))
    model = op.learn(train, sample=sample)
    members = op.membership(docs, model)
    found = op.fit(members, 2, [0.5, 0.5])
    assert np.allclose(found.reached, found.targets, rtol=0.01) and not found.unmet()
    rates = [r.rate for r in op.mix(docs, train, weights={"en": 0.5, "xx": 0.5}).filter("doc_id >= 3000").collect()]
    assert len(rates) == 3 and min(rates) > 100


def test_weights_that_no_rates_meet_are_refused(documents):
    """Both labels have the same texts: the classifier cannot tell them apart."""
    docs = documents([(k, "all the same words") for k in range(40)])
    train = docs.withColumn("lang", F.when(F.col("doc_id") < 4, "xx").otherwise("en"))
    for mixed in (op.mix, op.remix):
        with pytest.raises(ValueError, match="not met"):
            mixed(docs, train, weights={"en": 0.1, "xx": 0.9})


@pytest.mark.parametrize("key", [None, 7])
def test_rows_of_one_id_are_rounded_on_their_own(spark, key):
    rows = spark.range(2000).select(F.lit(key).cast("bigint").alias("doc_id"), F.xxhash64(F.col("id").cast("string")).alias("text_key"))
    total = rows.agg(F.sum(op.copies(F.lit(0.6), F.coalesce("doc_id", F.lit(-1)), F.col("text_key")))).first()[0]
    assert abs(total - 1200) < 120
