import numpy as np
import pytest

from notelens.llm import quality as op
from notelens.llm.quality_queries import op3_quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op3_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    held = [(got[r.doc_id], r.quality) for r in labels if got[r.doc_id].held_out]
    assert len(got) == 1000 and len(held) > 40
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert np.mean([r.predicted == q for r, q in held]) >= 0.95
    assert np.mean([r.predicted for r, q in held if q == 1]) >= 0.97


def test_score_equals_plain_densities():
    rng = np.random.default_rng(1)
    x, label = rng.normal(size=(200, 3)), np.arange(200) % 2
    x[label == 1] = x[label == 1] @ np.array([[1, 0.5, 0], [0, 2, 0], [0, 0, 1]]) + 1
    model = op.Discriminant.fit(x, label)
    z = (x - x.mean(0)) / x.std(0)
    covs = [np.cov(z[label == c], rowvar=False, bias=True) for c in (0, 1)]
    pooled = (covs[0] + covs[1]) / 2
    logs = []
    for c in (0, 1):
        s = (1 - op.POOLED - op.SPHERE) * covs[c] + op.POOLED * pooled + op.SPHERE * np.trace(pooled) / 3 * np.eye(3)
        d = z - z[label == c].mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.log(np.linalg.det(s)))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(logs[0] - logs[1])))


@pytest.mark.parametrize("text", [None, "", " ", "\n\n", "x", "é" * 100_000, "a b " * 50_000, "\x00￿🦙"])
def test_statistics_are_finite(text):
    assert np.isfinite(op.statistics(text)).all() and len(op.statistics(text)) == len(op.statistics("some text"))


def test_rows_and_clashing_names(spark, documents):
    docs = documents([(1, "a plain line of text"), (1, "a plain line of text"), (2, None), (None, ""), (3, "LOUD!! WORDS!!")],
                     extra=["score", "label", "quality"])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(1, 1, 0), (5, None, 0), (None, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    train = documents([(i, "good calm text here" + " more" * i if i % 2 else "BAD!! TEXT!!" + "!" * i) for i in range(40)],
                      extra=["label"])
    model = op.fit(train, labels)
    rows = op.score(docs, model, keep=docs.columns).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r.doc_id == 1}) == 1
    assert len({r["score"] for r in rows if not r.text}) == 1


def test_one_class_and_empty(spark, documents):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    docs = documents([(1, "x"), (2, "y")])
    assert {r["score"] for r in op.score(docs, op.fit(docs, labels)).collect()} == {0.75}
    assert op.fit(docs, labels.limit(0)).constant == 0.5
    assert op.score(documents([]), op.fit(documents([]), labels)).count() == 0


def test_bound_on_labelled_rows(spark, documents):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    docs = documents([(i, "t" * (i + 1)) for i in range(40)])
    assert op.fit(docs, labels, max_rows=1).constant is not None


def test_repeated_ids_do_not_pass_the_bound(spark, documents, monkeypatch):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    docs = documents([(i % 12 if i < 60 else 1, f"text {i}") for i in range(3000)])
    seen = []
    monkeypatch.setattr(op.Discriminant, "fit", classmethod(lambda cls, x, label: seen.append(len(x)) or cls(constant=0.5)))
    op.fit(docs, labels, max_rows=4)
    op.fit(docs, labels, max_rows=100)
    assert seen[0] == 4 and seen[1] <= 12
