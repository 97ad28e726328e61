import itertools

import numpy as np
import pytest

from notelens.llm import language as op
from notelens.llm.language_queries import op9_language

SF = "/root/testdata/sf0.01"


def plain_marginals(emissions, transition):
    """By listing all label sequences; the state before the first word is any."""
    n, k = emissions.shape
    out = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n + 1):
        score = sum(transition[a, b] for a, b in itertools.pairwise(labels)) + sum(emissions[t, labels[t + 1]] for t in range(n))
        for t in range(n):
            out[t, labels[t + 1]] += np.exp(score)
    return out / out.sum(1, keepdims=True)


@pytest.mark.parametrize("block", [1, 2, 3, 32])
def test_marginals_equal_enumeration(monkeypatch, block):
    monkeypatch.setattr(op, "BLOCK", block)
    rng = np.random.default_rng(3)
    lengths = [1, 5, 2, 4, 7]
    emissions, transition = rng.normal(size=(sum(lengths), 3)) * 2, rng.normal(size=(3, 3))
    got = op.marginals(emissions, lengths, transition)
    at = 0
    for n in lengths:
        assert np.allclose(got[at:at + n], plain_marginals(emissions[at:at + n], transition))
        at += n


def test_gradient_equals_differences():
    rng = np.random.default_rng(4)
    e, t, labels = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3)), rng.integers(0, 3, (2, 4))
    by_e, by_t, _ = op._gradient(e, labels, t)
    like = lambda e, t: op._gradient(e, labels, t)[2] * 8
    for i, j in itertools.product(range(3), range(3)):
        d = np.zeros((3, 3))
        d[i, j] = 1e-5
        assert np.isclose((like(e, t + d) - like(e, t - d)) / 2e-5, by_t[i, j], atol=1e-4)
    d = np.zeros_like(e)
    d[1, 2, 1] = 1e-5
    assert np.isclose((like(e + d, t) - like(e - d, t)) / 2e-5, by_e[1, 2, 1], atol=1e-4)


@pytest.fixture(scope="module")
def model(spark):
    from notelens.llm.tables import held_out

    return op.fit(spark.read.parquet(f"{SF}/documents.parquet").filter(~held_out()))


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op9_language(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got.values())
    held = [got[d.doc_id].lang_pred == d.lang for d in docs if got[d.doc_id].held_out]
    assert len(held) > 150 and np.mean(held) > 0.97


def test_switches_inside_a_text(spark, model):
    docs = {r.lang: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars > 2000").collect()}
    en, de = op.words_of(docs["en"])[:60], op.words_of(docs["de"])[:40]
    (words, p), = op.label_words(model, [" ".join(en + de)])
    found = [model.languages[k] for k in p.argmax(1)]
    assert np.mean([a == b for a, b in zip(found, ["en"] * 60 + ["de"] * 40)]) > 0.9
    assert model.transition.diagonal().min() > (model.transition.sum() - model.transition.trace()) / 12


def test_rows(spark, documents, model):
    docs = documents([(1, None), (2, ""), (3, "12 34 ²½ _ !"), (4, "the and of with that"), (4, "the and of with that"), (None, "und der die"),
                      (6, "x" * 100_000), (7, "the " * 50_000)], extra=["lang_pred", "score", "label", "_text"])
    rows = op.predict(docs, model).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 8 and [by[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and [by[k].score for k in (1, 2, 3)] == [0] * 3
    assert by[4].lang_pred == "en" and by[7].lang_pred == "en" and by[None].lang_pred == "de" and by[6].lang_pred in model.languages
    assert op.predict(documents([]), model).count() == 0


def test_nothing_and_one_language(documents):
    nothing = op.fit(documents([]))
    assert [r.lang_pred for r in op.predict(documents(["some words"]), nothing).collect()] == ["und"]
    one = op.fit(documents(["some words here", "more words there"]))
    assert [(r.lang_pred, r.score) for r in op.predict(documents(["unseen", "1"]), one).collect()] == [("en", 1.0), ("und", 0.0)]


def test_features_do_not_depend_on_neighbours():
    words = ["a", "das", "é", "haus", "x" * 50, "haus", "日本"]
    places, first = op.features(words, frozenset(["haus", "a"]))
    own = [sorted(p[p < op.WEIGHTS].tolist()) for p in np.split(places, first[1:])]
    for word, found in zip(words, own):
        alone, _ = op.features([word], frozenset(["haus", "a"]))
        assert sorted(alone[alone < op.WEIGHTS].tolist()) == found
        n = len(word) + 2
        assert len(found) == (n - 1) + (n - 2) + 2 * (len(word) >= 3) + (word in ("haus", "a"))


def test_sample_is_bounded_under_repeated_rows(documents, monkeypatch):
    seen = []
    monkeypatch.setattr(op, "train", lambda pieces, **_: seen.append(len(pieces)) or op.Model([], np.zeros((1, 0)), np.zeros((0, 0)), frozenset()))
    op.fit(documents([(1, "some words of one text " * 20)] * 500 + [(1, f"other words {k} here " * 20) for k in range(500)]), rows=5)
    assert 0 < seen[0] <= 2 * 5 * op.PIECES
