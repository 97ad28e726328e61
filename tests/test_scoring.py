import math

import numpy as np
from pyspark.sql import functions as F

from notelens.functions import vectors as ve
from notelens.operators import evaluation as ev
from notelens.operators import scoring as sc
from notelens.operators import windows as wi


def test_kl_identities(spark):
    row = spark.createDataFrame([([1.0, 2.0], [0.5], [0.5, 1.0], [0.25])], "a array<double>, va array<double>, b array<double>, vb array<double>")
    wide = lambda c: F.array(F.get(c, 0), F.get(c, 0))
    got = row.select(
        ve.kl(F.col("a"), F.col("va"), F.col("a"), F.col("va")).alias("zero"),
        ve.kl(F.col("a"), F.col("va"), F.col("b"), F.col("vb")).alias("spherical"),
        ve.kl(F.col("a"), wide("va"), F.col("b"), wide("vb")).alias("diagonal"),
    ).first()
    assert abs(got.zero) < 1e-12 and math.isclose(got.spherical, got.diagonal)


def test_cell_gaussians_match_numpy(spark):
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(6, 3))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, vec array<double>")
    rows = [(int(c), int(m), [int(x) for x in rng.integers(0, 6, 4)]) for c, m in rng.integers(0, 2, (40, 2))]
    grams = spark.createDataFrame(rows, "center_id long, metadata_id long, context_ids array<long>")
    for cell in sc.cell_gaussians(grams, vectors).collect():
        ids = [x for c, m, ctx in rows if (c, m) == (cell.center_id, cell.metadata_id) for x in ctx]
        assert np.allclose(cell.mu, vecs[ids].mean(axis=0)) and cell.n == len(ids)
        assert np.isclose(cell["var"][0], vecs[ids].var(axis=0).mean())


def test_top_k_counts_missing_candidates_as_hits(spark):
    ranked = spark.createDataFrame([(1, 0, 1, 2, 2), (2, 0, 0, 1, 2)], "row_idx long, target int, pred int, rank long, n_candidates long")
    got = ev.top_k_accuracy(ranked).first()
    assert (got.top_1, got.top_2, got.top_3) == (0.5, 1.0, 1.0)


def test_single_class_report_is_finite(spark):
    cells = spark.createDataFrame([("AA", 1, 1, 4)], "sf string, target long, pred long, n long")
    got = ev.sf_report(ev.class_report(cells)).first()
    assert got.macro_f1 == got.weighted_f1 == got.micro_f1 == 1.0


def test_as_of_lookup(spark):
    events = spark.createDataFrame([(1, 2, "a"), (1, 5, "b"), (2, 9, "c")], "doc_id long, at int, header string")
    probes = spark.createDataFrame([(1, 1, "p"), (1, 2, "q"), (1, 7, "r"), (2, 3, "s")], "doc_id long, at int, name string")
    got = {r.name: r.header for r in wi.last_before(events, probes, "doc_id", "at", "header", "<pad>").collect()}
    assert got == {"p": "<pad>", "q": "a", "r": "b", "s": "<pad>"}


def test_blank_line_documents(spark):
    from notelens.sources.files import assemble_documents

    lines = [" a ", "b", "", "c", " ", " ", "d", "", "", "", "e"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string")
    def docs(compat):
        out = assemble_documents(df, "file", "line_no", compat).collect()
        return sorted((r.closing, r.text) for r in out)
    assert docs(False) == [(2, "a b"), (4, "c"), (7, "d"), (10, "e")]
    # the buffer of the reading loop holds a space after a second blank line, which a third one closes
    assert docs(True) == [(2, "a b"), (4, "c"), (7, "d"), (9, ""), (10, "e")]


def _scored(spark):
    rows = [(1, 0, 0.9, 0), (1, 1, 0.1, 0), (2, 0, 0.3, 7), (2, 1, 0.6, 7), (3, 0, 0.2, 1), (3, 1, 0.8, 1)]
    return spark.createDataFrame([(r, "x", *rest) for r, *rest in rows], "row_idx long, sf string, lf_idx long, score double, target long")


def test_absent_target_is_a_miss(spark):
    ranked = ev.rank_candidates(_scored(spark), ["sf"])
    assert {(r.row_idx, r.pred, r["rank"], r.n_candidates) for r in ranked.collect()} == {(1, 0, 1, 2), (2, 1, 3, 2), (3, 1, 1, 2)}
    row = ev.accuracy(ranked).first()
    assert row.n == 3 and math.isclose(row.accuracy, 2 / 3)
    assert math.isclose(ev.top_k_accuracy(ranked).first().top_3, 2 / 3)


def test_absent_target_has_no_loss(spark):
    import pytest

    with pytest.raises(Exception, match="not among its candidates"):
        sc.cross_entropy(_scored(spark)).collect()
    good = sc.cross_entropy(_scored(spark).where("row_idx <> 2")).first()
    want = (math.log(math.exp(0.9) + math.exp(0.1)) - 0.9 + math.log(math.exp(0.2) + math.exp(0.8)) - 0.8) / 2
    assert good.n == 2 and math.isclose(good.log_loss, want)


def test_bootstrap_metrics_by_hand(spark):
    rows = [(i, "a" if i % 2 else "b", i % 3, (i * 7) % 3, i / 10) for i in range(12)]
    frame = spark.createDataFrame(rows, "row_idx long, sf string, target long, pred long, loss double")
    got = ev.bootstrap(frame, 2, 1.0).collect()
    assert len(got) == 2
    for run in got:
        assert run.n == 12 and math.isclose(run.log_loss, np.mean([r[4] for r in rows]))
        assert math.isclose(run.accuracy, np.mean([r[2] == r[3] for r in rows]))
        macro, weighted = [], []
        for sf in "ab":
            own = [r for r in rows if r[1] == sf]
            f1 = {}
            for c in range(3):
                h, t, p = (sum(map(f, own)) for f in (lambda r: r[2] == r[3] == c, lambda r: r[2] == c, lambda r: r[3] == c))
                f1[c] = (2 * h / (t + p) if t + p else 0.0, t)
            macro.append(np.mean([f for f, t in f1.values() if t]))
            weighted.append(sum(f * t for f, t in f1.values()) / len(own))
        assert math.isclose(run.macro_f1, np.mean(macro)) and math.isclose(run.weighted_f1, np.mean(weighted))
