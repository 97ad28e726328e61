"""Queries over scores: Gaussians, cosine rankings, evaluation reports, comparisons."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from notelens.functions import vectors as ve
from notelens.functions.hashing import uniform
from notelens.operators import evaluation as ev
from notelens.operators import examples as ex
from notelens.operators import neighbours as ne
from notelens.operators import scoring as sc
from notelens.operators import vocabulary as vo
from notelens.operators import windows as wi
from notelens.operators.scale import sized, stage
from notelens.plans import fixtures as fx
from notelens.plans import sql as s
from notelens.plans import stream_queries  # noqa: F401  (its SQL fragments)
from notelens.plans.registry import documents, register, table

s.define("gauss", (), """
SELECT vec_id, embedding::DOUBLE[] AS mu, 0.05 + 0.01 * label::DOUBLE AS var, label FROM embeddings""")
KL = "(({d} * ({va}) / ({vb}) + pow(list_distance({a}, {b}), 2) / ({vb}) - {d} - {d} * ln(({va}) / ({vb}))) / 2)"


def kl_sql(a, va, b, vb):
    return KL.format(a=a, va=va, b=b, vb=vb, d=f"len({a})")


def gauss(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("mu"),
        F.array(F.lit(0.05) + F.lit(0.01) * F.col("label").cast("double")).alias("var"), "label",
    )


def _pairs(spark, sf):
    g = stage(gauss(spark, sf), "gauss")
    n = g.count()
    a = g.withColumn("partner", (F.col("vec_id") * 7 + 1) % n)
    return a.join(g.select(F.col("vec_id").alias("partner"), F.col("mu").alias("mu_b"), F.col("var").alias("var_b"), F.col("label").alias("label_b")), "partner")


s.define("pairs", ("gauss",), """
SELECT a.vec_id, a.mu, a.var, a.label, b.mu AS mu_b, b.var AS var_b, b.label AS label_b
FROM gauss a JOIN gauss b ON b.vec_id = (a.vec_id * 7 + 1) % (SELECT count(*) FROM gauss)""")


@register("g01_kl_spherical", s.with_(f"SELECT vec_id, round({kl_sql('mu', 'var', 'mu_b', 'var_b')}, 6) AS kl FROM pairs", "pairs"))
def kl_spherical(spark, sf):
    return _pairs(spark, sf).select("vec_id", F.round(ve.kl(F.col("mu"), F.col("var"), F.col("mu_b"), F.col("var_b")), 6).alias("kl"))


@register("g02_kl_diagonal", s.with_("""
SELECT vec_id, round(sum(va / vb - 1 - ln(va / vb) + pow(x - y, 2) / vb) / 2, 6) AS kl FROM (
  SELECT vec_id, x, y, 0.05::DOUBLE + 0.01::DOUBLE * ((label + i) % 10) AS va, 0.05::DOUBLE + 0.01::DOUBLE * ((label_b + i) % 10) AS vb FROM (
    SELECT vec_id, label, label_b, unnest(mu) AS x, unnest(mu_b) AS y, unnest(range(len(mu))) AS i FROM pairs)) GROUP BY vec_id""", "pairs"))
def kl_diagonal(spark, sf):
    var = lambda m, label: F.transform(m, lambda x, i: F.lit(0.05) + F.lit(0.01) * ((F.col(label) + i) % 10).cast("double"))
    rows = _pairs(spark, sf).select("vec_id", "mu", "mu_b", var("mu", "label").alias("va"), var("mu_b", "label_b").alias("vb"))
    return rows.select("vec_id", F.round(ve.kl(F.col("mu"), F.col("va"), F.col("mu_b"), F.col("vb")), 6).alias("kl"))


s.define("lf_members", ("senses", "gauss"), f"""
SELECT sf, lf_idx, token, mu AS vec, var FROM (
  SELECT sf, lf_idx, token, floor({s.u('token', seed='v')} * (SELECT count(*) FROM gauss))::BIGINT AS vec_id FROM (
    SELECT DISTINCT sf, lf_idx, unnest(string_split(replace(lf, ';', ' '), ' ')) AS token FROM senses)) JOIN gauss USING (vec_id)""")
s.define("lf_gauss", ("lf_members",), """
SELECT sf, lf_idx, list(x ORDER BY i) AS mu, any_value(v) AS var FROM (
  SELECT sf, lf_idx, i, avg(x) AS x, avg(var) AS v FROM (
    SELECT sf, lf_idx, var, unnest(vec) AS x, unnest(range(len(vec))) AS i FROM lf_members) GROUP BY sf, lf_idx, i) GROUP BY sf, lf_idx""")
s.define("asked", ("senses", "gauss"), f"""
SELECT sf || ':' || lf_idx AS row_idx, sf, lf_idx AS target, mu, var FROM (
  SELECT sf, lf_idx, floor({s.u('sf', 'lf_idx', seed='q')} * (SELECT count(*) FROM gauss))::BIGINT AS vec_id FROM senses) JOIN gauss USING (vec_id)""")


def _members(spark, sf):
    senses = stage(fx.senses(spark, sf), "senses")
    g = stage(gauss(spark, sf), "gauss")
    n = g.count()
    tokens = senses.select("sf", "lf_idx", F.explode(F.split(F.replace("lf", F.lit(";"), F.lit(" ")), " ")).alias("token")).distinct()
    keyed = tokens.withColumn("vec_id", F.floor(uniform("token", seed="v") * n))
    members = keyed.join(sized(g), "vec_id").select("sf", "lf_idx", "token", F.col("mu").alias("vec"), "mu", "var")
    asked = senses.withColumn("vec_id", F.floor(uniform("sf", "lf_idx", seed="q") * n)).join(sized(g), "vec_id").select(
        F.concat_ws(":", "sf", "lf_idx").alias("row_idx"), "sf", F.col("lf_idx").alias("target"), "mu", "var")
    return members, asked, senses


def _candidates(members):
    return stage(sc.mean_vectors(members, ["sf", "lf_idx"], ["mu", "var"]), "lf-gauss")


_GLANCE = "round(mu[1], 6) AS first, round(list_sum(mu), 6) AS total, round(var, 6) AS var"


def _glance(df, *keys):
    return df.select(*[F.col(k).cast("bigint").alias(k) if k == "lf_idx" else F.col(k) for k in keys],
                     F.round(F.get("mu", 0), 6).alias("first"), F.round(ve.total(F.col("mu")), 6).alias("total"),
                     F.round(F.get("var", 0), 6).alias("var"))


@register("g03_long_form_gaussians", s.with_(f"SELECT sf, lf_idx, {_GLANCE} FROM lf_gauss", "lf_gauss"))
def long_form_gaussians(spark, sf):
    return _glance(_candidates(_members(spark, sf)[0]), "sf", "lf_idx")


@register("g04_ensemble_gaussians", s.with_(f"""
SELECT sf, lf_idx, {_GLANCE} FROM (
  SELECT sf, lf_idx, list(x ORDER BY i) AS mu, any_value(v) AS var FROM (
    SELECT sf, lf_idx, i, avg(x) AS x, avg(var) AS v FROM (
      SELECT sf, lf_idx, var, unnest(mu) AS x, unnest(range(len(mu))) AS i FROM (
        SELECT sf, lf_idx, mu, var FROM lf_gauss UNION ALL SELECT sf, target, mu, var FROM asked WHERE target % 2 = 0)) GROUP BY sf, lf_idx, i)
  GROUP BY sf, lf_idx)""", "lf_gauss", "asked"))
def ensemble_gaussians(spark, sf):
    members, asked, _ = _members(spark, sf)
    some = asked.where(F.col("target") % 2 == 0).select("sf", F.col("target").alias("lf_idx"), "mu", "var")
    both = sc.ensemble([_candidates(members).select("sf", "lf_idx", "mu", "var"), some], ["sf", "lf_idx"])
    return _glance(both, "sf", "lf_idx")


s.define("kl_scores", ("asked", "lf_gauss"), f"""
SELECT a.row_idx, a.sf, a.target, c.lf_idx, -{kl_sql('a.mu', 'a.var', 'c.mu', 'c.var')} AS score FROM asked a JOIN lf_gauss c USING (sf)""")
_RANK = """SELECT row_idx, sf, lf_idx, round(score, 5) AS score,
  row_number() OVER (PARTITION BY row_idx ORDER BY round(score, 5) DESC, lf_idx) AS rank FROM {}"""


def _ranked(scores):
    order = Window.partitionBy("row_idx").orderBy(F.desc(F.round("score", 5)), "lf_idx")
    return scores.select("row_idx", "sf", F.col("lf_idx").cast("bigint").alias("lf_idx"), F.round("score", 5).alias("score"),
                         F.row_number().over(order).cast("bigint").alias("rank"))


def _kl_scores(spark, sf):
    members, asked, _ = _members(spark, sf)
    return sc.score_by_kl(asked, _candidates(members))


@register("g05_rank_by_kl", s.with_(_RANK.format("kl_scores"), "kl_scores"))
def rank_by_kl(spark, sf):
    return _ranked(_kl_scores(spark, sf))


s.define("cells", ("lf_gauss",), f"""
SELECT sf, lf_idx, m, n / sum(n) OVER (PARTITION BY sf, lf_idx) AS p, list_transform(mu, lambda x: x + 0.1::DOUBLE * m) AS mu, var FROM (
  SELECT *, 1 + floor({s.u('sf', 'lf_idx', 'm', seed='c')} * 9) AS n FROM (SELECT *, unnest([0, 1, 2]) AS m FROM lf_gauss))""")


@register("g06_rank_by_marginal_kl", s.with_(_RANK.format(f"""(
  SELECT a.row_idx, a.sf, c.lf_idx, -sum(p * {kl_sql('a.mu', 'a.var', 'c.mu', 'c.var')}) AS score
  FROM asked a JOIN cells c USING (sf) GROUP BY a.row_idx, a.sf, c.lf_idx)"""), "asked", "cells"))
def rank_by_marginal_kl(spark, sf):
    members, asked, _ = _members(spark, sf)
    cells = _candidates(members).withColumn("m", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    cells = cells.withColumn("n", 1 + F.floor(uniform("sf", "lf_idx", "m", seed="c") * 9))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("sf", "lf_idx"))
    cells = cells.select("sf", "lf_idx", p.alias("p"), F.transform("mu", lambda x: x + F.lit(0.1) * F.col("m")).alias("mu"), "var")
    return _ranked(sc.score_by_marginal_kl(asked, cells))


@register("g07_rank_by_cosine", s.with_(_RANK.format("""(
  SELECT a.row_idx, a.sf, c.lf_idx, list_cosine_similarity(a.mu, c.mu) AS score FROM asked a JOIN lf_gauss c USING (sf))"""), "asked", "lf_gauss"))
def rank_by_cosine(spark, sf):
    members, asked, _ = _members(spark, sf)
    pooled = _candidates(members).withColumnRenamed("mu", "vec")
    return _ranked(sc.score_by_cosine(asked.withColumnRenamed("mu", "vec"), pooled))


@register("g08_mean_max_pool", s.with_("""
SELECT sf, lf_idx, round(sum((a + m) / 2), 6) AS total, round(sum((a + greatest(m, 0)) / 2), 6) AS padded FROM (
  SELECT sf, lf_idx, i, avg(x) AS a, max(x) AS m FROM (
    SELECT sf, lf_idx, unnest(vec) AS x, unnest(range(len(vec))) AS i FROM lf_members) GROUP BY ALL) GROUP BY sf, lf_idx""", "lf_members"))
def mean_max_pool(spark, sf):
    members = stage(_members(spark, sf)[0], "members")
    total = lambda d, n: d.select("sf", "lf_idx", F.round(ve.total(F.col("vec")), 6).alias(n))
    plain = total(sc.mean_max_pool(members, ["sf", "lf_idx"]), "total")
    padded = total(sc.mean_max_pool(members, ["sf", "lf_idx"], padded=True), "padded")
    return plain.join(padded, ["sf", "lf_idx"]).withColumn("lf_idx", F.col("lf_idx").cast("bigint"))


@register("g09_attention_pool", s.with_(f"""
SELECT sf, lf_idx, round(sum(x * e) / any_value(z), 6) AS total FROM (
  SELECT m.sf, m.lf_idx, unnest(m.vec) AS x, exp(3 * {s.u('token', seed='a')}) AS e, z
  FROM lf_members m JOIN (SELECT sf, lf_idx, sum(exp(3 * {s.u('token', seed='a')})) AS z FROM lf_members GROUP BY ALL) USING (sf, lf_idx))
GROUP BY sf, lf_idx""", "lf_members"))
def attention_pool(spark, sf):
    members = _members(spark, sf)[0].withColumn("score", 3 * uniform("token", seed="a"))
    pooled = sc.attention_pool(stage(members, "members"), ["sf", "lf_idx"], "score")
    return pooled.select("sf", F.col("lf_idx").cast("bigint").alias("lf_idx"), F.round(ve.total(F.col("vec")), 6).alias("total"))


s.define("id_gauss", ("vocab", "gauss"), """
SELECT v.id, g.mu, g.var FROM vocab v JOIN gauss g ON g.vec_id = v.id % (SELECT count(*) FROM gauss)""")
s.define("slots", ("windows", "slices"), f"""
SELECT w.gpos, w.center_id, w.positive_id, c.id AS negative_id FROM (
  SELECT gpos, center_id, left_ids[-1] AS positive_id, {s.u('gpos', '0', seed=0)} AS u FROM windows WHERE len(left_ids) > 0) w
JOIN slices c ON w.u >= c.lo AND w.u < c.hi""")


def _id_gauss(spark, sf, vocab):
    g = stage(gauss(spark, sf), "gauss")
    n = g.count()
    return stage(vocab.select("id", (F.col("id") % n).alias("vec_id")).join(sized(g), "vec_id").select("id", "mu", "var"), "id-gauss")


@register("g10_hinge_loss", s.with_(f"""
SELECT round(avg(greatest({kl_sql('q.mu', 'q.var', 'p.mu', '(p.var + 0.001)')} - {kl_sql('q.mu', 'q.var', 'n.mu', '(n.var + 0.001)')} + 1, 0)), 5) AS hinge,
       count(*) AS n
FROM slots s JOIN id_gauss q ON q.id = s.center_id JOIN id_gauss p ON p.id = s.positive_id JOIN id_gauss n ON n.id = s.negative_id""",
    "slots", "id_gauss"))
def hinge_loss(spark, sf):
    stream = fx.clean_tokens(spark, sf)
    vocab = fx.vocab(spark, sf, stream)
    words = wi.context_windows(vo.id_stream(stream, vocab), fx.WINDOW).where(F.size("left_ids") > 0)
    words = stage(words.select("gpos", "center_id", F.element_at("left_ids", -1).alias("positive_id")), "positives")
    slices = stage(vo.cumulative(stage(vo.sampling_distribution(vocab), "dist")), "slices")
    drawn = ex.negatives(words, slices, 1).select("gpos", "negative_id")
    loss = sc.hinge_loss(words.join(drawn, "gpos"), stage(_id_gauss(spark, sf, vocab), "gaussians"), 0.001)
    return loss.select(F.round("hinge", 5).alias("hinge"), "n")


@register("g11_reconstruction", s.with_(f"""
SELECT label, round(avg({kl_sql('mu', 'var', 'mu_b', 'var_b')}), 6) AS kl, count(*) AS n FROM pairs GROUP BY label""", "pairs"))
def reconstruction(spark, sf):
    pairs = _pairs(spark, sf).withColumnsRenamed({"mu_b": "prior_mu", "var_b": "prior_var"})
    kl = F.avg(ve.kl(F.col("mu"), F.col("var"), F.col("prior_mu"), F.col("prior_var")))
    return pairs.groupBy("label").agg(F.round(kl, 6).alias("kl"), F.count(F.lit(1)).alias("n"))


_SEED = 5
s.define("scores", (), f"""
SELECT doc_id AS row_idx, source AS sf, lf_idx, {s.u('doc_id', 'lf_idx', seed=_SEED)} AS score,
       floor({s.u('doc_id', seed='t')} * n)::BIGINT AS target
FROM (SELECT *, unnest(range(n)) AS lf_idx FROM (SELECT doc_id, source, 2 + doc_id % 4 AS n FROM documents))""")
s.define("ranked", ("scores",), """
SELECT row_idx, sf, target, arg_max(lf_idx, (score, -lf_idx)) AS pred, count(*) AS n_candidates,
       count(*) FILTER (score > mine OR (score = mine AND lf_idx < target)) + 1 AS rank
FROM (SELECT *, max(CASE WHEN lf_idx = target THEN score END) OVER (PARTITION BY row_idx) AS mine FROM scores) GROUP BY ALL""")


def _scores(spark, sf, seed=_SEED):
    docs = table(spark, sf, "documents").select("doc_id", "source").withColumn("n", 2 + F.col("doc_id") % 4)
    return docs.withColumn("lf_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1))).select(
        F.col("doc_id").alias("row_idx"), F.col("source").alias("sf"), "lf_idx", uniform("doc_id", "lf_idx", seed=seed).alias("score"),
        F.floor(uniform("doc_id", seed="t") * F.col("n")).alias("target"))


def _ranked_rows(spark, sf, seed=_SEED):
    return ev.rank_candidates(_scores(spark, sf, seed), ["sf"])


def _five(spark, sf):
    sfs = table(spark, sf, "documents").select(F.col("source").alias("sf")).distinct()
    return sfs.withColumn("lf_idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))))


@register("g12_cross_entropy", s.with_("""
SELECT sf, round(avg(lse - score), 6) AS log_loss, count(*) AS n FROM (
  SELECT *, ln(sum(exp(score)) OVER (PARTITION BY row_idx)) AS lse FROM scores) WHERE lf_idx = target GROUP BY sf""", "scores"))
def cross_entropy(spark, sf):
    losses = sc.example_losses(_scores(spark, sf), ["sf"])
    return losses.groupBy("sf").agg(F.round(F.avg("loss"), 6).alias("log_loss"), F.count(F.lit(1)).alias("n"))


s.define("by_weight", ("gauss",), f"SELECT vec_id, mu, floor({s.u('vec_id', seed='w')} * 1000)::BIGINT AS weight FROM gauss")


@register("g13_nearest_neighbours", s.with_("""
, top AS (SELECT * FROM by_weight ORDER BY weight DESC, vec_id LIMIT 100)
SELECT vec_id, rank, neighbour, round(c, 6) AS cosine FROM (
  SELECT a.vec_id, b.vec_id AS neighbour, list_cosine_similarity(a.mu, b.mu) AS c,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.mu, b.mu) DESC, b.vec_id) AS rank
  FROM top a JOIN top b ON a.vec_id <> b.vec_id) WHERE rank <= 5""", "by_weight").replace(")\n, top", "),\ntop"))
def nearest_neighbours(spark, sf):
    rows = gauss(spark, sf).select("vec_id", F.col("mu").alias("vec"), F.floor(uniform("vec_id", seed="w") * 1000).alias("weight"))
    near = sc.nearest_among_top(rows, "vec_id", "weight")
    return near.select("vec_id", F.col("rank").cast("bigint").alias("rank"), "neighbour", F.round("cosine", 6).alias("cosine"))


@register("g13_exact_neighbours", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS mu FROM embeddings WHERE embedding IS NOT NULL)
SELECT vec_id, rank, neighbour, c AS cosine FROM (
  SELECT vec_id, neighbour, c, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, neighbour) AS rank FROM (
    SELECT a.vec_id, b.vec_id AS neighbour, round(list_cosine_similarity(a.mu, b.mu), 6) AS c
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)) WHERE rank <= 5""")
def exact_neighbours(spark, sf):
    rows = table(spark, sf, "embeddings")
    index = ne.build_index(rows, "vec_id", "embedding")
    found = ne.exact_neighbours(index, rows.filter(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("key")))
    return found.withColumnRenamed("key", "vec_id")


@register("g13_neighbours_of_all")
def neighbours_of_all(spark, sf):
    index = ne.build_index(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return ne.neighbours(index).withColumnRenamed("key", "vec_id")


@register("g14_blend_sweep", s.with_(f"""
SELECT row_idx, weight, lf_idx, round(exp(score - top) / sum(exp(score - top)) OVER (PARTITION BY row_idx, weight), 5) AS p FROM (
  SELECT *, max(score) OVER (PARTITION BY row_idx, weight) AS top FROM (
    SELECT b.row_idx, b.weight, c.lf_idx, -{kl_sql('b.mu', 'b.var', 'c.mu', 'c.var')} AS score FROM (
      SELECT a.row_idx, a.sf, w AS weight, a.var, list_transform(list_zip(a.mu, g.mu), lambda z: (1 - w) * z[1] + w * z[2]) AS mu
      FROM asked a JOIN lf_gauss g ON g.sf = a.sf AND g.lf_idx = 0 CROSS JOIN (SELECT unnest([0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS w)) b
    JOIN lf_gauss c ON c.sf = b.sf))""", "asked", "lf_gauss"))
def blend_sweep(spark, sf):
    members, asked, _ = _members(spark, sf)
    candidates = _candidates(members)
    meta = candidates.where("lf_idx = 0").select("sf", F.col("mu").alias("metadata_mu"))
    rows = asked.withColumnRenamed("mu", "context_mu").join(meta, "sf")
    swept = sc.blend_sweep(rows, candidates)
    return swept.select("row_idx", "weight", F.col("lf_idx").cast("bigint").alias("lf_idx"), F.round("p", 5).alias("p"))


_DIMS = 64
s.define("cell_slots", ("windows", "id_gauss"), """
SELECT center_id, metadata_id, mu, w::DOUBLE AS w FROM (
  SELECT center_id, metadata_id, id, count(*) AS w FROM (
    SELECT center_id, metadata_id, unnest(list_concat(left_ids, right_ids)) AS id FROM windows) GROUP BY ALL) JOIN id_gauss USING (id)""")


@register("g15_cell_gaussians", s.with_(f"""
SELECT center_id, metadata_id, round(m[1], 6) AS first, round(greatest(0, (square - list_dot_product(m, m)) / {_DIMS}), 6) AS var, n FROM (
  SELECT center_id, metadata_id, sum(w)::BIGINT AS n, sum(w * list_dot_product(mu, mu)) / sum(w) AS square,
         [{', '.join(f'sum(w * mu[{i}]) / sum(w)' for i in range(1, _DIMS + 1))}] AS m
  FROM cell_slots GROUP BY ALL)""", "cell_slots"))
def cell_gaussians(spark, sf):
    stream = fx.clean_tokens(spark, sf)
    vocab = fx.vocab(spark, sf, stream)
    grams = ex.skip_grams(wi.fill_metadata(vo.id_stream(stream, vocab)), fx.WINDOW)
    vectors = _id_gauss(spark, sf, vocab).select("id", F.col("mu").alias("vec"))
    cells = sc.cell_gaussians(grams, vectors)
    return cells.select("center_id", "metadata_id", F.round(F.get("mu", 0), 6).alias("first"), F.round(F.get("var", 0), 6).alias("var"), "n")


@register("g16_top_keys", s.with_("SELECT token, count FROM token_counts WHERE kind = 'token' ORDER BY count DESC, token LIMIT 100", "token_counts"))
def top_keys(spark, sf):
    counts = vo.token_counts(fx.raw_tokens(spark, sf)).where("kind = 'token'")
    return sc.top_keys(counts, "token", "count").select("token", "count")


@register("e01_accuracy", s.with_("SELECT round(avg(CASE WHEN pred = target THEN 1.0 ELSE 0 END), 6) AS accuracy, count(*) AS n FROM ranked", "ranked"))
def accuracy(spark, sf):
    return ev.accuracy(_ranked_rows(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))


@register("e02_top_k_accuracy", s.with_("""
SELECT round(count(*) FILTER (rank <= 1 OR 1 > n_candidates) / count(*), 6) AS top_1,
       round(count(*) FILTER (rank <= 2 OR 2 > n_candidates) / count(*), 6) AS top_2,
       round(count(*) FILTER (rank <= 3 OR 3 > n_candidates) / count(*), 6) AS top_3 FROM ranked""", "ranked"))
def top_k_accuracy(spark, sf):
    out = ev.top_k_accuracy(_ranked_rows(spark, sf))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


s.define("confusion", ("ranked",), "SELECT sf, target, pred, count(*) AS n FROM ranked GROUP BY ALL")


@register("e03_confusion", s.with_("SELECT sf, target, pred, n FROM confusion", "confusion"))
def confusion(spark, sf):
    return ev.confusion(_ranked_rows(spark, sf))


s.define("classes", ("confusion",), """
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM (
  SELECT sf, lf_idx, coalesce(t.n, 0) AS support, coalesce(q.n, 0) AS predicted, coalesce(h.n, 0) AS hits,
         coalesce(coalesce(h.n, 0) / q.n, 0) AS precision, coalesce(coalesce(h.n, 0) / t.n, 0) AS recall
  FROM (SELECT sf, target AS lf_idx, sum(n) AS n FROM confusion GROUP BY ALL) t
  FULL JOIN (SELECT sf, pred AS lf_idx, sum(n) AS n FROM confusion GROUP BY ALL) q USING (sf, lf_idx)
  LEFT JOIN (SELECT sf, target AS lf_idx, n FROM confusion WHERE target = pred) h USING (sf, lf_idx))""")
_AVGS = [f"{a}_{b}" for a in ("micro", "macro", "weighted") for b in ("precision", "recall", "f1")]
s.define("report", ("classes",), "SELECT sf, sum(support)::BIGINT AS support, 5 AS num_targets, " + ", ".join(
    f"sum(hits) / sum(support) AS micro_{m}, avg({m}) FILTER (support > 0) AS macro_{m}, sum({m} * support) / sum(support) AS weighted_{m}"
    for m in ("precision", "recall", "f1")) + " FROM classes GROUP BY sf")


def _classes(spark, sf):
    return ev.class_report(ev.confusion(_ranked_rows(spark, sf)))


def _report(spark, sf):
    return ev.with_target_counts(ev.sf_report(_classes(spark, sf)), _five(spark, sf))


@register("e04_class_report", s.with_("""
SELECT sf, lf_idx, support::BIGINT AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM classes""", "classes"))
def class_report(spark, sf):
    return _classes(spark, sf).select("sf", "lf_idx", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@register("e05_macro_averages", s.with_("SELECT sf, " + ", ".join(f"round({c}, 6) AS {c}" for c in _AVGS if "macro" in c) + " FROM report", "report"))
def macro_averages(spark, sf):
    return _report(spark, sf).select("sf", *[F.round(c, 6).alias(c) for c in _AVGS if "macro" in c])


@register("e06_weighted_and_micro_averages", s.with_(
    "SELECT sf, support, num_targets::BIGINT AS num_targets, " + ", ".join(f"round({c}, 6) AS {c}" for c in _AVGS if "macro" not in c) + " FROM report", "report"))
def weighted_and_micro_averages(spark, sf):
    return _report(spark, sf).select("sf", "support", "num_targets", *[F.round(c, 6).alias(c) for c in _AVGS if "macro" not in c])


_GLOBAL = ", ".join(f"round(avg({c}), 6) AS {c}" for c in _AVGS if "micro" not in c)


@register("e07_global_means", s.with_(f"""
SELECT num_targets::BIGINT AS num_targets, {_GLOBAL}, count(*) AS n_sf FROM report GROUP BY num_targets
UNION ALL SELECT -1, {_GLOBAL}, count(*) FROM report""", "report"))
def global_means(spark, sf):
    out = ev.global_means(_report(spark, sf))
    names = [c for c in out.columns if c not in ("num_targets", "n_sf")]
    return out.select(F.coalesce("num_targets", F.lit(-1).cast("bigint")).alias("num_targets"), *[F.round(c, 6).alias(c) for c in names], "n_sf")


@register("e08_rare_recall", s.with_("""
SELECT round(avg(recall), 6) AS recall, count(*) AS n_rare FROM classes c
WHERE (sf, lf_idx) IN (SELECT (source, list_position(['de', 'en', 'es', 'fr'], lang) - 1) FROM documents
                       WHERE lang IN ('de', 'en', 'es', 'fr') GROUP BY source, lang HAVING count(*) < 5)""", "classes"))
def rare_recall(spark, sf):
    """Corpus contexts of a sense here: documents of the source in the sense's language."""
    place = F.array_position(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]), F.col("lang")) - 1
    counted = table(spark, sf, "documents").where(place >= 0).groupBy(
        F.col("source").alias("sf"), place.alias("lf_idx")).agg(F.count(F.lit(1)).alias("count"))
    cells = ev.confusion(_ranked_rows(spark, sf))
    return ev.rare_recall(ev.class_report(cells), counted).withColumn("recall", F.round("recall", 6))


@register("e09_example_report", s.with_("""
SELECT r.row_idx, r.sf, pred = target AS is_correct,
       'SF=' || sf || '. Target LF=' || target || '. Predicted LF=' || pred || '. Context: ' || text AS line
FROM ranked r JOIN documents d ON d.doc_id = r.row_idx""", "ranked"))
def example_report(spark, sf):
    texts = documents(spark, sf).select(F.col("doc_id").alias("row_idx"), F.col("text").alias("context"))
    rows = _ranked_rows(spark, sf).join(texts, "row_idx").withColumns(
        {"target_lf": F.col("target").cast("string"), "pred_lf": F.col("pred").cast("string")})
    return ev.example_report(rows)


@register("e10_chance_statistics", s.with_("""
SELECT round(sum(most) / sum(n), 6) AS dominant_accuracy, round(sum(n / 5) / sum(n), 6) AS random_accuracy FROM (
  SELECT sf, max(n) AS most, sum(n) AS n FROM (SELECT sf, target, count(*) AS n FROM ranked GROUP BY ALL) GROUP BY sf)""", "ranked"))
def chance_statistics(spark, sf):
    out = ev.chance_statistics(_ranked_rows(spark, sf), _five(spark, sf))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_BOOT = ["accuracy", "weighted_f1", "macro_f1", "log_loss"]
s.define("losses", ("scores",), """
SELECT row_idx, max(lse - score) AS loss FROM (
  SELECT *, ln(sum(exp(score)) OVER (PARTITION BY row_idx)) AS lse FROM scores) WHERE lf_idx = target GROUP BY row_idx""")
s.define("boot_cells", ("ranked", "losses"), f"""
SELECT i, sf, target, pred, count(*) AS n, sum(loss) AS loss
FROM (SELECT *, unnest(range(100)) AS i FROM ranked JOIN losses USING (row_idx))
WHERE {s.u('row_idx', 'i', seed=0)} < 0.8 GROUP BY ALL""")
s.define("boot_classes", ("boot_cells",), """
SELECT i, sf, c, sum(t) AS t, sum(q) AS q, sum(h) AS h, sum(loss) AS loss,
       CASE WHEN sum(t) + sum(q) > 0 THEN 2.0::DOUBLE * sum(h) / (sum(t) + sum(q)) ELSE 0 END AS f1 FROM (
  SELECT i, sf, target AS c, n AS t, 0 AS q, CASE WHEN target = pred THEN n ELSE 0 END AS h, loss FROM boot_cells
  UNION ALL SELECT i, sf, pred, 0, n, 0, 0 FROM boot_cells) GROUP BY i, sf, c""")
s.define("boot", ("boot_classes",), """
SELECT i, sum(h) / sum(t) AS accuracy, avg(wf1) AS weighted_f1, avg(mf1) AS macro_f1, sum(loss) / sum(t) AS log_loss FROM (
  SELECT i, sf, sum(h)::DOUBLE AS h, sum(t)::DOUBLE AS t, sum(loss) AS loss, avg(f1) FILTER (t > 0) AS mf1,
         CASE WHEN sum(t) > 0 THEN sum(f1 * t) / sum(t) ELSE 0 END AS wf1 FROM boot_classes GROUP BY i, sf) GROUP BY i""")


@register("e12_bootstrap", s.with_("""
SELECT metric, count(*) AS n, round(min(a), 6) AS least, round(max(a), 6) AS most, round(avg(a), 6) AS mean, round(var_samp(a), 8) AS variance,
       round((sum(pow(a - m, 3)) / count(*)) / pow(sum(pow(a - m, 2)) / count(*), 1.5), 3) AS skewness,
       round((sum(pow(a - m, 4)) / count(*)) / pow(sum(pow(a - m, 2)) / count(*), 2) - 3, 3) AS kurtosis FROM (
  SELECT metric, a, avg(a) OVER (PARTITION BY metric) AS m FROM (
    SELECT unnest(['accuracy', 'weighted_f1', 'macro_f1', 'log_loss']) AS metric, unnest([accuracy, weighted_f1, macro_f1, log_loss]) AS a FROM boot))
GROUP BY metric""", "boot"))
def bootstrap(spark, sf):
    scores = stage(_scores(spark, sf), "scores")
    outcomes = ev.rank_candidates(scores, ["sf"]).join(sc.example_losses(scores), "row_idx")
    runs = stage(ev.bootstrap(outcomes.select("row_idx", "sf", "target", "pred", "loss")), "bootstrap")
    each = [ev.describe(runs, c).withColumn("metric", F.lit(c)) for c in _BOOT]
    out = each[0]
    for other in each[1:]:
        out = out.unionByName(other)
    digits = {"variance": 8, "skewness": 3, "kurtosis": 3}
    return out.select("metric", "n", *[F.round(c, digits.get(c, 6)).alias(c) for c in out.columns if c not in ("n", "metric")])


@register("e13_canonical_labels", s.with_("""
SELECT lf AS target_lf_sense, any_value(upper(lf)) AS target_label FROM senses GROUP BY lf""", "senses"))
def canonical_labels(spark, sf):
    senses = fx.senses(spark, sf).select(F.col("lf").alias("target_lf_sense"), F.upper("lf").alias("target_label"))
    return ev.canonical_labels(senses.union(senses))


s.define("ranked_b", (), s.CTE["scores"][1].replace(f"'{_SEED}'", "'6'"))
s.define("compared", ("ranked", "ranked_b"), """
SELECT r.row_idx, r.pred = r.target AS a, b.pred = r.target AS b FROM ranked r
JOIN (SELECT row_idx, arg_max(lf_idx, (score, -lf_idx)) AS pred FROM ranked_b GROUP BY row_idx) b USING (row_idx)""")


def _compared(spark, sf):
    one = lambda seed: _ranked_rows(spark, sf, seed).select("row_idx", (F.col("pred") == F.col("target")).alias("is_correct"))
    return ev.paired_outcomes(one(_SEED), one(6))


@register("c01_comparison_sets", s.with_("""
SELECT row_idx, CASE WHEN a AND b THEN 'both' WHEN a THEN 'only_a' WHEN b THEN 'only_b' ELSE 'neither' END AS part FROM compared""", "compared"))
def comparison_sets(spark, sf):
    return ev.comparison_sets(_compared(spark, sf))


@register("c02_agreement_matrix", s.with_("SELECT a, b, count(*) AS n FROM compared GROUP BY ALL", "compared"))
def agreement_matrix(spark, sf):
    return ev.agreement(_compared(spark, sf))


@register("c03_disagreement_draw", s.with_(f"""
SELECT row_idx, part FROM (
  SELECT row_idx, CASE WHEN a THEN 'only_a' ELSE 'only_b' END AS part,
         row_number() OVER (PARTITION BY a ORDER BY {s.u('row_idx', seed=0)}, row_idx) AS rn FROM compared WHERE a <> b) WHERE rn <= 10""", "compared"))
def disagreement_draw(spark, sf):
    return ev.disagreement_draw(stage(_compared(spark, sf), "compared"))


@register("x12_candidate_expansion", s.with_("""
SELECT r.row_idx, r.sf, s.lf_idx, m.metadata, round(m.n / sum(m.n) OVER (PARTITION BY r.row_idx, s.lf_idx), 6) AS p, s.lf
FROM asked r JOIN senses s USING (sf)
JOIN (SELECT lf, unnest(['x', 'y']) AS metadata, unnest([len(lf), n]) AS n FROM senses) m USING (lf)""", "asked", "senses"))
def candidate_expansion(spark, sf):
    _, asked, senses = _members(spark, sf)
    tokens = senses.select("lf", F.split(F.replace("lf", F.lit(";"), F.lit(" ")), " ").alias("token_ids"))
    total = F.length("lf") + F.col("n")
    meta = senses.select("lf", F.inline(F.array(
        F.struct(F.lit("x").alias("metadata"), (F.length("lf") / total).alias("p")),
        F.struct(F.lit("y").alias("metadata"), (F.col("n") / total).alias("p")))))
    out = ex.expand_candidates(asked.select("row_idx", "sf"), senses.select("sf", "lf_idx", "lf"), tokens, meta)
    return out.select("row_idx", "sf", F.col("lf_idx").cast("bigint").alias("lf_idx"), "lf", F.inline("metadata")).withColumn("p", F.round("p", 6))

