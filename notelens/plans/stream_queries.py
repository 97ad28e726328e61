"""Queries over id streams: carried metadata, context windows, example tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelens.functions import text as tx
from notelens.functions.hashing import uniform
from notelens.operators import examples as ex
from notelens.operators import vocabulary as vo
from notelens.operators import windows as wi
from notelens.operators.scale import number_rows, stage, stage_by
from notelens.plans import fixtures as fx
from notelens.plans import text_queries  # noqa: F401  (its SQL fragments)
from notelens.plans import sql as s
from notelens.plans.registry import documents, register

big = lambda c: F.col(c).cast("bigint").alias(c)
joined = lambda c: F.array_join(c, " ")


def ids(spark, sf):
    return stage_by(fx.ids(spark, sf).select("doc_id", "pos", "gpos", "id", "kind"), "doc_id", "pos", "ids")


def filled(spark, sf):
    return wi.fill_metadata(ids(spark, sf))


@register("w01_carried_section", s.with_("SELECT gpos, id, metadata_id FROM filled", "filled"))
def carried_section(spark, sf):
    return filled(spark, sf).select("gpos", "id", "metadata_id")


@register("w01_carried_section_across_notes", s.with_("""
SELECT gpos, id, coalesce(last_value(CASE WHEN kind = 'section' THEN id END IGNORE NULLS)
                          OVER (ORDER BY gpos ROWS UNBOUNDED PRECEDING), 0) AS metadata_id FROM ids""", "ids"))
def carried_section_across(spark, sf):
    return wi.fill_metadata(ids(spark, sf), across=True).select("gpos", "id", "metadata_id")


@register("w02_section_and_category", s.with_("""
SELECT gpos, CASE WHEN sec_at > cat_at THEN sec ELSE 0 END AS section_id, coalesce(cat, 0) AS category_id FROM (
  SELECT gpos, last_value(CASE WHEN kind = 'section' THEN id END IGNORE NULLS) OVER w AS sec,
         last_value(CASE WHEN kind = 'category' THEN id END IGNORE NULLS) OVER w AS cat,
         coalesce(last_value(CASE WHEN kind = 'section' THEN gpos END IGNORE NULLS) OVER w, -1) AS sec_at,
         coalesce(last_value(CASE WHEN kind = 'category' THEN gpos END IGNORE NULLS) OVER w, -1) AS cat_at
  FROM ids WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))""", "ids"))
def section_and_category(spark, sf):
    return wi.fill_section_and_category(ids(spark, sf)).select("gpos", "section_id", "category_id")


s.define("runs", ("filled",), """
SELECT *, sum(CASE WHEN kind = 'token' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM filled""")
s.define("windows", ("runs",), f"""
SELECT gpos, doc_id, id AS center_id, metadata_id, coalesce(l, []) AS left_ids, coalesce(r, []) AS right_ids FROM (
  SELECT *, list(id) FILTER (kind = 'token') OVER (PARTITION BY doc_id, run ORDER BY pos ROWS BETWEEN {fx.WINDOW} PRECEDING AND 1 PRECEDING) AS l,
         list(id) FILTER (kind = 'token') OVER (PARTITION BY doc_id, run ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {fx.WINDOW} FOLLOWING) AS r
  FROM runs) WHERE kind = 'token'""")


@register("w03_context_windows", s.with_("""
SELECT gpos, center_id, array_to_string(left_ids, ' ') AS left_ids, array_to_string(right_ids, ' ') AS right_ids
FROM windows""", "windows"))
def context_windows(spark, sf):
    return wi.context_windows(ids(spark, sf), fx.WINDOW).select(
        "gpos", "center_id", joined("left_ids").alias("left_ids"), joined("right_ids").alias("right_ids")
    )


s.define("arrays", ("raw_tokens",), """
SELECT doc_id, list(token ORDER BY pos) AS t, count(*) // 2 AS target,
       coalesce(max(pos) FILTER (kind = 'section' AND pos < n // 2), -1) AS l,
       coalesce(min(pos) FILTER (kind = 'section' AND pos > n // 2), -1) AS r
FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM raw_tokens) GROUP BY doc_id""")


@register("w04_window_around_target", s.with_(f"""
SELECT doc_id, array_to_string(list_concat(t[greatest(target - {fx.WINDOW}, 0, l + 1) + 1 : target],
         t[target + 2 : least(target + {fx.WINDOW} + 1, len(t), CASE WHEN r < 0 THEN len(t) ELSE r END)]), ' ') AS around
FROM arrays""", "arrays"))
def window_around_target(spark, sf):
    docs = fx.docs(spark, sf).withColumn("target", F.floor(F.size("tokens") / 2).cast("int"))
    near = docs.withColumn("near", wi.nearest_headers(F.col("tokens"), F.col("target")))
    around = wi.window_around(
        F.col("tokens"), F.col("target"), fx.WINDOW,
        F.coalesce(F.col("near.left") + 1, F.lit(0)), F.coalesce("near.right", F.size("tokens")),
    )
    return near.select("doc_id", joined(around).alias("around"))


@register("w05_nearest_headers", s.with_("""
SELECT doc_id, l AS left_at, r AS right_at, CASE WHEN l >= 0 THEN t[l + 1] ELSE '' END AS left_header FROM arrays""", "arrays"))
def nearest_headers(spark, sf):
    docs = fx.docs(spark, sf).withColumn("target", F.floor(F.size("tokens") / 2).cast("int"))
    near = docs.withColumn("near", wi.nearest_headers(F.col("tokens"), F.col("target")))
    return near.select(
        "doc_id", F.coalesce(F.col("near.left").cast("bigint"), F.lit(-1)).alias("left_at"),
        F.coalesce(F.col("near.right").cast("bigint"), F.lit(-1)).alias("right_at"),
        F.coalesce(F.get("tokens", F.col("near.left")), F.lit("")).alias("left_header"),
    )


@register("w07_header_levels", s.with_("""
, pairs AS (SELECT a.section AS container, b.section AS inside FROM sections a JOIN sections b
            ON instr(substr(a.section, 2), b.section) > 0),
chain AS (SELECT section, 0 AS level FROM sections
          UNION SELECT p.inside, c.level + 1 FROM chain c JOIN pairs p ON p.container = c.section)
SELECT section, max(level) AS level FROM chain GROUP BY section""", "sections").replace("WITH ", "WITH RECURSIVE ", 1).replace(")\n, pairs", "),\npairs"))
def header_levels(spark, sf):
    return wi.header_levels(fx.sections(spark, sf)).select("section", big("level"))


@register("w10_row_numbers", "SELECT doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS row_idx FROM documents")
def row_numbers(spark, sf):
    return number_rows(documents(spark, sf).select("doc_id", "source"), ["source", "doc_id"], "row_idx").select("doc_id", "row_idx")


@register("m06_token_metadata_counts", s.with_("""
SELECT id, metadata_id, count(*) AS n FROM filled WHERE kind = 'token' GROUP BY ALL""", "filled"))
def token_metadata_counts(spark, sf):
    return wi.token_metadata(filled(spark, sf))


@register("x01_skip_grams", s.with_("""
SELECT gpos, center_id, metadata_id, array_to_string(list_concat(left_ids, right_ids), ' ') AS context_ids,
       (len(left_ids) + len(right_ids))::BIGINT AS context_size FROM windows""", "windows"))
def skip_grams(spark, sf):
    return ex.skip_grams(filled(spark, sf), fx.WINDOW).select(
        "gpos", "center_id", "metadata_id", joined("context_ids").alias("context_ids"),
        F.col("window").cast("bigint").alias("context_size"),
    )


_SLOTS = 4


@register("x02_negative_draws", s.with_(f"""
SELECT c.id AS negative_id, count(*) AS n, sum(gpos)::BIGINT AS positions FROM (
  SELECT gpos, slot, {s.u('gpos', 'slot', seed=0)} AS u
  FROM (SELECT gpos, unnest(range({_SLOTS})) AS slot FROM ids WHERE kind = 'token')) d
JOIN slices c ON d.u >= c.lo AND d.u < c.hi GROUP BY c.id""", "ids", "slices"))
def negative_draws(spark, sf):
    stream = fx.clean_tokens(spark, sf)
    vocab = fx.vocab(spark, sf, stream)
    slices = stage(vo.cumulative(stage(vo.sampling_distribution(vocab), "dist")), "slices")
    words = vo.id_stream(stream, vocab).where("kind = 'token'")
    return ex.negatives(words, slices, _SLOTS).groupBy("negative_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("gpos").alias("positions")
    )


s.define("token_metadata", ("filled",), """
SELECT id, metadata_id, count(*) AS n FROM filled WHERE kind = 'token' GROUP BY ALL""")
s.define("metadata_size", ("vocab",), """
SELECT count(*) FILTER (kind IN ('section', 'category')) + 1 AS m,
       min(id) FILTER (kind IN ('section', 'category')) AS first_id FROM vocab""")


def _metadata_counts(spark, sf):
    stream = fx.clean_tokens(spark, sf)
    vocab = fx.vocab(spark, sf, stream)
    words = stage(wi.fill_metadata(vo.id_stream(stream, vocab)).select("gpos", "id", "kind", "metadata_id"), "filled")
    counts = stage(wi.token_metadata(words), "token-metadata")
    meta = vocab.where(F.col("kind").isin("section", "category"))
    n, first = meta.agg(F.count(F.lit(1)), F.min("id")).first()
    return words, counts, n + 1, first


@register("x03_smoothed_metadata", s.with_("""
SELECT id, metadata_id, round((n + 1) / (sum(n) OVER (PARTITION BY id) + m), 9) AS p FROM token_metadata, metadata_size
UNION ALL
SELECT id, -1, round((any_value(m) - count(*)) / (sum(n) + any_value(m)), 9) FROM token_metadata, metadata_size GROUP BY id""",
    "token_metadata", "metadata_size"))
def smoothed_metadata(spark, sf):
    _, counts, n, _ = _metadata_counts(spark, sf)
    return ex.smoothed_metadata(counts, n).withColumn("p", F.round("p", 9))


s.define("samples", ("token_metadata", "metadata_size"), f"""
SELECT a.id, a.draw, a.slot,
       CASE WHEN a.v = 0 THEN 0 WHEN a.v < m THEN first_id + a.v - 1 ELSE t.metadata_id END AS metadata_id FROM (
  SELECT id, draw, slot, m, first_id, floor({s.u('id', 'draw', 'slot', seed=0)} * (total + m))::BIGINT AS v FROM (
    SELECT *, unnest(range(3)) AS slot FROM (
      SELECT id, sum(n) AS total, unnest(range(least(count(*) * 10, 1000))) AS draw FROM token_metadata GROUP BY id))
  CROSS JOIN metadata_size) a
LEFT JOIN (SELECT *, sum(n) OVER (PARTITION BY id ORDER BY metadata_id) AS hi FROM token_metadata) t
  ON t.id = a.id AND a.v >= m AND a.v - m >= hi - n AND a.v - m < hi""")


@register("x04_metadata_samples", s.with_("""
SELECT id, metadata_id, count(*) AS n, sum(draw)::BIGINT AS draws FROM samples GROUP BY ALL""", "samples"))
def metadata_samples(spark, sf):
    _, counts, n, first = _metadata_counts(spark, sf)
    return ex.metadata_samples(counts, first, n).groupBy("id", "metadata_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("draw").alias("draws")
    )


@register("x05_round_robin_samples", s.with_("""
SELECT o.gpos, s.slot, s.metadata_id FROM (
  SELECT id, gpos, row_number() OVER (PARTITION BY id ORDER BY gpos) - 1 AS k FROM ids WHERE kind = 'token') o
JOIN (SELECT *, max(draw) OVER (PARTITION BY id) + 1 AS draws FROM samples) s ON s.id = o.id AND s.draw = o.k % s.draws""",
    "ids", "samples"))
def round_robin_samples(spark, sf):
    words, counts, n, first = _metadata_counts(spark, sf)
    samples = stage(ex.metadata_samples(counts, first, n), "samples")
    return ex.round_robin(words.where("kind = 'token'").select("id", "gpos"), samples).select(
        "gpos", big("slot"), "metadata_id"
    )


@register("x06_shuffled_batches", s.with_(f"""
SELECT batch, gpos FROM (
  SELECT gpos, (rn - 1) // 1024 AS batch FROM (
    SELECT gpos, row_number() OVER (ORDER BY {s.u('gpos', seed=0)}, gpos) AS rn, count(*) OVER () AS n FROM ids WHERE kind = 'token')
  WHERE rn <= n // 1024 * 1024)""", "ids"))
def shuffled_batches(spark, sf):
    words = fx.ids(spark, sf).where("kind = 'token'").select("gpos")
    return ex.shuffled_batches(words, ["gpos"], 1024).select(big("batch"), "gpos")


@register("x07_even_batches", f"""
SELECT ntile(greatest(1, (SELECT count(*) // 512 FROM events))) OVER (ORDER BY {s.u('event_id', seed=0)}, event_id) - 1 AS batch,
       event_id FROM events""")
def even_batches(spark, sf):
    from notelens.plans.registry import table

    rows = table(spark, sf, "events").select("event_id")
    return ex.even_batches(rows, ["event_id"], 512).select(big("batch"), "event_id")


s.define("dual", ("ids",), """
SELECT gpos, id, kind, CASE WHEN sec_at > cat_at THEN sec ELSE 0 END AS section_id, coalesce(cat, 0) AS category_id FROM (
  SELECT *, last_value(CASE WHEN kind = 'section' THEN id END IGNORE NULLS) OVER w AS sec,
         last_value(CASE WHEN kind = 'category' THEN id END IGNORE NULLS) OVER w AS cat,
         coalesce(last_value(CASE WHEN kind = 'section' THEN gpos END IGNORE NULLS) OVER w, -1) AS sec_at,
         coalesce(last_value(CASE WHEN kind = 'category' THEN gpos END IGNORE NULLS) OVER w, -1) AS cat_at
  FROM ids WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING))""")


@register("x08_mixed_centers", s.with_(f"""
SELECT gpos, CASE WHEN u < 0.7 THEN id WHEN u < 0.7::DOUBLE + 0.2::DOUBLE THEN section_id ELSE category_id END AS center_id
FROM (SELECT *, {s.u('gpos', seed=8)} AS u FROM dual WHERE kind = 'token')""", "dual"))
def mixed_centers(spark, sf):
    words = wi.fill_section_and_category(ids(spark, sf)).where("kind = 'token'")
    center = ex.mixed_center(uniform("gpos", seed=8), F.col("id"), F.col("section_id"), F.col("category_id"))
    return words.select("gpos", center.alias("center_id"))


@register("x09_masked_contexts", s.with_(f"""
SELECT gpos, array_to_string(list_transform(list_concat(left_ids, right_ids),
         lambda x, i: CASE WHEN {s.u('gpos', 'i - 1', seed=9)} < 0.2 THEN 0 ELSE x END), ' ') AS context_ids FROM windows""", "windows"))
def masked_contexts(spark, sf):
    rows = ex.skip_grams(filled(spark, sf), fx.WINDOW)
    return rows.select("gpos", joined(ex.mask_slots(F.col("context_ids"), F.col("gpos"), 0.2, 9)).alias("context_ids"))


def _sub(v: str) -> str:
    return f"CASE {v} % 3 WHEN 0 THEN [1000 + {v}] WHEN 1 THEN [1000 + {v}, 11] ELSE [1000 + {v}, 11, 12] END"


_LEN = int((2 * fx.WINDOW + 1) * 2.5) + 2


@register("x10_joint_sequences", s.with_(f"""
SELECT gpos, array_to_string(list_concat(q[1:{_LEN}], list_transform(range(greatest({_LEN} - len(q), 0)), lambda z: 0)), ' ') AS ids,
       least(len(q), {_LEN})::BIGINT AS used, greatest({_LEN} - c - 2, 0)::BIGINT AS second_segment FROM (
  SELECT gpos, len(flat) AS c, list_concat([101], flat, [102], {_sub('metadata_id')}, {_sub('center_id')}, [102]) AS q FROM (
    SELECT *, flatten(list_transform(list_concat(left_ids, [center_id], right_ids), lambda v: {_sub('v')})) AS flat FROM windows))""",
    "windows"))
def joint_sequences(spark, sf):
    stream = fx.clean_tokens(spark, sf)
    vocab = fx.vocab(spark, sf, stream)
    words = wi.fill_metadata(vo.id_stream(stream, vocab))
    rest = F.when(F.col("id") % 3 == 0, F.array()).when(F.col("id") % 3 == 1, F.array(F.lit(11))).otherwise(F.array(F.lit(11), F.lit(12)))
    pieces = stage(vocab.select("id", F.concat(F.array(F.col("id") + 1000), rest.cast("array<bigint>")).alias("pieces")), "pieces")
    out = ex.joint_sequences(words, pieces, pieces, fx.WINDOW, 101, 102)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return out.select("gpos", joined("ids").alias("ids"), total("mask").alias("used"), total("segments").alias("second_segment"))


@register("x11_padded_arrays", s.with_("""
SELECT gpos, array_to_string(list_concat(c[1:15], list_transform(range(greatest(15 - len(c), 0)), lambda z: 0)), ' ') AS ids,
       array_to_string(list_transform(range(15), lambda i: CASE WHEN i < len(c) THEN 1 ELSE 0 END), '') AS mask
FROM (SELECT gpos, list_concat(left_ids, right_ids) AS c FROM windows)""", "windows"))
def padded_arrays(spark, sf):
    rows = ex.skip_grams(filled(spark, sf), fx.WINDOW)
    return rows.select(
        "gpos", joined(ex.pad_to(F.col("context_ids"), 15)).alias("ids"),
        F.array_join(ex.pad_mask(F.col("context_ids"), 15).cast("array<string>"), "").alias("mask"),
    )
