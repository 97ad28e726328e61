"""Queries over mined examples: scans, contexts, sampling, splits, marginals."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelens.functions import text as tx
from notelens.operators import marginals as ma
from notelens.operators import mining as mi
from notelens.operators.scale import sized, stage
from notelens.plans import fixtures as fx
from notelens.plans import sql as s
from notelens.plans.registry import documents, register

W = f"[{tx.WORD_CHARS}]+"
LONE = "len({0}) = 1 AND NOT regexp_matches({0}, '^[\\p{{L}}\\p{{N}}]$')"

s.define("note_words", ("notes",), f"""
SELECT doc_id, category, w, list_transform(w, lambda x: lower(x)) AS lw FROM (
  SELECT doc_id, category, list_filter(regexp_split_to_array(text, '{s.SP}+'), lambda x: x <> '') AS w FROM notes)""")
s.define("entries", ("senses",), "SELECT sf, lf, lf_idx, unnest(string_split(lf, ';')) AS phrase FROM senses")
s.define("raw_hits", ("note_words", "entries"), f"""
SELECT h.doc_id, h.word_at, h.one_run, e.lf, e.sf, e.lf_idx FROM (
  SELECT doc_id, word_at, regexp_full_match(x, '{W}') AS one_run,
         regexp_extract(x, '({W})$', 1) || ' ' || regexp_extract(y, '^({W})', 1) AS phrase
  FROM (SELECT doc_id, unnest(range(len(lw) - 1)) AS word_at, unnest(lw[1:len(lw) - 1]) AS x, unnest(lw[2:]) AS y FROM note_words)) h
JOIN entries e USING (phrase)""")
s.define("hits", ("raw_hits",), """
SELECT doc_id, word_at, lf, sf, lf_idx FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, lf, island ORDER BY word_at) AS k FROM (
    SELECT *, sum(CASE WHEN linked THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, lf ORDER BY word_at) AS island FROM (
      SELECT *, coalesce(lag(word_at) OVER (PARTITION BY doc_id, lf ORDER BY word_at) = word_at - 1 AND one_run, false) AS linked FROM raw_hits)))
WHERE k % 2 = 1""")


# the same with every frequent pair in the dictionary
s.define("dictionary", ("pair_counts",), """
SELECT sf, 0 AS lf_idx, string_agg(pair, ';' ORDER BY pair) AS lf FROM pair_counts GROUP BY sf, substr(md5(pair), 1, 3)""")
s.define("all_entries", ("dictionary",), s.CTE["entries"][1].replace("senses", "dictionary"))
s.define("all_raw_hits", ("note_words", "all_entries"), s.CTE["raw_hits"][1].replace("JOIN entries", "JOIN all_entries"))
s.define("all_hits", ("all_raw_hits",), s.CTE["hits"][1].replace("raw_hits", "all_raw_hits"))


def _head(c: str) -> str:
    return f"{c}[CASE WHEN len({c}) > 0 AND {LONE.format(c + '[1]')} THEN 2 ELSE 1 END:]"


def _tail(c: str) -> str:
    return f"{c}[:len({c}) - CASE WHEN len({c}) > 0 AND {LONE.format(c + '[-1]')} THEN 1 ELSE 0 END]"


s.define("contexts", ("hits", "note_words"), f"""
SELECT doc_id, category, lf, sf, lf_idx, word_at, lf_match,
       array_to_string(list_concat(l[greatest(len(l) - 19, 1):], ['TARGETWORD'], r[1:20]), ' ') AS context FROM (
  SELECT doc_id, category, lf, sf, lf_idx, word_at, lf_match, {_tail('l1')} AS l, {_tail('r1')} AS r FROM (
    SELECT doc_id, category, lf, sf, lf_idx, word_at, lf_match, {_head('l0')} AS l1, {_head('r0')} AS r1 FROM (
      SELECT h.*, n.category, regexp_extract(w[word_at + 1], '({W})$', 1) || ' ' || regexp_extract(w[word_at + 2], '^({W})', 1) AS lf_match,
             list_concat(w[1:word_at], list_filter([regexp_replace(w[word_at + 1], '{W}$', '')], lambda x: x <> '')) AS l0,
             list_concat(list_filter([regexp_replace(w[word_at + 2], '^{W}', '')], lambda x: x <> ''), w[word_at + 3:]) AS r0
      FROM hits h JOIN note_words n USING (doc_id))))""")


s.define("all_contexts", ("all_hits", "note_words"), s.CTE["contexts"][1].replace("FROM hits", "FROM all_hits"))


def _senses(spark, sf):
    return stage(fx.senses(spark, sf), "senses")


def _contexts(spark, sf):
    senses = _senses(spark, sf)
    return stage(mi.long_form_contexts(fx.notes(spark, sf), senses), "contexts"), senses


def _labels(senses):
    return senses.select("sf", F.col("lf").alias("target_lf_sense"), "lf")


@register("r01_dictionary_scan", s.with_("SELECT doc_id, lf, count(*) AS n, sum(word_at)::BIGINT AS places FROM all_hits GROUP BY ALL", "all_hits"))
def dictionary_scan(spark, sf):
    entries, forms = mi.with_form_numbers(stage(mi.long_form_entries(fx.dictionary(spark, sf)), "entries"))
    chosen = mi.choose(mi.scan(fx.notes(spark, sf), entries))
    return mi.name_forms(chosen.select("doc_id", "lf", F.inline("kept")).groupBy("doc_id", "lf").agg(
        F.count(F.lit(1)).alias("n"), F.sum("at").alias("places")
    ), forms)


_EVERY_FORM = f"""
SELECT d.doc_id, e.sf, count(*) AS n FROM (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '{W}')) AS word FROM notes) d
JOIN (SELECT DISTINCT sf, lower(sf) || unnest(['', 's']) AS phrase FROM senses) e ON e.phrase = d.word GROUP BY ALL"""


@register("r02_short_form_scan", s.with_(_EVERY_FORM, "notes", "senses"))
def short_form_scan(spark, sf):
    entries = stage(mi.short_form_entries(_senses(spark, sf), endings=True), "entries")
    chosen = mi.choose(mi.scan(fx.notes(spark, sf), entries))
    return chosen.select("doc_id", F.col("lf").alias("sf"), F.size("kept").cast("bigint").alias("n"))


@register("r03_inflected_entries", s.with_("""
, forms AS (SELECT DISTINCT unnest(string_split(phrase, ' ')) AS word FROM entries),
every AS (SELECT word, word AS form FROM forms UNION SELECT word, word || 's' FROM forms WHERE word NOT LIKE '%s'
          UNION SELECT word, substr(word, 1, len(word) - 1) FROM forms WHERE word LIKE '%s' AND len(word) > 1)
SELECT DISTINCT lf, a.form || ' ' || b.form AS phrase FROM entries
JOIN every a ON a.word = string_split(phrase, ' ')[1] JOIN every b ON b.word = string_split(phrase, ' ')[2]""",
    "entries").replace(")\n, forms", "),\nforms"))
def inflected_entries(spark, sf):
    entries = stage(mi.long_form_entries(_senses(spark, sf)), "entries")
    words = entries.select(F.explode(F.split("phrase", " ")).alias("word")).distinct()
    ends = F.col("word").endswith("s")
    form = F.when(~ends, F.concat("word", F.lit("s"))).when(F.length("word") > 1, F.substring(F.col("word"), F.lit(1), F.length("word") - 1))
    forms = stage(words.select("word", form.alias("form")).where(F.col("form").isNotNull()), "forms")
    return mi.with_inflections(entries, forms).select("lf", "phrase")


@register("r04_word_contexts", s.with_(
    "SELECT doc_id, category, lf, word_at::BIGINT AS word_at, lf_match, context FROM all_contexts", "all_contexts"))
def word_contexts(spark, sf):
    return mi.long_form_contexts(fx.notes(spark, sf), fx.dictionary(spark, sf)).select("doc_id", "category", "lf", F.col("at").cast("bigint").alias("word_at"), "lf_match", "context")


@register("r06_document_contexts", s.with_("""
SELECT DISTINCT h.lf, h.doc_id, md5(n.text) AS digest FROM hits h JOIN notes n USING (doc_id)""", "hits"))
def document_contexts(spark, sf):
    notes = fx.notes(spark, sf)
    hits = mi.scan(notes, stage(mi.long_form_entries(_senses(spark, sf)), "entries"))
    return mi.document_contexts(notes, hits).select("lf", "doc_id", F.md5("context").alias("digest"))


s.define("counted", ("senses", "contexts"), """
SELECT s.sf, s.lf, s.lf_idx, coalesce(c.n, 0) AS count FROM senses s LEFT JOIN (SELECT lf, count(*) AS n FROM contexts GROUP BY lf) c USING (lf)""")


@register("r08_counted_inventory", s.with_("SELECT sf, lf, count FROM counted", "counted"))
def counted_inventory(spark, sf):
    contexts, senses = _contexts(spark, sf)
    return mi.attach_counts(senses, contexts).select("sf", "lf", "count")


@register("r09_inventory_stats", s.with_("""
SELECT count(*) AS n_lf, count(*) FILTER (count = 0) AS n_zero, count(*) FILTER (count < 5) AS n_few,
       (SELECT count(*) FROM (SELECT sf FROM counted GROUP BY sf HAVING min(count) > 1)) AS n_viable_sf FROM counted""", "counted"))
def inventory_stats(spark, sf):
    contexts, senses = _contexts(spark, sf)
    return mi.inventory_stats(mi.attach_counts(senses, contexts))


s.define("viable", ("counted",), "SELECT sf FROM counted GROUP BY sf HAVING min(count) > 1")


@register("r10_viable_senses", s.with_("SELECT sf, lf, count FROM counted WHERE sf IN (SELECT sf FROM viable)", "viable"))
def viable_senses(spark, sf):
    contexts, senses = _contexts(spark, sf)
    return mi.viable_senses(mi.attach_counts(senses, contexts)).select("sf", "lf", "count")


@register("r11_labelled_contexts", s.with_("""
SELECT doc_id, word_at::BIGINT AS word_at, lf, sf, lf AS target_lf_sense FROM contexts WHERE sf IN (SELECT sf FROM viable)""", "contexts", "viable"))
def labelled_contexts(spark, sf):
    contexts, senses = _contexts(spark, sf)
    labels = mi.viable_senses(mi.attach_counts(_labels(senses), contexts))
    return mi.label_contexts(contexts, labels).select("doc_id", F.col("at").cast("bigint").alias("word_at"), "lf", "sf", "target_lf_sense")


_CAP = 500
s.define("capped", ("contexts", "viable"), f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY lf ORDER BY {s.u('doc_id', 'word_at', seed=0)}, doc_id, word_at) AS rn,
         least(count(*) OVER (PARTITION BY lf), {_CAP}) AS n
  FROM contexts WHERE sf IN (SELECT sf FROM viable)) WHERE rn <= {_CAP}""")
s.define("split_examples", ("capped",), f"""
SELECT *, row_number() OVER (PARTITION BY lf ORDER BY {s.u('doc_id', 'word_at', seed=1)}, doc_id, word_at) <= greatest(1, floor(n * 0.8)) AS is_train
FROM capped""")


def _split(spark, sf):
    contexts, senses = _contexts(spark, sf)
    labels = stage(mi.viable_senses(mi.attach_counts(_labels(senses), contexts)), "labels")
    capped = mi.cap_per_long_form(mi.label_contexts(contexts, labels), ["doc_id", "at"], _CAP)
    return mi.split_per_long_form(capped, ["doc_id", "at"], 0.8, seed=1), senses


@register("r12_capped_examples", s.with_("SELECT lf, doc_id, word_at::BIGINT AS word_at FROM capped", "capped"))
def capped_examples(spark, sf):
    return _split(spark, sf)[0].select("lf", "doc_id", F.col("at").cast("bigint").alias("word_at"))


@register("r13_split_examples", s.with_("SELECT lf, doc_id, word_at::BIGINT AS word_at, is_train FROM split_examples", "split_examples"))
def split_examples(spark, sf):
    return _split(spark, sf)[0].select("lf", "doc_id", F.col("at").cast("bigint").alias("word_at"), "is_train")


@register("r15_unused_notes", s.with_("SELECT doc_id FROM notes WHERE doc_id NOT IN (SELECT doc_id FROM capped)", "notes", "capped"))
def unused_notes(spark, sf):
    return mi.without_documents(fx.notes(spark, sf), _split(spark, sf)[0]).select("doc_id")


s.define("context_pieces", ("split_examples", "sections"), """
SELECT doc_id, word_at, lf, i, piece, i % 2 = 1 AS is_header FROM (
  SELECT doc_id, word_at, lf, unnest(p) AS piece, unnest(range(len(p))) AS i FROM (
    SELECT doc_id, word_at, lf, string_split(regexp_replace(upper(replace(context, 'ß', 'SS')), (
      SELECT '\\b(' || string_agg(section, '|' ORDER BY length(section) DESC, section) || '):' FROM sections),
      chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p FROM split_examples))
WHERE i % 2 = 1 OR trim(piece) <> ''""")
s.define("context_tokens", ("context_pieces",), f"""
SELECT doc_id, word_at, lf, list_filter(t, lambda x, i: i = 1 OR x <> t[i - 1]) AS tokens FROM (
  SELECT doc_id, word_at, lf, flatten(list(t ORDER BY i)) AS t FROM (
    SELECT doc_id, word_at, lf, i, CASE WHEN is_header AND coalesce(lead(is_header) OVER (PARTITION BY doc_id, word_at, lf ORDER BY i), false) THEN []
           WHEN is_header THEN [{s.pseudo('header=', 'piece')}] ELSE {s.words(s.clean('piece'))} END AS t FROM context_pieces)
  GROUP BY doc_id, word_at, lf)""")


def _tokens(spark, sf):
    from notelens.operators.scale import number_rows

    examples, senses = _split(spark, sf)
    numbered = stage(number_rows(stage(examples, "examples"), ["doc_id", "at", "lf"], "row_idx"), "numbered")
    sections = fx.sections(spark, sf)
    tokens = mi.tokenize_with_headers(numbered.select("row_idx", F.col("context").alias("text")), sections, "row_idx")
    return numbered, stage(tokens, "context-tokens"), senses, sections


@register("w08_context_tokens", s.with_("""
SELECT doc_id, word_at::BIGINT AS word_at, lf, array_to_string(tokens, ' ') AS tokens FROM context_tokens""", "context_tokens"))
def context_tokens(spark, sf):
    numbered, tokens, _, _ = _tokens(spark, sf)
    return numbered.join(tokens, "row_idx").select(
        "doc_id", F.col("at").cast("bigint").alias("word_at"), "lf", F.array_join("tokens", " ").alias("tokens")
    )


s.define("header_marks", ("notes", "sections"), f"""
SELECT doc_id, word_at, 'header=' || replace(section, ' ', '') AS header FROM (
  SELECT doc_id, section, len(list_filter(regexp_split_to_array(
           array_to_string(l[1:i - 1], ' ') || ' ' || regexp_extract(l[i], '^[^:]*:'), '{s.SP}+'), lambda x: x <> '')) AS word_at
  FROM (SELECT doc_id, l, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i,
               upper(regexp_extract(line, '^([^:]*):', 1)) AS section
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM notes)))
WHERE section IN (SELECT section FROM sections)""")
s.define("last_headers", ("header_marks", "split_examples"), """
SELECT e.doc_id, e.word_at, e.lf, coalesce(arg_max(m.header, m.word_at), '<pad>') AS header
FROM split_examples e LEFT JOIN header_marks m ON m.doc_id = e.doc_id AND m.word_at <= e.word_at GROUP BY e.doc_id, e.word_at, e.lf""")


@register("w06_last_header", s.with_("SELECT doc_id, word_at::BIGINT AS word_at, lf, header FROM last_headers", "last_headers"))
def last_header(spark, sf):
    from notelens.operators.windows import last_before

    examples, _ = _split(spark, sf)
    marks = mi.header_marks(fx.notes(spark, sf), fx.sections(spark, sf))
    probes = examples.select("doc_id", "at", "lf")
    return last_before(marks, probes, "doc_id", "at", "header", tx.PAD).select("doc_id", F.col("at").cast("bigint").alias("word_at"), "lf", "header")


s.define("finished", ("context_tokens", "last_headers", "split_examples"), f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY lf, tokenized_context ORDER BY doc_id, word_at) AS copy FROM (
    SELECT doc_id, word_at, lf, sf, lf_idx, is_train, category, array_to_string(tokens, ' ') AS tokenized_context,
           CASE WHEN l > 0 THEN tokens[l] ELSE header END AS section,
           coalesce(nullif(array_to_string(list_concat(tokens[greatest(t - {fx.WINDOW}, l + 1):t - 1],
             tokens[t + 1:least(t + {fx.WINDOW}, CASE WHEN r > 0 THEN r - 1 ELSE len(tokens) END)]), ' '), ''), '<pad>') AS trimmed_tokens
    FROM (SELECT *, coalesce(list_max(list_filter(hs, lambda h: h < t)), 0) AS l, coalesce(list_min(list_filter(hs, lambda h: h > t)), 0) AS r
      FROM (SELECT c.*, list_position(c.tokens, 'targetword') AS t,
              list_filter(range(1, len(c.tokens) + 1), lambda i: c.tokens[i] LIKE 'header=%') AS hs
            FROM context_tokens c WHERE len(list_filter(c.tokens, lambda x: x = 'targetword')) = 1))
    JOIN last_headers USING (doc_id, word_at, lf)
    JOIN (SELECT doc_id, word_at, lf, sf, lf_idx, is_train, category FROM split_examples) USING (doc_id, word_at, lf)))
WHERE copy = 1""")


def finished(spark, sf):
    numbered, tokens, senses, sections = _tokens(spark, sf)
    marks = mi.header_marks(fx.notes(spark, sf), sections)
    return mi.finish_examples(numbered, tokens, marks, senses, fx.WINDOW), senses


@register("r14_finished_examples", s.with_("""
SELECT doc_id, lf AS target_lf, sf, lf_idx::BIGINT AS target_lf_idx, is_train, section, trimmed_tokens, tokenized_context FROM finished""", "finished"))
def finished_examples(spark, sf):
    return finished(spark, sf)[0].select(
        "doc_id", "target_lf", "sf", F.col("target_lf_idx").cast("bigint").alias("target_lf_idx"), "is_train", "section",
        "trimmed_tokens", "tokenized_context",
    )


s.define("lf_counts", ("finished",), "SELECT lf, section AS metadata, count(*) AS n FROM finished GROUP BY ALL")


def _section_counts(spark, sf):
    examples, senses = finished(spark, sf)
    return stage(ma.marginals(examples, "target_lf", ["section"]).drop("kind"), "lf-counts"), senses


@register("m01_metadata_marginals", s.with_("""
SELECT kind, lf, metadata, n, round(n / sum(n) OVER (PARTITION BY kind, lf), 9) AS p FROM (
  SELECT 'section' AS kind, lf, section AS metadata, count(*) AS n FROM finished GROUP BY ALL
  UNION ALL SELECT 'category', lf, category, count(*) FROM finished GROUP BY ALL)""", "finished"))
def metadata_marginals(spark, sf):
    return ma.marginals(finished(spark, sf)[0], "target_lf", ["section", "category"]).withColumn("p", F.round("p", 9))


@register("m02_pruned_marginals", s.with_("""
SELECT lf, metadata, n, round(n / sum(n) OVER (PARTITION BY lf), 9) AS p
FROM (SELECT *, max(n) OVER (PARTITION BY lf) AS most FROM lf_counts) WHERE n > 1 OR most = 1""", "lf_counts"))
def pruned_marginals(spark, sf):
    return ma.prune_singletons(_section_counts(spark, sf)[0]).withColumn("p", F.round("p", 9))


@register("m03_test_marginals", s.with_("""
SELECT lf, metadata, n, round(n / sum(n) OVER (PARTITION BY lf), 9) AS p FROM (
  SELECT lf, section AS metadata, count(*) AS n FROM finished WHERE NOT is_train GROUP BY ALL)""", "finished"))
def held_out_marginals(spark, sf):
    held_out = finished(spark, sf)[0].where(~F.col("is_train"))
    return ma.marginals(held_out, "target_lf", ["section"]).drop("kind").withColumn("p", F.round("p", 9))


s.define("parts", ("lf_counts",), f"""
SELECT lf, metadata, part, n, n / sum(n) OVER (PARTITION BY lf, part) AS p FROM (
  SELECT lf, metadata, unnest(['train', 'val']) AS part, unnest([train + 1, val + 1]) AS n FROM (
    SELECT lf, metadata, count(*) FILTER (rn <= cut) AS train, count(*) FILTER (rn > cut) AS val FROM (
      SELECT *, row_number() OVER (PARTITION BY lf ORDER BY {s.u('lf', 'metadata', 'unit', seed=0)}, metadata, unit) AS rn,
             floor(count(*) OVER (PARTITION BY lf) * 0.75) AS cut
      FROM (SELECT lf, metadata, unnest(range(1, n + 1)) AS unit FROM lf_counts)) GROUP BY lf, metadata))""")


@register("m04_split_marginals", s.with_("SELECT lf, metadata, part, n, round(p, 9) AS p FROM parts", "parts"))
def split_marginals(spark, sf):
    return ma.split_marginals(_section_counts(spark, sf)[0]).withColumn("p", F.round("p", 9))


@register("m04_drawn_margins", s.with_("""
SELECT lf, metadata, sum(n)::BIGINT - 2 AS n, sum(sum(n) FILTER (part = 'train')) OVER (PARTITION BY lf)::BIGINT AS n_train,
       sum(sum(n) FILTER (part = 'val')) OVER (PARTITION BY lf)::BIGINT AS n_val FROM parts GROUP BY lf, metadata""", "parts"))
def drawn_margins(spark, sf):
    """What does not depend on the draw: each cell's total, and the sizes of both parts of a sense."""
    parts = ma.draw_split(_section_counts(spark, sf)[0])
    of = lambda part: F.sum(F.when(F.col("part") == part, F.col("n")).otherwise(0))
    cells = parts.groupBy("lf", "metadata").agg((F.sum("n") - 2).alias("n"), of("train").alias("train"), of("val").alias("val"))
    cells = stage(cells, "drawn-cells")
    sums = cells.groupBy("lf").agg(F.sum("train").alias("n_train"), F.sum("val").alias("n_val"))
    return cells.select("lf", "metadata", "n").join(sized(sums), "lf")


@register("m05_sense_breakdown", s.with_("""
SELECT sf, coalesce(lf, '') AS target_lf, coalesce(section, '') AS section, count(*) AS n
FROM finished GROUP BY GROUPING SETS ((sf, lf, section), (sf, lf), (sf))""", "finished"))
def sense_breakdown(spark, sf):
    return ma.sense_breakdown(finished(spark, sf)[0]).select(
        "sf", F.coalesce("target_lf", F.lit("")).alias("target_lf"), F.coalesce("section", F.lit("")).alias("section"), "n"
    )


s.define("outcome", ("parts", "senses"), """
SELECT v.sf, v.lf_idx AS target, coalesce(b.best, d.best) AS pred, v.n FROM (
  SELECT s.sf, s.lf_idx, p.metadata, p.n FROM parts p JOIN senses s USING (lf) WHERE part = 'val') v
LEFT JOIN (SELECT sf, metadata, arg_max(lf_idx, (p, lf_idx)) AS best FROM parts JOIN senses s USING (lf) WHERE part = 'train' GROUP BY ALL) b
  ON b.sf = v.sf AND b.metadata = v.metadata
JOIN (SELECT sf, arg_max(lf_idx, (n, lf_idx)) AS best FROM (
        SELECT s.sf, s.lf_idx, coalesce(sum(p.n), 0) AS n FROM senses s LEFT JOIN parts p ON p.lf = s.lf AND p.part = 'train' GROUP BY ALL)
      GROUP BY sf) d ON d.sf = v.sf""")
s.define("baseline_classes", ("outcome",), """
SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM (
  SELECT sf, c, sum(t) AS support, sum(h) AS hits, CASE WHEN sum(q) > 0 THEN sum(h) / sum(q) ELSE 0 END AS pr,
         CASE WHEN sum(t) > 0 THEN sum(h) / sum(t) ELSE 0 END AS re FROM (
    SELECT sf, target AS c, n AS t, 0 AS q, CASE WHEN target = pred THEN n ELSE 0 END AS h FROM outcome
    UNION ALL SELECT sf, pred, 0, n, 0 FROM outcome) GROUP BY sf, c)""")


def baseline(spark, sf):
    counts, senses = _section_counts(spark, sf)
    parts = stage(ma.split_marginals(counts), "parts")
    train = parts.where("part = 'train'").drop("part")
    val = parts.where("part = 'val'").drop("part")
    return ma.dominant_metadata_baseline(train, val, senses)


@register("e11_dominant_section_baseline", s.with_("""
SELECT sf, round(sum(hits) / sum(support), 6) AS accuracy, round(avg(f1) FILTER (support > 0), 6) AS macro_f1,
       round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM baseline_classes GROUP BY sf""", "baseline_classes"))
def dominant_section_baseline(spark, sf):
    return baseline(spark, sf).select("sf", *[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])


@register("e11_baseline_means", s.with_("""
SELECT round(avg(accuracy), 6) AS accuracy, round(avg(macro_f1), 6) AS macro_f1, round(avg(weighted_f1), 6) AS weighted_f1, count(*) AS n_sf FROM (
  SELECT sf, sum(hits) / sum(support) AS accuracy, avg(f1) FILTER (support > 0) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1
  FROM baseline_classes GROUP BY sf)""", "baseline_classes"))
def baseline_means(spark, sf):
    means = ma.baseline_means(baseline(spark, sf))
    return means.select(*[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")], "n_sf")
