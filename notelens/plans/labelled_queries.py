"""Queries over files, labelled sentences and run metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from notelens.functions import text as tx
from notelens.operators import labelled as la
from notelens.operators import mining as mi
from notelens.operators import runs as ru
from notelens.operators import vocabulary as vo
from notelens.operators.scale import number_rows, sized, stage
from notelens.plans import fixtures as fx
from notelens.plans import mining_queries as mq
from notelens.plans import sql as s
from notelens.plans.registry import register, table
from notelens.session import stage_dir
from notelens.sources import files as fi


def _path(spark, name):
    return f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register("s01_note_scan", s.with_("SELECT doc_id, category, md5(text) AS digest FROM notes", "notes"))
def note_scan(spark, sf):
    path = _path(spark, "notes-csv")
    fi.write_notes_csv(fx.notes(spark, sf), path)
    return fi.read_notes_csv(spark, path).select("doc_id", "category", F.md5("text").alias("digest"))


s.define("assembled", ("corpus_lines",), f"""
SELECT doc_id, max(line_no) AS closing, string_agg(t, ' ' ORDER BY line_no) FILTER (t <> '') AS text FROM (
  SELECT *, sum(CASE WHEN t = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS island
  FROM (SELECT *, regexp_replace(line, '^{s.SP}+|{s.SP}+$', '', 'g') AS t FROM corpus_lines))
GROUP BY doc_id, coalesce(island, 0) HAVING count(*) FILTER (t <> '') > 0""")


@register("s03_assembled_documents", s.with_("SELECT doc_id, closing, text FROM assembled", "assembled"))
def assembled_documents(spark, sf):
    lines = stage(fx.corpus_lines(spark, sf), "lines")
    out = fi.assemble_documents(lines, "doc_id", "line_no")
    return out.withColumn("closing", F.col("closing").cast("bigint"))


s.define("file_lines", ("corpus_lines",), f"""
SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS n, regexp_replace(line, '^{s.SP}+|{s.SP}+$', '', 'g') AS t FROM corpus_lines""")


@register("s03_text_file_documents", s.with_("""
SELECT max(n) AS closing, string_agg(t, ' ' ORDER BY n) FILTER (t <> '') AS text FROM (
  SELECT *, coalesce(sum(CASE WHEN t = '' THEN 1 ELSE 0 END) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island
  FROM file_lines) GROUP BY island HAVING count(*) FILTER (t <> '') > 0""", "file_lines"))
def text_file_documents(spark, sf):
    path = _path(spark, "corpus-text")
    fi.write_lines(fx.corpus_lines(spark, sf), ["doc_id", "line_no"], path, files=spark.sparkContext.defaultParallelism)
    lines = fi.read_lines(spark, path, split_bytes=1 << 16).withColumn("file", F.lit("corpus"))
    return fi.assemble_documents(lines, "file", "line_no").select("closing", "text")


@register("s04_inventory_scan", s.with_("SELECT sf, lf_idx, lf FROM senses", "senses"))
def inventory_scan(spark, sf):
    path = _path(spark, "inventory-json")
    fi.write_inventory(fx.senses(spark, sf), path)
    return fi.read_inventory(spark, path).withColumn("lf_idx", F.col("lf_idx").cast("bigint"))


@register("s05_word_list_scan", f"SELECT DISTINCT w AS word FROM (SELECT unnest({s.words('text')}) AS w FROM benchmark)")
def word_list_scan(spark, sf):
    path = _path(spark, "words")
    words = table(spark, sf, "benchmark").select(F.explode(tx.tokenize(F.col("text"))).alias("w"))
    words.select(F.concat(F.lit(" "), "w", F.lit(" ")).alias("value")).write.text(path)
    return fi.read_words(spark, path)


@register("s06_part_union", s.with_("SELECT doc_id, lf, word_at::BIGINT AS word_at FROM contexts", "contexts"))
def part_union(spark, sf):
    contexts = mq._contexts(spark, sf)[0]
    path = _path(spark, "parts")
    for part in (0, 1):
        fi.write_table(contexts.where(F.col("doc_id") % 2 == part), f"{path}/batch={part}")
    return fi.read_parts(spark, path, contexts.schema).select("doc_id", "lf", F.col("at").cast("bigint").alias("word_at"))


@register("s07_row_sink", s.with_("SELECT section, count FROM sections", "sections"))
def row_sink(spark, sf):
    path = _path(spark, "sections-csv")
    fi.write_table(vo.section_frequency(fx.notes(spark, sf), fx.MIN_COUNT), path, "csv")
    return spark.read.schema("section STRING, count LONG").csv(path, header=True)


@register("s08_nested_sink", s.with_("SELECT lf, metadata, n FROM lf_counts", "lf_counts"))
def nested_sink(spark, sf):
    path = _path(spark, "marginals-json")
    fi.nested_marginals(mq._section_counts(spark, sf)[0]).write.parquet(path)
    back = spark.read.parquet(path).select("lf", F.from_json("json", "name array<string>, count array<long>, p array<double>").alias("j"))
    return back.select("lf", F.inline(F.arrays_zip(F.col("j.name").alias("metadata"), F.col("j.count").alias("n"))))


@register("s09_sentence_sink", s.with_("""
SELECT sentence, count(*) AS n FROM (
  SELECT string_agg(token, ' ' ORDER BY pos) AS sentence FROM (
    SELECT *, sum(CASE WHEN token = 'header=SENTENCE' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS sn FROM sentence_tokens)
  WHERE token NOT LIKE '%header=%' AND token NOT LIKE '%document=%' GROUP BY doc_id, sn HAVING count(*) > 1) GROUP BY sentence""", "sentence_tokens"))
def sentence_sink(spark, sf):
    path = _path(spark, "sentences")
    fi.write_sentences(vo.sentence_rows(fx.docs(spark, sf, sentences=True)), path)
    return spark.read.text(path).groupBy(F.col("value").alias("sentence")).agg(F.count(F.lit(1)).alias("n"))


@register("s11_row_sample", f"SELECT doc_id FROM documents ORDER BY {s.u('doc_id', seed=1992)}, doc_id LIMIT 100")
def row_sample(spark, sf):
    return fi.sample_rows(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 100)


_BAN = [*tx.LF_NOISE_WORDS, *fx.STOPS]


@register("t12_long_form_tokens", s.with_(f"""
SELECT lf, token, row_number() OVER (PARTITION BY lf ORDER BY n DESC, token) AS rank FROM (
  SELECT *, max(good::INT) OVER (PARTITION BY lf) AS any_good FROM (
    SELECT lf, token, count(*) AS n, NOT list_contains({s.str_list(_BAN)}, token) AND token IN (SELECT token FROM vocab) AS good FROM (
      SELECT lf, unnest(string_split(replace(lf, ';', ' '), ' ')) AS token FROM senses) GROUP BY lf, token))
WHERE good OR any_good = 0 QUALIFY rank <= 5""", "senses", "vocab"))
def long_form_tokens(spark, sf):
    out = vo.long_form_tokens(fx.senses(spark, sf), _BAN, fx.vocab(spark, sf))
    return out.withColumn("rank", F.col("rank").cast("bigint"))


s.define("labelled", ("contexts",), """
SELECT row_number() OVER (ORDER BY doc_id, word_at, lf) - 1 AS row_idx, sf, replace(context, 'TARGETWORD', sf) AS context,
       instr(context, 'TARGETWORD') - 1 AS start_idx,
       CASE WHEN word_at % 11 = 0 THEN 'MISTAKE' WHEN word_at % 7 = 0 THEN lower(sf) || ' ' || lf_match
            WHEN word_at % 3 = 0 THEN lf_match || ':' || lower(sf) ELSE lf_match END AS target_lf FROM contexts""")


def labelled(spark, sf):
    contexts, senses = mq._contexts(spark, sf)
    numbered = number_rows(contexts, ["doc_id", "at", "lf"], "row_idx").withColumnRenamed("lf", "_lf")
    rows = numbered.join(sized(senses.select("sf", F.col("lf").alias("_lf"))), "_lf")
    at, match = F.col("at"), F.col("lf_match")
    target = (
        F.when(at % 11 == 0, F.lit("MISTAKE")).when(at % 7 == 0, F.concat(F.lower("sf"), F.lit(" "), match))
        .when(at % 3 == 0, F.concat(match, F.lit(":"), F.lower("sf"))).otherwise(match)
    )
    return stage(rows.select(
        "row_idx", "sf", F.replace("context", F.lit(tx.TARGET), F.col("sf")).alias("context"),
        (F.instr("context", tx.TARGET) - 1).alias("start_idx"), target.alias("target_lf")), "labelled"), senses


@register("s02_labelled_scan", s.with_("SELECT sf, target_lf, start_idx::BIGINT AS start_idx, context FROM labelled WHERE target_lf <> 'MISTAKE'", "labelled"))
def labelled_scan(spark, sf):
    path = _path(spark, "labelled-pipe")
    rows = labelled(spark, sf)[0].select(
        "sf", F.when(F.col("target_lf") != "MISTAKE", F.col("target_lf")).alias("target_lf"), "start_idx", F.lit("").alias("section"), "context")
    fi.write_labelled(rows, path, "gzip")
    back = fi.read_labelled(spark, path)
    return back.select("sf", "target_lf", F.col("start_idx").cast("bigint").alias("start_idx"), "context")


s.define("self_free", ("labelled",), "SELECT * FROM labelled WHERE NOT list_contains(string_split(lower(target_lf), ' '), lower(sf))")
s.define("with_sense", ("self_free", "senses"), """
SELECT l.*, coalesce(e.lf, l.stripped) AS target_lf_sense FROM (
  SELECT *, regexp_replace(target_lf, ':[a-zA-Z]+$', '') AS stripped FROM self_free WHERE NOT contains(target_lf, 'MISTAKE')) l
LEFT JOIN (SELECT sf, unnest(string_split(lf, ';')) AS phrase, lf FROM senses) e ON e.sf = l.sf AND e.phrase = lower(l.stripped)""")
s.define("located", ("with_sense",), """
SELECT * FROM (
  SELECT *, len(regexp_extract_all(substr(context, 1, start_idx + len(sf) - 1), '\\b' || sf || '\\b')) AS ordinal FROM with_sense)
WHERE contains(substr(context, start_idx + len(sf) + 1, 2), ' ')""")
_EVAL_BAN = [*fx.STOPS, "digitparsed"]
s.define("placed", ("located",), f"""
SELECT * FROM (
  SELECT *, (list_filter(range(1, len(w) + 1), lambda i: w[i] = lower(sf)))[ordinal + 1] AS t FROM (
    SELECT *, {s.words(s.clean('context'), _EVAL_BAN)} AS w FROM located)) WHERE t IS NOT NULL""")
s.define("ready", ("placed",), """
SELECT * FROM (
  SELECT *, count(DISTINCT target_lf_sense) OVER (PARTITION BY sf) AS n_senses FROM (
    SELECT *, array_to_string(w, ' ') AS tokenized_context, array_to_string(w[greatest(t - 10, 1):t + 10], ' ') AS trimmed_tokens,
           row_number() OVER (PARTITION BY target_lf, array_to_string(w, ' ') ORDER BY row_idx) AS copy FROM placed) WHERE copy = 1)
WHERE n_senses > 1""")


@register("t15_canonical_senses", s.with_("SELECT row_idx, target_lf_sense FROM with_sense", "with_sense"))
def canonical_senses(spark, sf):
    rows, senses = labelled(spark, sf)
    return la.canonical_sense(la.without_self_named(rows), senses).select("row_idx", "target_lf_sense")


@register("t16_remapped_senses", s.with_("""
SELECT row_idx, CASE target_lf_sense WHEN 'the of' THEN 'of the' ELSE target_lf_sense END AS target_lf_sense FROM with_sense
WHERE sf NOT IN ('IT', 'OT') AND target_lf_sense NOT LIKE 'and the%'""", "with_sense"))
def remapped_senses(spark, sf):
    rows, senses = labelled(spark, sf)
    ready = la.canonical_sense(la.without_self_named(rows), senses)
    out = la.remap_senses(ready, {"the of": "of the"}, [], ["IT", "OT"])
    return out.where(~F.col("target_lf_sense").startswith("and the")).select("row_idx", "target_lf_sense")


@register("l01_inventory_relations", s.with_("""
SELECT sf, lf, row_number() OVER (PARTITION BY sf ORDER BY lf) - 1 AS lf_idx FROM senses""", "senses"))
def inventory_relations(spark, sf):
    rows = fx.senses(spark, sf).select(F.col("lf_idx").alias("row_idx"), "sf", "lf")
    return la.parse_inventory(rows.union(rows))[2].select("sf", "lf", F.col("lf_idx").cast("bigint").alias("lf_idx"))


@register("l02_self_named_rows", s.with_("SELECT row_idx FROM self_free", "self_free"))
def self_named_rows(spark, sf):
    return la.without_self_named(labelled(spark, sf)[0]).select("row_idx")


@register("w09_occurrence_ordinals", s.with_("SELECT row_idx, ordinal FROM located", "located"))
def occurrence_ordinals(spark, sf):
    rows, senses = labelled(spark, sf)
    found = la.locate(la.canonical_sense(la.without_self_named(rows), senses))
    return found.select("row_idx", F.col("ordinal").cast("bigint").alias("ordinal"))


@register("l03_valid_rows", s.with_("SELECT sf, count(*) AS n FROM located GROUP BY sf", "located"))
def valid_rows(spark, sf):
    rows, senses = labelled(spark, sf)
    return la.locate(la.canonical_sense(la.without_self_named(rows), senses)).groupBy("sf").agg(F.count(F.lit(1)).alias("n"))


@register("l04_first_of_each", s.with_("SELECT min(row_idx) AS row_idx, target_lf, context FROM labelled GROUP BY target_lf, context", "labelled"))
def first_of_each(spark, sf):
    return la.first_of_each(labelled(spark, sf)[0].select("row_idx", "target_lf", "context"), ["target_lf", "context"], "row_idx")


@register("l05_ambiguous_short_forms", s.with_("""
SELECT row_idx, sf FROM with_sense WHERE sf IN (SELECT sf FROM with_sense GROUP BY sf HAVING count(DISTINCT target_lf_sense) > 1)""", "with_sense"))
def ambiguous_short_forms(spark, sf):
    rows, senses = labelled(spark, sf)
    return la.with_several_senses(la.canonical_sense(la.without_self_named(rows), senses)).select("row_idx", "sf")


@register("l06_sense_ordinals", s.with_("""
SELECT row_idx, dense_rank() OVER (PARTITION BY sf ORDER BY target_lf_sense) - 1 AS target_lf_idx FROM with_sense""", "with_sense"))
def sense_ordinals(spark, sf):
    rows, senses = labelled(spark, sf)
    out = la.number_senses(la.canonical_sense(la.without_self_named(rows), senses))
    return out.select("row_idx", F.col("target_lf_idx").cast("bigint").alias("target_lf_idx"))


_SECTION = "CASE WHEN doc_id % 5 = 0 THEN '' ELSE lower(section) || ' :' END"


@register("l07_mapped_sections", s.with_(f"""
SELECT doc_id, section, n, CASE WHEN section = '' THEN '<pad>' WHEN upper(rtrim(section, ' :')) IN (SELECT section FROM sections)
   THEN {s.pseudo('header=', 'section')} WHEN section LIKE 'visit%' THEN 'header=VISIT' ELSE '<pad>' END AS section_mapped
FROM (SELECT doc_id, {_SECTION} AS section, count(*) AS n FROM all_headers GROUP BY ALL)""", "all_headers", "sections"))
def mapped_sections(spark, sf):
    sections = fx.sections(spark, sf)
    heads = stage(fx.notes(spark, sf).select("doc_id", F.explode(tx.section_headers(F.col("text"))).alias("section")), "headers")
    rest = heads.select("section").distinct().join(sections, "section", "left_anti")
    mapping = stage(rest.select(F.col("section").alias("source"), F.when(F.col("section").startswith("VISIT"), F.lit("visit")).alias("target")), "map")
    rows = heads.groupBy("doc_id", F.expr(_SECTION).alias("section")).agg(F.count(F.lit(1)).alias("n"))
    return la.map_sections(rows, sections, mapping)


@register("l08_mapped_or_kept_sections", s.with_("""
SELECT doc_id, section, CASE WHEN doc_id % 5 = 0 THEN '<pad>' WHEN section = 'HISTORY' THEN 'PAST' ELSE section END AS section_mapped
FROM (SELECT DISTINCT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE section END AS section FROM all_headers)""", "all_headers"))
def mapped_or_kept_sections(spark, sf):
    heads = fx.notes(spark, sf).select("doc_id", F.explode(tx.section_headers(F.col("text"))).alias("section"))
    rows = heads.withColumn("section", F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.col("section"))).distinct()
    mapping = stage(heads.select("section").distinct().where("section = 'HISTORY'").select(F.col("section").alias("source"), F.lit("PAST").alias("target")), "map")
    return la.map_sections_or_keep(rows, mapping)


@register("l09_shared_short_forms", s.with_("""
SELECT sf, count(*) AS n FROM labelled WHERE sf IN (SELECT sf FROM viable) GROUP BY sf""", "labelled", "viable"))
def shared_short_forms(spark, sf):
    rows, senses = labelled(spark, sf)
    viable = mi.viable_senses(mi.attach_counts(senses, mq._contexts(spark, sf)[0]))
    return la.restrict_to_short_forms(rows, viable).groupBy("sf").agg(F.count(F.lit(1)).alias("n"))


@register("l10_share_split", f"SELECT doc_id, {s.u('doc_id', seed=0)} < 0.8 AS is_train FROM documents")
def share_split(spark, sf):
    train, test = la.split_by_share(table(spark, sf, "documents").select("doc_id"), ["doc_id"], 0.8)
    return train.withColumn("is_train", F.lit(True)).unionByName(test.withColumn("is_train", F.lit(False)))


@register("l11_prepared_labelled_set", s.with_("""
SELECT row_number() OVER (ORDER BY row_idx) - 1 AS row_idx, sf, target_lf, target_lf_sense,
       dense_rank() OVER (PARTITION BY sf ORDER BY target_lf_sense) - 1 AS target_lf_idx, trimmed_tokens, tokenized_context FROM ready""", "ready"))
def prepared_labelled_set(spark, sf):
    rows, senses = labelled(spark, sf)
    out = la.prepare_labelled(rows, senses, 10, fx.STOPS)
    return out.select("row_idx", "sf", "target_lf", "target_lf_sense", F.col("target_lf_idx").cast("bigint").alias("target_lf_idx"),
                      "trimmed_tokens", "tokenized_context")


s.define("metrics", (), """
SELECT 'run' || (user_id % 3) AS experiment, event_type AS dataset, (day(ts) * 1000)::BIGINT AS examples, round(avg(value), 6) AS lm_kl,
       round(max(value), 6) AS lm_recon, round(avg(value * value) / 1000, 6) AS log_loss, round(1 / (1 + avg(value)), 6) AS accuracy,
       round(min(value) / (1 + max(value)), 6) AS macro_f1, round(1 / (1 + count(*)), 6) AS weighted_f1
FROM events GROUP BY user_id % 3, event_type, day(ts)""")


def metrics(spark, sf):
    v = F.col("value")
    grouped = table(spark, sf, "events").groupBy(
        F.concat(F.lit("run"), (F.col("user_id") % 3)).alias("experiment"), F.col("event_type").alias("dataset"),
        (F.dayofmonth("ts") * 1000).cast("bigint").alias("examples"))
    r = lambda c, n: F.round(c, 6).alias(n)
    return grouped.agg(
        r(F.avg(v), "lm_kl"), r(F.max(v), "lm_recon"), r(F.avg(v * v) / 1000, "log_loss"), r(1 / (1 + F.avg(v)), "accuracy"),
        r(F.min(v) / (1 + F.max(v)), "macro_f1"), r(1 / (1 + F.count(F.lit(1))), "weighted_f1"))


s.define("best", ("metrics",), """
SELECT experiment, dataset, examples, log_loss, accuracy, weighted_f1, macro_f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY experiment, dataset ORDER BY examples) AS rn FROM (
    SELECT *, rank() OVER (PARTITION BY experiment ORDER BY lm_kl + lm_recon) AS r FROM metrics) WHERE r = 1) WHERE rn = 1""")


@register("k01_best_step", s.with_("SELECT * FROM best", "best"))
def best_step(spark, sf):
    return ru.best_step(metrics(spark, sf))


@register("k02_spread_of_models", s.with_("""
SELECT dataset, stat, round(arg_max(v, (log_loss, experiment)), 8) AS worst, round(avg(v), 8) AS mean, round(arg_min(v, (log_loss, experiment)), 8) AS best FROM (
  SELECT *, unnest(['log_loss', 'accuracy', 'weighted_f1', 'macro_f1']) AS stat, unnest([log_loss, accuracy, weighted_f1, macro_f1]) AS v
  FROM best) GROUP BY dataset, stat""", "best"))
def spread_of_models(spark, sf):
    out = ru.spread_of_models(ru.best_step(metrics(spark, sf)))
    return out.select("dataset", "stat", *[F.round(c, 8).alias(c) for c in ("worst", "mean", "best")])


@register("k03_cross_selected", s.with_("""
SELECT m.* FROM metrics m JOIN (
  SELECT experiment, CASE dataset WHEN 'click' THEN 'view' ELSE 'click' END AS dataset, arg_min(examples, (log_loss, examples)) AS examples
  FROM metrics WHERE dataset IN ('click', 'view') GROUP BY ALL) c USING (experiment, dataset, examples)""", "metrics"))
def cross_selected(spark, sf):
    rows = stage(metrics(spark, sf), "metrics")
    return ru.cross_selected(rows, "click", "view").select(*rows.columns)


@register("k04_progress", "SELECT event_id, ((1 + event_id % 5 - 1) * 40 + event_id % 40 + 1) * 1024 AS examples FROM events")
def progress(spark, sf):
    seen = ru.examples_seen(1 + F.col("event_id") % 5, F.col("event_id") % 40, 40, 1024)
    return table(spark, sf, "events").select("event_id", seen.alias("examples"))


@register("k05_running_mean", """
SELECT event_id, round(avg(value) OVER (PARTITION BY event_type, day(ts) ORDER BY event_id ROWS UNBOUNDED PRECEDING), 9) AS mean_loss FROM events""")
def running_mean(spark, sf):
    losses = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("experiment"), F.dayofmonth("ts").alias("epoch"), F.col("event_id").alias("step"), F.col("value").alias("loss"))
    return ru.running_mean(losses).select("event_id", F.round("mean_loss", 9).alias("mean_loss"))


@register("s10_split_by_key", s.with_("SELECT dataset, accuracy, macro_f1, weighted_f1 FROM metrics", "metrics"))
def split_by_key(spark, sf):
    path = _path(spark, "by-dataset")
    fi.write_by_key(metrics(spark, sf), "dataset", ["accuracy", "macro_f1", "weighted_f1"], path)
    return spark.read.parquet(path)


# Line ends that split the text of a document.
BREAKS = r"[\n\r\x0b\f\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
s.define("line_texts", ("corpus_lines",), f"""
SELECT doc_id, text, list_filter(regexp_split_to_array(text, '{s.SP}+'), lambda x: x <> '') AS w,
       list_transform(regexp_split_to_array(text, '{BREAKS}'), lambda l: len(list_filter(regexp_split_to_array(l, '{s.SP}+'), lambda x: x <> ''))) AS sizes
FROM (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM corpus_lines GROUP BY doc_id)""")
s.define("line_words", ("line_texts",), """
SELECT doc_id, w, list_transform(w, lambda x: lower(x)) AS lw,
       [{'s': list_sum(sizes[1:i - 1])::BIGINT, 'e': list_sum(sizes[1:i])::BIGINT} FOR i IN range(1, len(sizes) + 1)] AS ends FROM line_texts""")
s.define("line_raw_hits", ("line_words", "entries"), s.CTE["raw_hits"][1].replace("note_words", "line_words"))
s.define("line_hits", ("line_raw_hits",), s.CTE["hits"][1].replace("raw_hits", "line_raw_hits"))
_W = f"[{tx.WORD_CHARS}]+"
s.define("sides", ("line_hits", "line_words"), f"""
SELECT h.doc_id, h.lf, h.word_at AS b, h.word_at + 2 AS f, w, list_transform(ends, lambda x: {{'s': coalesce(x.s, 0), 'e': coalesce(x.e, 0)}}) AS ln,
       regexp_replace(w[word_at + 1], '{_W}$', '') AS lp, regexp_replace(w[word_at + 2], '^{_W}', '') AS rp,
       len(regexp_extract_all(w[word_at + 1], '{_W}|[^{tx.WORD_CHARS}]+')) - 1 AS first,
       coalesce(lag(word_at) OVER (PARTITION BY h.doc_id, h.lf ORDER BY word_at) + 2 = word_at AND regexp_full_match(w[word_at], '{_W}')
                AND regexp_full_match(w[word_at + 1], '{_W}'), false) AS taken
FROM line_hits h JOIN line_words USING (doc_id)""")
s.define("side_lines", ("sides",), """
SELECT *, [array_to_string(w[x.s + 1:least(x.e, b)], ' ') FOR x IN ln IF x.s < b] AS l0,
       [array_to_string(w[greatest(x.s, f) + 1:x.e], ' ') FOR x IN ln IF (x.e > x.s AND x.e > f) OR (x.e = x.s AND x.s > f)] AS r0,
       len([1 FOR x IN ln IF x.s = b]) AS at_left, len([1 FOR x IN ln IF x.s = f]) + CASE WHEN ln[-1].e = f THEN 1 ELSE 0 END AS at_right,
       [x FOR x IN [lp] IF x <> ''] AS lps, [x FOR x IN [rp] IF x <> ''] AS rps FROM sides""")
s.define("side_texts", ("side_lines",), """
SELECT doc_id, lf, b, first,
       CASE WHEN taken AND at_left > 0 THEN list_concat(l0, list_transform(range(at_left), lambda x: ''))
            WHEN lp = '' THEN l0
            WHEN at_left > 0 OR len(l0) = 0 THEN list_concat(l0, list_transform(range(greatest(at_left - 1, 0)), lambda x: ''), lps)
            ELSE list_concat(l0[:len(l0) - 1], [array_to_string([x FOR x IN [l0[-1], lp] IF x <> ''], ' ')]) END AS l1,
       CASE WHEN rp = '' THEN r0
            WHEN at_right > 0 OR len(r0) = 0 THEN list_concat(rps, list_transform(range(greatest(at_right - 1, 0)), lambda x: ''), r0)
            ELSE list_concat([array_to_string([x FOR x IN [rp, r0[1]] IF x <> ''], ' ')], r0[2:]) END AS r1
FROM side_lines""")
_LONE = "len({0}) = 1 AND NOT regexp_matches({0}, '^[\\p{{L}}\\p{{N}}]$')"


def _cut(side, test, tail):
    """Drop the first or last of a list if it passes a test; null (an empty list's) never does."""
    end = f"{side}[{'-1' if tail else '1'}]"
    rest = f"{side}[:len({side}) - 1]" if tail else f"{side}[2:]"
    return f"CASE WHEN len({side}) > 0 AND {test.format(end)} THEN {rest} ELSE {side} END AS {side}"


_from = "side_texts"
for _tail, _test in ((False, _LONE), (False, "{0} = ''"), (True, _LONE), (True, "{0} = ''")):
    _from = f"(SELECT doc_id, lf, b, first, {_cut('l1', _test, _tail)}, {_cut('r1', _test, _tail)} FROM {_from})"


@register("r05_paragraph_contexts", s.with_(f"""
SELECT doc_id, lf, b AS at, first::BIGINT AS first, array_to_string(list_concat(
         CASE WHEN list_contains(l1, '') THEN l1[len(l1) - list_position(list_reverse(l1), '') + 2:] ELSE l1 END, ['{tx.TARGET}'],
         CASE WHEN list_contains(r1, '') THEN r1[:list_position(r1, '') - 1] ELSE r1 END), ' ') AS context
FROM {_from}""", "side_texts"))
def paragraph_contexts(spark, sf):
    lines = stage(fx.corpus_lines(spark, sf), "lines")
    texts = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l")).select(
        "doc_id", F.array_join("l.line", "\n").alias("text"))
    texts = stage(texts, "texts")
    entries = stage(mi.long_form_entries(fx.senses(spark, sf)), "entries")
    found = mi.paragraph_contexts(texts, mi.choose(mi.scan(texts, entries)))
    return found.select("doc_id", "lf", F.col("at").cast("bigint").alias("at"), F.col("first").cast("bigint").alias("first"), "context")


