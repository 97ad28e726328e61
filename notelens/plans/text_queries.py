"""Queries over text expressions, section lists and tokenized notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelens.functions import text as tx
from notelens.operators import vocabulary as vo
from notelens.operators.scale import lookup_join, sized, stage
from notelens.plans import fixtures as fx
from notelens.plans import sql as s
from notelens.plans.registry import documents, register, table


@register("t01_section_headers", s.with_(
    "SELECT doc_id, section, count(*) AS n FROM all_headers GROUP BY ALL", "all_headers"))
def section_headers(spark, sf):
    return (
        fx.notes(spark, sf)
        .select("doc_id", F.explode(tx.section_headers(F.col("text"))).alias("section"))
        .groupBy("doc_id", "section")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@register("t02_split_keeping", s.with_(f"""
SELECT doc_id, len(p)::BIGINT AS pieces, array_to_string(p, '|') AS joined FROM (
  SELECT doc_id, string_split(regexp_replace(text, '{s.HEADER}', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS p
  FROM notes)""", "notes"))
def split_keeping(spark, sf):
    pieces = tx.split_keeping(F.col("text"), tx.HEADER)
    return fx.notes(spark, sf).select(
        "doc_id", F.size(pieces).cast("bigint").alias("pieces"), F.array_join(pieces, "|").alias("joined")
    )


@register("t03_clean_text", f"SELECT doc_id, {s.clean('text')} AS cleaned FROM documents")
def clean_text(spark, sf):
    return documents(spark, sf).select("doc_id", tx.clean(F.col("text")).alias("cleaned"))


@register("t04_unwrap_deid", f"""
SELECT doc_id, regexp_replace(regexp_replace(text, '([A-Za-z]+)', '_%#\\1#%_', 'g'), '_%#([^{tx.SPACE_SET}]+)#%_', '\\1', 'g')
  AS unwrapped FROM documents""")
def unwrap_deid(spark, sf):
    wrapped = F.regexp_replace("text", "([A-Za-z]+)", "_%#$1#%_")
    return documents(spark, sf).select("doc_id", tx.unwrap_deid(wrapped).alias("unwrapped"))


@register("t05_word_tokens", f"""
SELECT doc_id, len(w)::BIGINT AS n, array_to_string(w, ' ') AS tokens
FROM (SELECT doc_id, {s.words('text', fx.STOPS)} AS w FROM documents)""")
def word_tokens(spark, sf):
    tokens = tx.tokenize(F.col("text"), fx.STOPS)
    return documents(spark, sf).select(
        "doc_id", F.size(tokens).cast("bigint").alias("n"), F.array_join(tokens, " ").alias("tokens")
    )


_MARKS = s.str_list([*tx.PUNCTUATION, *tx.EXTRA_STOPS])
_FREQUENT = f"""
SELECT w AS word, count(*) AS n FROM (SELECT unnest({s.words('text')}) AS w FROM documents) GROUP BY w"""


@register("t06_stop_words", f"""
WITH f AS ({_FREQUENT})
SELECT word FROM (
  (SELECT word FROM f WHERE n >= 50 UNION SELECT unnest({_MARKS}))
  EXCEPT SELECT unnest({s.str_list(tx.MATH_SYMBOLS)})) EXCEPT SELECT unnest({s.str_list(tx.PREPOSITIONS)})""")
def stop_words(spark, sf):
    frequent = (
        documents(spark, sf).select(F.explode(tx.tokenize(F.col("text"))).alias("word"))
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 50)
    )
    kept = spark.range(1).select(F.explode(tx.words_array(tx.PREPOSITIONS)).alias("word"))
    return vo.stop_words(frequent, kept)


@register("t07_pseudo_tokens", s.with_(f"""
SELECT DISTINCT n.category, a.section, {s.pseudo('document=', 'n.category')} AS document_token,
       {s.pseudo('header=', 'a.section')} AS section_token
FROM notes n JOIN all_headers a USING (doc_id)""", "all_headers"))
def pseudo_tokens(spark, sf):
    rows = fx.notes(spark, sf).select(
        "category", F.explode(tx.section_headers(F.col("text"))).alias("section")
    ).distinct()
    return rows.select(
        "category", "section", tx.document_token(F.col("category")).alias("document_token"),
        tx.section_token(F.col("section")).alias("section_token"),
    )


_DOC_ROWS = """SELECT doc_id, count(*) AS n, string_agg(token, ' ' ORDER BY pos) AS tokens FROM {} GROUP BY doc_id"""


def _joined(docs):
    return docs.select("doc_id", F.size("tokens").cast("bigint").alias("n"), F.array_join("tokens", " ").alias("tokens"))


@register("t08_sectioned_notes", s.with_(_DOC_ROWS.format("raw_tokens"), "raw_tokens"))
def sectioned_notes(spark, sf):
    return _joined(fx.docs(spark, sf))


s.define("sentence_pieces", ("pieces",), f"""
SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY k) - 1 AS sn, count(*) OVER (PARTITION BY doc_id, i) AS ns
FROM (SELECT doc_id, i, unnest(p) AS sentence, unnest(range(len(p))) AS k
      FROM (SELECT doc_id, i, string_split(
              regexp_replace(body, '\\.{s.SP}|\\n{{2,}}|^{s.SP}{{0,}}\\p{{Nd}}{{1,2}}{s.SP}{{0,}}[-).]{s.SP}{{1,}}', chr(1), 'g'),
              chr(1)) AS p FROM pieces WHERE NOT is_header))
WHERE sentence <> ''""")
s.define("sentence_tokens", ("sentence_pieces", "pieces", "sections"), f"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, sn, j) - 1 AS pos, token FROM (
  SELECT doc_id, -1 AS i, 0 AS sn, 0 AS j, {s.pseudo('document=', 'category')} AS token FROM notes
  UNION ALL
  SELECT doc_id, i, 0, unnest(range(len(t))), unnest(t) FROM (
    SELECT p.doc_id, p.i, CASE WHEN s.section IS NOT NULL THEN [{s.pseudo('header=', 's.section')}]
                               ELSE {s.words(s.clean('p.body'), fx.STOPS)} END AS t
    FROM pieces p LEFT JOIN sections s ON s.section = trim(upper(p.body), ': ')
    WHERE p.is_header AND NOT p.is_empty)
  UNION ALL
  SELECT doc_id, i, sn, -1, 'header=SENTENCE' FROM sentence_pieces WHERE sn > 0 AND sn < ns - 1
  UNION ALL
  SELECT doc_id, i, sn, unnest(range(len(t))), unnest(t) FROM (
    SELECT doc_id, i, sn, {s.words(s.clean('sentence'), fx.STOPS)} AS t FROM sentence_pieces))""")


@register("t09_sentence_tagged_notes", s.with_(_DOC_ROWS.format("sentence_tokens"), "sentence_tokens"))
def sentence_tagged_notes(spark, sf):
    return _joined(fx.docs(spark, sf, sentences=True))


@register("t10_sentence_rows", s.with_("""
SELECT doc_id, string_agg(token, ' ' ORDER BY pos) AS sentence FROM (
  SELECT *, sum(CASE WHEN token = 'header=SENTENCE' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS sn
  FROM sentence_tokens)
WHERE token NOT LIKE '%header=%' AND token NOT LIKE '%document=%'
GROUP BY doc_id, sn HAVING count(*) > 1""", "sentence_tokens"))
def sentence_rows(spark, sf):
    return vo.sentence_rows(fx.docs(spark, sf, sentences=True)).select("doc_id", "sentence")


_NOISY = "upper(sf) || ' - ' || replace(lf, ';', ' procedure;') || ' (geographic location);' || sf || ';' || lf"


@register("t11_clean_long_forms", s.with_(f"""
SELECT sf, lf_idx::BIGINT AS lf_idx, array_to_string(list_sort(list_distinct(list_filter(
  list_transform(string_split(lower({_NOISY}), ';'),
    lambda x: replace(regexp_replace(x, '{s.SP}+[(]?({'|'.join(tx.LF_NOISE_PHRASES)})[)]?', '', 'g'), lower(sf) || ' - ', '')),
  lambda x: x <> lower(sf)))), ';') AS lf FROM senses""", "senses"))
def clean_long_forms(spark, sf):
    noisy = F.expr("concat(upper(sf), ' - ', replace(lf, ';', ' procedure;'), ' (geographic location);', sf, ';', lf)")
    return fx.senses(spark, sf).select(
        "sf", F.col("lf_idx").cast("bigint").alias("lf_idx"), tx.clean_long_form(noisy, F.col("sf")).alias("lf")
    )


_EVAL_BAN = [*fx.STOPS, "que", "at"]


@register("t13_eval_tokens", f"""
SELECT doc_id, len(w)::BIGINT AS n, array_to_string(w, ' ') AS tokens, len(list_distinct(w))::BIGINT AS n_unique
FROM (SELECT doc_id, {s.words(s.clean(f"regexp_replace(text, '_%#([^{tx.SPACE_SET}]+)#%_', '{chr(92)}1', 'g')"),
                              [*_EVAL_BAN, 'digitparsed'])} AS w FROM documents)""")
def eval_tokens(spark, sf):
    tokens = tx.eval_tokenize(F.col("text"), _EVAL_BAN)
    unique = tx.eval_tokenize(F.col("text"), _EVAL_BAN, unique_only=True)
    return documents(spark, sf).select(
        "doc_id", F.size(tokens).cast("bigint").alias("n"), F.array_join(tokens, " ").alias("tokens"),
        F.size(unique).cast("bigint").alias("n_unique"),
    )


@register("t14_adjacent_duplicates", f"""
SELECT doc_id, array_to_string(list_filter(w, lambda t, i: i = 1 OR t <> w[i - 1]), ' ') AS letters
FROM (SELECT doc_id, list_transform({s.words('text')}, lambda t: substr(t, 1, 1)) AS w FROM documents)""")
def adjacent_duplicates(spark, sf):
    letters = documents(spark, sf).select(
        "doc_id", F.transform(tx.tokenize(F.col("text")), lambda t: F.substring(t, 1, 1)).alias("letters")
    )
    return letters.select("doc_id", F.array_join(tx.drop_adjacent_duplicates(F.col("letters")), " ").alias("letters"))


_SPECIAL = ["[UNK]", "[PAD]", "[MASK]", "[CLS]", "[SEP]"]
_ENTRY = "CASE WHEN item % 9 = 0 THEN ' [CLS] ' ELSE ' ' || word || chr(9) END"


@register("t17_standard_entries", f"""
SELECT doc_id, count(*) AS n, count(DISTINCT entry) AS n_distinct, max(entry) AS last_entry FROM (
  SELECT doc_id, CASE WHEN trim(e, ' ' || chr(9)) IN ('[UNK]', '[PAD]', '[MASK]', '[CLS]', '[SEP]')
                      THEN trim(e, ' ' || chr(9)) ELSE lower(trim(e, ' ' || chr(9))) END AS entry
  FROM (SELECT doc_id, {_ENTRY} AS e FROM (
    SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS item
    FROM (SELECT doc_id, regexp_split_to_array(text, '{s.SP}+') AS w FROM documents))))
GROUP BY doc_id""")
def standard_entries(spark, sf):
    entries = documents(spark, sf).select(
        "doc_id", F.posexplode(F.split("text", tx.SPACES)).alias("item", "word")
    ).select("doc_id", F.expr("CASE WHEN item % 9 = 0 THEN ' [CLS] ' ELSE concat(' ', word, char(9)) END").alias("e"))
    standard = entries.select("doc_id", tx.standardize_entry(F.col("e"), _SPECIAL).alias("entry"))
    return standard.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("entry").alias("n_distinct"), F.max("entry").alias("last_entry")
    )


@register("v01_section_frequency", s.with_("SELECT section, count FROM sections", "sections"))
def section_frequency(spark, sf):
    return vo.section_frequency(fx.notes(spark, sf), fx.MIN_COUNT)


@register("v02_token_counts", s.with_("""
SELECT coalesce(token, '') AS token, count(*) FILTER (WHERE token IS NOT NULL) AS count FROM raw_tokens GROUP BY token
UNION ALL SELECT '', count(*) FROM raw_tokens WHERE kind = 'token'""", "raw_tokens"))
def token_counts(spark, sf):
    counted = vo.counts_with_total(fx.raw_tokens(spark, sf))
    return counted.select(F.coalesce("token", F.lit("")).alias("token"), "count")


@register("v03_frequent_tokens", s.with_(f"""
SELECT doc_id, count(*) AS n, sum(pos)::BIGINT AS positions FROM raw_tokens JOIN token_counts USING (token, kind)
WHERE kind = 'token' AND count >= {fx.MIN_COUNT} GROUP BY doc_id""", "raw_tokens", "token_counts"))
def frequent_tokens(spark, sf):
    raw = stage(fx.raw_tokens(spark, sf), "tokens").where("kind = 'token'")
    counts = stage(vo.token_counts(raw), "token-counts").where(F.col("count") >= fx.MIN_COUNT)
    kept = lookup_join(raw, counts.select("token", F.col("count").alias("seen")), "token", weight="seen")
    return kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("positions"))


@register("v04_subsampled_words", s.with_(f"""
SELECT token, count(*) AS n, sum(pos)::BIGINT AS positions, round(min(keep_p), 6) AS keep_p FROM (
  SELECT r.*, least((sqrt(c.count / total / {fx.THRESHOLD}) + 1) * ({fx.THRESHOLD} / (c.count / total)), 1.0) AS keep_p
  FROM raw_tokens r JOIN token_counts c ON c.token = r.token AND r.kind = 'token' CROSS JOIN corpus_size
  WHERE c.count >= {fx.MIN_COUNT})
WHERE {s.u('doc_id', 'pos', seed=0)} < keep_p GROUP BY token""", "raw_tokens", "token_counts", "corpus_size"))
def subsampled_words(spark, sf):
    raw = stage(fx.raw_tokens(spark, sf), "tokens")
    counts = stage(vo.token_counts(raw), "token-counts")
    kept = vo.kept_words(raw, counts, fx.MIN_COUNT, fx.THRESHOLD).where("kind = 'token'")
    return kept.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.sum("pos").alias("positions"), F.round(F.min("keep_p"), 6).alias("keep_p")
    )


@register("v05_clean_stream", s.with_(_DOC_ROWS.format("clean_tokens"), "clean_tokens"))
def clean_stream(spark, sf):
    by_doc = fx.clean_tokens(spark, sf).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t")
    )
    return by_doc.select("doc_id", "n", F.array_join("t.token", " ").alias("tokens"))


@register("v06_vocabulary", s.with_("SELECT id, token, support, kind FROM vocab", "vocab"))
def vocabulary(spark, sf):
    return vo.build_vocabulary(fx.clean_tokens(spark, sf))


@register("v07_token_lookup", s.with_("""
SELECT r.token, coalesce(v.id, -1) AS id, coalesce(v.support, 0) AS support, count(*) AS n
FROM raw_tokens r LEFT JOIN vocab v ON v.token = r.token GROUP BY ALL""", "raw_tokens", "vocab"))
def token_lookup(spark, sf):
    raw = stage(fx.raw_tokens(spark, sf), "tokens")
    counts = stage(vo.token_counts(raw), "token-counts")
    vocab = fx.vocab(spark, sf, stage(vo.subsample(raw, counts, fx.MIN_COUNT, fx.THRESHOLD), "clean"))
    found = vo.token_ids(counts.select("token", F.col("count").alias("n")), vocab)
    supports = sized(vocab.select("id", "support"))
    return found.join(supports, "id", "left").select(
        "token", "id", F.coalesce("support", F.lit(0).cast("bigint")).alias("support"), "n"
    )


@register("v08_id_stream", s.with_("SELECT doc_id, pos, gpos, id FROM ids", "ids"))
def id_stream(spark, sf):
    return fx.ids(spark, sf).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "gpos", "id")


s.define("negative_p", ("vocab",), """
SELECT id, CASE WHEN kind = 'pad' THEN 0.0::DOUBLE ELSE pow(support, 0.75) END
           / sum(CASE WHEN kind = 'pad' THEN 0.0::DOUBLE ELSE pow(support, 0.75) END) OVER () AS p FROM vocab""")
s.define("slices", ("negative_p",), """
SELECT id, hi - p AS lo, CASE WHEN id = max(id) OVER () THEN 2.0::DOUBLE ELSE hi END AS hi
FROM (SELECT id, p, sum(p) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS hi FROM negative_p WHERE p > 0)""")


@register("v09_negative_distribution", s.with_("SELECT id, round(p, 9) AS p FROM negative_p", "negative_p"))
def negative_distribution(spark, sf):
    return vo.sampling_distribution(fx.vocab(spark, sf)).select("id", F.round("p", 9).alias("p"))


@register("v10_weighted_draws", s.with_(f"""
SELECT draw_id, id FROM (SELECT event_id AS draw_id, {s.u('event_id', seed=3)} AS u FROM events) d
JOIN slices c ON d.u >= c.lo AND d.u < c.hi""", "slices"))
def weighted_draws(spark, sf):
    from notelens.functions.hashing import uniform

    dist = stage(vo.sampling_distribution(fx.vocab(spark, sf)), "dist")
    slices = stage(vo.cumulative(dist), "slices")
    draws = table(spark, sf, "events").select(F.col("event_id").alias("draw_id"), uniform("event_id", seed=3).alias("u"))
    return vo.weighted_draw(draws, slices, "u", "id").select("draw_id", "id")


s.define("alias_items", ("negative_p",), """
SELECT *, (4503599627370496 // n) AS q, row_number() OVER (ORDER BY id) - 1 AS cell,
       floor(p / whole * ((4503599627370496 // n) * n * (1 - 1e-9)))::BIGINT AS units
FROM (SELECT id, p, count(*) OVER () AS n, sum(p) OVER () AS whole FROM negative_p WHERE p > 0)""")
s.define("alias_own", ("alias_items",), """
SELECT id, cell, n, q, units + l // n + CASE WHEN cell < l % n THEN 1 ELSE 0 END AS own
FROM (SELECT *, q * n - sum(units) OVER ()::BIGINT AS l FROM alias_items)""")
s.define("alias_sides", ("alias_own",), """
SELECT *, coalesce(sum(abs(own - q)) OVER (PARTITION BY own < q ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins,
       lead(id) OVER (PARTITION BY own < q ORDER BY cell) AS following FROM alias_own""")
s.define("alias_cells", ("alias_sides",), """
SELECT cell, id, own / q::DOUBLE AS cut,
       (SELECT arg_max(h.id, h.cell) FROM alias_sides h WHERE h.own >= h.q AND h.begins = (
          SELECT max(g.begins) FROM alias_sides g WHERE g.own >= g.q AND g.begins <= l.begins)) AS other
FROM alias_sides l WHERE own < q
UNION ALL
SELECT cell, id, (q - greatest(0, coalesce((SELECT max(l.begins + l.q - l.own) FROM alias_sides l WHERE l.own < l.q AND l.begins < h.begins + h.own - h.q), 0)
                               - (begins + own - q))) / q::DOUBLE AS cut, coalesce(following, id) AS other
FROM alias_sides h WHERE own >= q""")


@register("v10_alias_table", s.with_("SELECT cell, id, round(cut, 6) AS cut, other FROM alias_cells", "alias_cells"))
def alias_table(spark, sf):
    dist = stage(vo.sampling_distribution(fx.vocab(spark, sf)), "dist")
    return vo.alias_table(dist).select("cell", "id", F.round("cut", 6).alias("cut"), "other")


@register("v10_alias_draws", s.with_(f"""
SELECT draw_id, CASE WHEN u * n - cell < cut THEN id ELSE other END AS id
FROM (SELECT event_id AS draw_id, {s.u('event_id', seed=3)} AS u, (SELECT count(*) FROM alias_cells) AS n FROM events) d
JOIN alias_cells c ON c.cell = floor(d.u * d.n)""", "alias_cells"))
def alias_draws(spark, sf):
    from notelens.functions.hashing import uniform

    dist = stage(vo.sampling_distribution(fx.vocab(spark, sf)), "dist")
    draws = table(spark, sf, "events").select(F.col("event_id").alias("draw_id"), uniform("event_id", seed=3).alias("u"))
    return vo.alias_draw(draws, stage(vo.alias_table(dist), "alias"), "u", "id").select("draw_id", "id")


@register("v11_frequency_export", s.with_("""
SELECT row_number() OVER (ORDER BY support DESC, id) + 2 AS line_no, token AS line FROM vocab WHERE kind = 'token'
UNION ALL SELECT unnest([0, 1, 2]), unnest(['<S>', '</S>', '<UNK>'])""", "vocab"))
def frequency_export(spark, sf):
    return vo.frequency_export(fx.vocab(spark, sf))


s.define("lf_words", ("senses",), f"""
SELECT DISTINCT unnest(string_split(replace(lf, ';', ' '), ' ')) AS token FROM senses UNION SELECT lower(sf) FROM senses""")


@register("v12_extended_vocabulary", s.with_("""
SELECT id, token, support, kind FROM vocab
UNION ALL
SELECT (SELECT max(id) FROM vocab) + row_number() OVER (ORDER BY token), token, 0, 'token'
FROM (SELECT token FROM lf_words EXCEPT SELECT token FROM vocab)""", "vocab", "lf_words"))
def extended_vocabulary(spark, sf):
    senses = fx.senses(spark, sf)
    words = senses.select(F.explode(F.split(F.replace("lf", F.lit(";"), F.lit(" ")), " ")).alias("token"))
    return vo.extend_vocabulary(fx.vocab(spark, sf), words.union(senses.select(F.lower("sf"))))


@register("v13_split_vocabulary", s.with_("""
SELECT CASE WHEN kind IN ('section', 'category') THEN 'metadata' ELSE 'token' END AS part,
       CASE WHEN kind IN ('section', 'category')
            THEN row_number() OVER (PARTITION BY kind IN ('section', 'category') ORDER BY id) ELSE id END AS id,
       token, support FROM vocab""", "vocab"))
def split_vocabulary(spark, sf):
    return vo.split_vocabulary(fx.vocab(spark, sf))


@register("v14_merged_vocabulary", s.with_(f"""
SELECT DISTINCT lower(w) AS token FROM (SELECT unnest(regexp_split_to_array(text, '{s.SP}+')) AS w FROM benchmark)
UNION SELECT token FROM vocab WHERE kind IN ('section', 'category') UNION SELECT 'digitparsed'""", "vocab"))
def merged_vocabulary(spark, sf):
    external = table(spark, sf, "benchmark").select(F.explode(F.split("text", tx.SPACES)).alias("token"))
    return vo.merge_vocabularies(external, fx.vocab(spark, sf), _SPECIAL)
