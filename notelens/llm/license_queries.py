"""Query of operator 13; its SQL tries the templates as regular expressions at every word."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelens.llm import licenses
from notelens.llm.license_texts import TEMPLATES
from notelens.llm.registry import register
from notelens.llm.tables import table


def pattern(items: tuple) -> str:
    """A template as a regular expression over words that a space follows each."""
    out = ""
    for item in items:
        if isinstance(item, licenses.Word):
            out += item.text.decode() + " "
        elif isinstance(item, licenses.Optional):
            out += f"(?:{pattern(item.items)})?"
        else:
            word = "[^ ]+" if item.pattern is None else f"(?:{item.pattern})"
            out += f"(?:{word} ){{{item.least},{item.most}}}"
    return out


_PARSED = [(t, licenses.parse(t.markup)) for t in TEMPLATES]
_ROWS = ", ".join(f"('{t.label}', {str(t.base).lower()}, '^{pattern(p)}', {licenses.longest(p)})" for t, p in _PARSED)
SQL = rf"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
templates AS (SELECT * FROM (VALUES {_ROWS}) AS t(label, base, pattern, longest)),
starts AS (SELECT r, i, words FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM d
                                    WHERE list_has_any(words, ['license', 'cc', 'permission']))
           WHERE regexp_matches(words[i], '^(gnu|apache|cc|mit|this|licensed|released|distributed|available|the|copyright|permission)$')),
tried AS (SELECT r, i, label, base, regexp_extract(array_to_string(words[i:i + longest - 1], ' ') || ' ', pattern) AS found
          FROM starts, templates),
place AS MATERIALIZED (SELECT r, i - 1 AS first, label, base, len(string_split(found, ' ')) - 1 AS n FROM tried WHERE found <> ''),
inside AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(first, first + n)) FROM place) GROUP BY r),
sums AS (SELECT r, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
                string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
                string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM place GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN len(words) = 0 THEN 0.0 ELSE CAST(coalesce(n, 0) AS DOUBLE) / len(words) END AS score
FROM d LEFT JOIN sums USING (r) LEFT JOIN inside USING (r)
"""


@register("op13_license_scan", SQL)
def op13_license_scan(spark, sf_dir):
    found = licenses.scan(table(spark, sf_dir, "documents"), TEMPLATES)
    base = F.filter("places", lambda p: p["base"])
    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    firsts = F.transform(base, lambda p: p["first"])
    score = F.when(F.col("n_words") > 0, F.col("n_covered") / F.col("n_words")).otherwise(F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(firsts).alias("first_word"),
        F.array_max(firsts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"),
        score.alias("score"))
