"""Query of operator 10."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelens.llm import substrings
from notelens.llm.registry import register
from notelens.llm.tables import table

SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (SELECT doc_id, t.i AS i, array_to_string(words[t.i:t.i + 49], ' ') AS s
        FROM d, unnest(range(1, len(words) - 48)) AS t(i) WHERE len(words) >= 50),
low AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT DISTINCT win.doc_id, win.i + r.j AS p FROM win JOIN low USING (s), range(50) AS r(j) WHERE low.m < win.doc_id),
word AS (SELECT doc_id, t.p AS p, words[t.p] AS w FROM d, unnest(range(1, len(words) + 1)) AS t(p)),
left_over AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS kept, count(*) AS n
              FROM word WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = word.doc_id AND gone.p = word.p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over ON d.doc_id = left_over.doc_id
"""


@register("op10_substring_dedup", SQL)
def op10_substring_dedup(spark, sf_dir):
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
