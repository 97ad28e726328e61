"""Query of operator 11; its SQL finds near words by their texts without one code point and counts CRC-32 by its rule."""

from __future__ import annotations

from notelens.llm import spelling
from notelens.llm.registry import register
from notelens.llm.tables import staged, table

SQL = r"""
WITH RECURSIVE rule AS MATERIALIZED (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) AS r(i))),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
low AS MATERIALIZED (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM runs WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (SELECT doc_id, run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM low),
hashed AS MATERIALIZED (
  SELECT run, n, xor(4294967295, list_reduce(
           [4294967295] || [CAST('0x' || x[2 * i - 1:2 * i] AS BIGINT) FOR i IN range(1, length(x) // 2 + 1)],
           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS h FROM bytes, rule),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
short AS MATERIALIZED (
  SELECT word, i, word[:i - 1] || word[i + 1:] AS cut FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS near FROM short a JOIN short b ON a.cut = b.cut AND a.i = b.i WHERE a.word <> b.word
  UNION SELECT s.word, w.word FROM short s JOIN words w ON s.cut = w.word
  UNION SELECT w.word, s.word FROM short s JOIN words w ON s.cut = w.word),
best AS (
  SELECT near.word, count(*) AS n_near, arg_min(near, {'n': -w.n, 'w': near}) AS form, max(w.n) AS form_n
  FROM near JOIN words w ON w.word = near.near GROUP BY near.word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.form_n >= 10 * w.n THEN b.form END AS form,
         CASE WHEN b.form_n >= 10 * w.n THEN b.form_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word),
followed AS (
  SELECT word, word AS root FROM forms
  UNION ALL SELECT followed.word, forms.form FROM followed JOIN forms ON followed.root = forms.word WHERE forms.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM forms f JOIN (SELECT followed.word, followed.root FROM followed JOIN forms ON followed.root = forms.word WHERE forms.form IS NULL) r
  ON f.word = r.word
"""


@register("op11_spelling", SQL)
def op11_spelling(spark, sf_dir):
    return spelling.group(staged(spelling.words(table(spark, sf_dir, "documents")), "words"))
