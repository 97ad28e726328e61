"""Query of operator 12."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelens.llm import vector_codes as codes
from notelens.llm.registry import register
from notelens.llm.tables import staged, table

HEAD = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, embedding, len(embedding) // 4 AS w, row_number() OVER (ORDER BY vec_id) - 1 AS rank FROM embeddings
  WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)),
x AS MATERIALIZED (
  SELECT vec_id, rank, (i - 1) // w AS part, (i - 1) % w AS pos, CAST(floor(1024 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS v
  FROM (SELECT vec_id, rank, w, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM kept)),
c0 AS MATERIALIZED (SELECT part, rank AS entry, pos, v FROM x WHERE rank < 256)"""
#: The least of distance * 256 + index has the nearest entry, ties to the lower index.
NEAREST = """,
a{k} AS MATERIALIZED (
  SELECT rank, part, min(d * 256 + entry) AS best FROM (
    SELECT x.rank, x.part, c.entry, CAST(sum((x.v - c.v) * (x.v - c.v)) AS BIGINT) AS d
    FROM x JOIN c{k} c ON x.part = c.part AND x.pos = c.pos GROUP BY ALL) GROUP BY ALL)"""
REFINED = """,
c{next} AS MATERIALIZED (
  SELECT c.part, c.entry, c.pos, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (
    SELECT x.part, a.best % 256 AS entry, x.pos, CAST(floor(sum(x.v) / count(*)) AS BIGINT) AS v
    FROM x JOIN a{k} a ON x.rank = a.rank AND x.part = a.part GROUP BY ALL) m
  ON c.part = m.part AND c.entry = m.entry AND c.pos = m.pos)"""
TAIL = """,
coded AS (
  SELECT rank, string_agg(printf('%02x', best % 256), '' ORDER BY part) AS code, CAST(sum(best // 256) AS BIGINT) AS error
  FROM a4 GROUP BY rank)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM c4) AS codebooks_sha256
FROM coded JOIN kept ON coded.rank = kept.rank
"""
SQL = HEAD + "".join(NEAREST.format(k=k) + REFINED.format(k=k, next=k + 1) for k in range(4)) + NEAREST.format(k=4) + TAIL


@register("op12_vector_codes", SQL)
def op12_vector_codes(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = codes.fit(rows)
    coded = staged(codes.encode(rows, books), "codes")
    return codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
