"""Query of operator 2. Listed are the canonical URLs of pages whose host has a label of the kind listed here."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelens.llm import urls
from notelens.llm.registry import register
from notelens.llm.tables import table

RULES = (
    urls.Rule("org", "/", "allow"), urls.Rule("example.org", "/es/", "block"), urls.Rule("example.org", "/en/1", "block"),
    urls.Rule("com", "/fr/", "allow"), urls.Rule("com", "/de/", "block"),
)
#: Whole host labels whose pages are listed.
LISTED_LABELS = r"(^|\.)(cheap-pills|spam-farm|casino-[a-z]+|free-[a-z]+)\."

SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
named AS (
  SELECT *, regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '^(www|m)\.', '')
            || regexp_replace(regexp_replace(path, '/+$', ''), '\.html$', '') AS name FROM parts),
listed AS (
  SELECT DISTINCT name FROM named WHERE host <> '' AND regexp_matches(host, '(^|\.)(cheap-pills|spam-farm|casino-[a-z]+|free-[a-z]+)\.')),
rules AS (
  SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                        ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS r(rule_host, rule_path, rule_verdict)),
best AS (
  SELECT page_id, host, path, max_by(struct_pack(r := rule_host || rule_path, v := rule_verdict), length(rule_host || rule_path)) AS won
  FROM (SELECT DISTINCT host, path, page_id FROM parts) JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY ALL)
SELECT n.page_id, n.host, n.path, b.won.r AS rule, l.name IS NOT NULL AS listed,
       coalesce(b.won.v, CASE WHEN l.name IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM named n LEFT JOIN best b ON n.page_id = b.page_id AND n.host = b.host AND n.path = b.path
LEFT JOIN listed l ON n.name = l.name AND n.host <> ''
"""


@register("op2_url_filter", SQL)
def op2_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host = urls.host_of(F.col("url"))
    listed = pages.filter(host.rlike(LISTED_LABELS)).select(urls.canonical(host, urls.path_of(F.col("url"))).alias("canonical"))
    return urls.judge(pages, RULES, listed)
