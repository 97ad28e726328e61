import re

import oracle
import pytest
from pyspark.sql import functions as F

from notelens.llm import urls as op
from notelens.llm.url_queries import RULES, SQL, op2_url_filter


def plain(url, listed):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    name = re.sub(r"^(www|m)\.", "", re.sub(":[0-9]*$", "", host)) + re.sub(r"\.html$", "", re.sub("/+$", "", path))
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    rule = max(fits, key=lambda r: len(r.host + r.path), default=None)
    known = bool(host) and name in listed
    return host, path, rule and rule.host + rule.path, known, rule.verdict if rule else "block" if known else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "https://xexample.org/en/12", "x://org/",
    "http://org", "http://a.com/fr/1", "http://a.com/de/1", "http://www.Bad.net/p/", "http://bad.net/p.html?x=1", "http://bad.net/P", "http://m.bad.net:80/p#x",
    "http://good.net/q", "http://good.net/q", "a://b://bad.net/p", "http://é.net/ü", "http://bad.net?p", "http://bad.net/p\nq", "http://x.net/" + "y" * 50_000,
]


@pytest.mark.parametrize("blocks", [1, 1 << 16])
def test_rows_equal_plain_version(spark, monkeypatch, blocks):
    monkeypatch.setattr(op, "MAX_BLOCKS", blocks)
    listed = ["bad.net/p", "bad.net/p", "é.net/ü", "", None, *[f"other{k}.net/{k}" for k in range(500)]]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(URLS)], "page_id long, url string, host string")
    got = op.judge(pages, RULES, spark.createDataFrame([(x,) for x in listed], "canonical string"), keep=["page_id", "host"])
    assert got.columns == ["page_id", "host", "path", "rule", "listed", "verdict"]
    rows = {r.page_id: (r.host, r.path, r.rule, r.listed, r.verdict) for r in got.collect()}
    assert rows == {k: plain(u, set(listed)) for k, u in enumerate(URLS)}


def test_filter_holds_all_listed_and_few_others(spark):
    own = spark.range(5000).select(F.concat(F.lit("site"), "id").alias("u"))
    filled = op.bloom_filter(own, "u", 512)
    assert op.possible_hits(own, "u", filled, 512).filter("not possible").count() == 0
    others = spark.range(5000).select(F.concat(F.lit("other"), "id").alias("u"))
    assert op.possible_hits(others, "u", filled, 512).filter("possible").count() < 250


def test_empty_tables(spark):
    none = spark.createDataFrame([], "canonical string")
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    assert [r.verdict for r in op.judge(pages, RULES, none).collect()] == ["allow"]
    assert op.judge(pages.limit(0), RULES, none).count() == 0
    assert [r.rule for r in op.judge(pages, [], none).collect()] == [None]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, sf):
    folder = f"/root/testdata/{sf}"
    assert oracle.compare(spark, oracle.connect(folder), folder, op2_url_filter, SQL) == ""
    assert {r.verdict for r in op2_url_filter(spark, folder).filter("rule is null").collect()} == {"allow", "block"}
