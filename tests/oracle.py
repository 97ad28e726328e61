"""Run registered queries against their SQL on the same tables."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _norm(value):
    if value is None:
        return ""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_norm(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir, query, sql):
    """Empty string when both results are equal, else what differs."""
    out = query(spark, sf_dir)
    got_cols, got = canonical(out.columns, [tuple(r) for r in out.collect()])
    res = con.execute(sql)
    want_cols, want = canonical([c[0] for c in res.description], res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return f"rows {len(got)} != {len(want)}; only spark {extra}; only sql {missing}"[:1500]
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {str(bad[0][0])[:500]} <> {str(bad[0][1])[:500]}"
    types = {f.name: f.dataType.simpleString() for f in out.schema.fields}
    return "" if got else f"empty result {types}"
