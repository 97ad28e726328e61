import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from notelens.llm import simhash as op
from notelens.llm.components import components
from notelens.llm.simhash_queries import op5_simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, points, radius=4):
    smallest = list(range(len(ids)))

    def root(i):
        while smallest[i] != i:
            i = smallest[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (points[i] ^ points[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                smallest[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(root(i), []).append(ids[i])
    return {i: min(g) for g in groups.values() for i in g}


TEXTS = [None, "", " \n", "one", "one two three", "One two\tthree", "x y z w", "É é É é É", "a b c d " * 20_000, " a b c d e", "İ I i"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert int.from_bytes(op.fingerprint(text), "big") == plain_fingerprint(text)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    points = [plain_fingerprint(d.text) for d in docs]
    want = plain_components([d.doc_id for d in docs], points)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op5_simhash(spark, SF).collect()}
    assert got == {d.doc_id: (f"{p:016x}", want[d.doc_id]) for d, p in zip(docs, points)}


def near_points(seed, n=1500):
    """Random points, chains of points a few bits apart, and a dense ball."""
    rng = np.random.default_rng(seed)
    points = [int(x) for x in rng.integers(0, 2**63, n // 2)]
    for p in points[:40]:
        for _ in range(6):
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                p ^= 1 << int(b)
            points.append(p)
    points += [points[0] ^ 1 << int(a) ^ 1 << int(b) for a, b in rng.integers(0, 64, (n // 4, 2))]
    return sorted(set(points))


@pytest.mark.parametrize("leaf,shard", [(5000, 5000), (60, 5000), (60, 40), (5, 5000)])
def test_shards_lose_no_link(spark, leaf, shard):
    points = near_points(3, 600)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    frame = spark.createDataFrame([(p,) for p in signed], "point long").repartition(3)
    found = {r.node: r.root for r in components(op.link_points(frame, len(points), leaf=leaf, shard=shard)).collect()}
    want = plain_components(signed, points)
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups({p: found.get(p, p) for p in signed}) == groups(want)


def test_tree_keeps_close_values_together():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 1 << 16, 3000).astype(np.uint16)
    nodes = op.build_tree(values[:500], 6, rng)
    rows, leaves = op.shards_of(values, nodes, 1)
    where = {}
    for r, leaf in zip(rows, leaves):
        where.setdefault(int(values[r]), set()).add(int(leaf))
    for v in where:
        for b in range(16):
            if v ^ 1 << b in where:
                assert where[v] & where[v ^ 1 << b]


def test_components_of_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 101 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "left long, right long")).collect()}
    roots = [{got[i] for i in range(61)}, {got[i] for i in range(100, 151)}]
    assert [len(r) for r in roots] == [1, 1] and roots[0] != roots[1] and len(got) == 112


def test_rows(spark, documents):
    text = "some words of a text that is long enough to have several shingles in it and more"
    docs = documents([(5, text), (3, text.upper()), (3, text.upper()), (9, None), (8, ""), (7, "other words entirely here now"), (None, text)],
                     extra=["point", "component_id", "root"])
    got = sorted((r.doc_id or -1, r.component_id) for r in op.near_duplicates(docs).collect())
    assert got == [(-1, 3), (3, 3), (3, 3), (5, 3), (7, 7), (8, 8), (9, 8)]
    kept = op.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 7, 8]
    assert op.near_duplicates(documents([])).count() == 0 and op.keep_one(documents([])).count() == 0
    assert op.near_duplicates(documents([(None, "a"), (None, "a")])).filter(F.col("component_id").isNull()).count() == 2


def test_keep_one_row_of_every_group(spark, documents):
    """Ids that stand in several groups, groups without ids, and texts of one group under one id."""
    a, b = "zebras " + " ".join(f"word{k}" for k in range(30)), "apples " + " ".join(f"term{k}" for k in range(30))
    c = " ".join(f"part{k}" for k in range(30))
    docs = documents([(5, a), (3, b.upper()), (5, b), (None, c), (None, c.upper()), (None, "one two three four"), (None, "five six seven eight"),
                      (None, None), (None, "")], extra=["root", "digest", "point", "smallest"])
    got = sorted((r.doc_id or -1, r.text) for r in op.keep_one(docs.repartition(3)).collect())
    assert got == sorted([(5, a), (3, b.upper()), (-1, c.upper()), (-1, "one two three four"), (-1, "five six seven eight"), (-1, "")])
    same = documents([(5, a), (5, b)])
    assert {r.text for r in op.keep_one(same).collect()} == {a, b}
