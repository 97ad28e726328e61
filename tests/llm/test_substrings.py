import random
import re

import oracle
import pytest

from notelens.llm import substrings as op
from notelens.llm.substring_queries import SQL, op10_substring_dedup


def plain(rows, width):
    """Kept words of each row, by the definition."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    smallest = {}
    for i, w in words:
        for k in range(len(w) - width + 1):
            key = tuple(w[k:k + width])
            if i is not None:
                smallest[key] = min(i, smallest.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and smallest[tuple(w[k:k + width])] < i:
                gone.update(range(k, k + width))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def passages(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}é" for k in range(300)]
    shared = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 40))] for _ in range(5)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(shared)
            a = rng.randint(0, 5)
            parts.append(rng.choice([p, p[a:], p[:-3], [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))], ["und"] * rng.randint(1, 60)]))
        rows.append((rng.randint(0, 45), "\t".join(w for p in parts for w in p)))
    return rows + [(rows[0][0], rows[0][1]), (1000, rows[3][1]), (1001, rows[3][1]), (None, rows[3][1]), (2000, None), (2001, ""),
                   (2002, " ".join("long" + str(k % 977) for k in range(30_000))), (2003, " ".join("long" + str(k % 977) for k in range(3, 5000)))]


@pytest.mark.parametrize("hot", [None, 5])
def test_equals_definition(documents, hot):
    rows = passages(4)
    got = op.remove_repeats(documents(rows, extra=["kept", "runs", "digest"]), width=10, gram=4, hot=hot)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r["kept"]) for r in got.collect()), key=key) == sorted(plain(rows, 10), key=key)


def test_spans_are_what_was_removed(documents):
    rows = passages(9)
    for r in op.remove_repeats(documents(rows), width=10, gram=4, keep=["doc_id", "text"]).collect():
        words = (r.text or "").split()
        gone = {k for s in r.removed for k in range(s["first"], s["first"] + s["count"])}
        assert r["kept"] == " ".join(w for k, w in enumerate(words) if k not in gone) and len(gone) == r.n_removed


def test_windows_of_a_run_share_their_minimiser():
    words = [str(k % 37).encode() for k in range(400)]
    found = op.super_kmers(words, 12, 5)
    assert [f[1] for f in found] == [sum(g[2] for g in found[:k]) for k in range(len(found))]
    assert sum(f[2] for f in found) == 389
    for minimiser, start, count in found:
        for w in range(start, start + count):
            assert op.super_kmers(words[w:w + 12], 12, 5) == [(minimiser, 0, 1)]


def test_empty_table(documents):
    assert op.remove_repeats(documents([])).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert oracle.compare(spark, oracle.connect(sf), sf, op10_substring_dedup, SQL) == ""


def test_many_rows_of_one_id(documents):
    """Rows of one id are joined by their own text; only other ids remove words."""
    shared = " ".join(f"s{k}" for k in range(30))
    rows = [(7, f"{shared} own{k} " + " ".join(f"x{k}y{j}" for j in range(20))) for k in range(400)] + [(7, shared)] * 50 + [(3, shared)]
    got = op.remove_repeats(documents(rows), width=10, gram=4)
    key = lambda r: (r[0], r[1:])
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r["kept"]) for r in got.collect()), key=key) == sorted(plain(rows, 10), key=key)


def test_hot_windows_are_split(documents, monkeypatch):
    from notelens.operators import scale

    rows = passages(6)
    want = sorted(map(str, op.remove_repeats(documents(rows), width=10, gram=4, hot=5).collect()))
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 2000)
    monkeypatch.setattr(scale, "HOT_SHARE", 0.01)
    assert sorted(map(str, op.remove_repeats(documents(rows), width=10, gram=4, hot=5).collect())) == want
