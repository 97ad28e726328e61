import random
import re
import zlib

import oracle
import pytest

from notelens.llm import spelling as op
from notelens.llm.spelling_queries import SQL, op11_spelling


def near(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain(counts, times=10):
    out = []
    forms = {}
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= times * n:
            forms[w] = best
        out.append((w, n, len(others)))
    def last(w):
        while w in forms:
            w = forms[w]
        return w
    return sorted((w, forms.get(w), last(w), n, k, counts[forms[w]] if w in forms else None) for w, n, k in out)


def run(spark, counts, times=10):
    found = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
    got = op.group(found, times).collect()
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got)


def key(rows):
    return sorted(rows, key=lambda r: r[0])


@pytest.mark.parametrize("seed,letters,sizes", [(1, "ab", (1, 8)), (2, "abcé", (3, 6)), (3, "abcdefgh", (7, 12))])
def test_equals_all_pairs(spark, seed, letters, sizes):
    rng = random.Random(seed)
    counts = {}
    while len(counts) < 250:
        w = "".join(rng.choice(letters) for _ in range(rng.randint(*sizes)))
        for _ in range(4):
            k = rng.randint(0, len(w))
            w = rng.choice([w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k + 1:]]) or "a"
            counts[w] = rng.choice([1, 2, 3, 30, 400, 5000])
        if len(counts) >= 2 ** sizes[1] / 2:
            break
    assert key(run(spark, counts)) == key(plain(counts))


def test_repeated_letters_and_long_words(spark):
    counts = {"a" * k: 10 ** (k % 5) for k in range(7, 40)}
    long = "".join(chr(97 + k * k % 23) for k in range(20_000))
    counts |= {long: 3, long[:9000] + long[9001:]: 40, long[:19_000] + "é" + long[19_000:]: 500, "b" * 5000 + "c": 2, "b" * 5001: 2}
    assert key(run(spark, counts)) == key(plain(counts))


def test_collisions_lose_nothing(spark, monkeypatch):
    rng = random.Random(4)
    counts = {"".join(rng.choice("abc") for _ in range(rng.randint(4, 7))): rng.randint(1, 100) for _ in range(120)}
    monkeypatch.setattr(op, "_mixed", lambda x: x & __import__("numpy").uint64(3))
    assert key(run(spark, counts)) == key(plain(counts))


def test_words(spark, documents):
    rng = random.Random(7)
    letters = "abcdeXYZÀé×÷ÿ"
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 10))) for _ in range(40)]
    rows = [(rng.choice([k, -k, None]), " ,;1\nŁ"[k % 6].join(rng.choice(vocabulary) for _ in range(60))) for k in range(80)]
    rows += [(1, None), (2, ""), (3, "short"), (3, "w" * 30_000), (3, "w" * 30_000), (4, "漢字" * 20)]
    counts = {}
    for i, text in rows:
        for found in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if c < "\x7f" else c for c in found)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            low = low[:h % len(low)] + low[h % len(low) + 1:] if h % 31 == 0 else low
            if len(low) >= 7:
                counts[low] = counts.get(low, 0) + 1
    got = op.words(documents(rows, extra=["word", "n", "run"]))
    assert {r.word: r.n for r in got.collect()} == {w: n for w, n in counts.items() if n >= 2}
    assert any(len(w) == 30_000 for w in counts)


def test_empty(spark, documents):
    assert op.group(op.words(documents([]))).count() == 0
    assert run(spark, {"lonelyword": 5}) == [("lonelyword", None, "lonelyword", 5, 0, None)]


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert oracle.compare(spark, oracle.connect(sf), sf, op11_spelling, SQL) == ""
