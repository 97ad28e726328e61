import hashlib
import math

import numpy as np
import oracle
import pytest
from pyspark.sql import types as T

from notelens.llm import vector_codes as op
from notelens.llm.vector_code_queries import SQL, op12_vector_codes

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()), T.StructField("code", T.StringType())])


def nearest(codebook, part):
    d = [sum((int(a) - int(b)) ** 2 for a, b in zip(part, entry)) for entry in codebook]
    return d.index(min(d)), min(d)


def plain(rows, size, entries, rounds):
    """Codes, errors and the digest of the codebooks by comparing every part with every entry."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and len(v) == size
            and all(x is not None and math.isfinite(x) for x in v)]
    whole = [[math.floor(1024 * float(np.float32(x))) for x in v] for _, v, _ in kept]
    w = size // 4
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, whole[k]))[:entries]
    books = [[whole[k][p * w:(p + 1) * w] for k in order] for p in range(4)]
    part = lambda v, p: v[p * w:(p + 1) * w]
    for _ in range(rounds):
        for p in range(4):
            found = [nearest(books[p], part(v, p))[0] for v in whole]
            for e in range(len(books[p])):
                own = [part(v, p) for v, f in zip(whole, found) if f == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    out, digits = [], max(2, len(f"{len(order) - 1:x}"))
    for (i, _, label), v in zip(kept, whole):
        best = [nearest(books[p], part(v, p)) for p in range(4)]
        out.append((i, label, "".join(f"{b[0]:0{digits}x}" for b in best), sum(b[1] for b in best)))
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    return out, digest


def rows(seed, n=300, size=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, size))
    made = [(int(k), [float(x) for x in centres[k % 6] + rng.normal(size=size) * 0.05], int(k % 5) if k % 7 else None) for k in range(n)]
    made += [(1000 + k, made[3][1], 4) for k in range(40)]  # very common vector
    made += [(5, made[9][1], 1), (None, made[1][1], 2), (2000, None, 1), (2001, [], 1), (2002, [1.0] * 5, 1), (2003, [float("nan")] * size, 1),
             (2004, [float("inf")] * size, None), (2005, [None] * size, 1), (2006, [9000.0, -9000.0] * (size // 2), None)]
    return made


@pytest.mark.parametrize("entries", [1, 16, 500])
def test_equals_definition(spark, entries):
    made = rows(3)
    df = spark.createDataFrame([(*r, "x") for r in made], SCHEMA).repartition(5)
    books = op.fit(df, entries=entries)
    got = op.encode(df, books, keep=["vec_id", "label", "code"])
    want, digest = plain(made, 12, entries, 4)
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else x for x in r)
    assert sorted([(r.vec_id, r.label, r.code, r.error) for r in got.collect()], key=key) == sorted(want, key=key)
    assert books.sha256 == digest


def test_label_error(spark, monkeypatch):
    from notelens.operators import scale

    df = spark.createDataFrame([(k, f"{k:08x}", k, None if k % 3 else k % 2) for k in range(50)], "vec_id long, code string, error long, label int")
    want = {}
    for k in range(50):
        label = None if k % 3 else k % 2
        want[label] = want.get(label, 0) + k
    for bound in (scale.BROADCAST_BYTES, 0):
        monkeypatch.setattr(scale, "BROADCAST_BYTES", bound)
        got = op.with_label_error(df).collect()
        assert len(got) == 50 and all(r.label_error == want[r.label] for r in got)


def test_dominated_entries_are_never_nearest():
    rng = np.random.default_rng(1)
    book = op.Codebook(rng.integers(-300, 300, (64, 4)), cells=50)
    parts = rng.integers(-400, 400, (2000, 4))
    for some in np.array_split(parts, 7):
        index, distance = book.nearest(some)
        every = ((some[:, None] - book.entries[None]) ** 2).sum(2)
        assert (index == every.argmin(1)).all() and (distance == every.min(1)).all()
    counts, _ = book.candidates(parts[:200])
    assert counts.mean() < 20


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert op.encode(df, op.fit(df)).count() == 0
    none = spark.createDataFrame([(1, None, 1, ""), (2, [1.0], 1, "")], SCHEMA)
    assert op.encode(none, op.fit(none)).count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert oracle.compare(spark, oracle.connect(sf), sf, op12_vector_codes, SQL) == ""
