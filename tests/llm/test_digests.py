import hashlib

import numpy as np
import pytest

from notelens.llm import digests as op
from notelens.llm.digest_queries import op4_fingerprints

SF = "/root/testdata/sf0.001"


def plain_digest(text):
    raw, counts = (text or "").encode(), [0] * 128
    for a, b, c in zip(raw, raw[1:], raw[2:]):
        counts[((a | b << 8 | c << 16) * 2654435761 % 2**32) >> 25] += 1
    q1, q2, q3 = (sorted(counts)[k] for k in (31, 63, 95))
    codes = [(c > q1) + (c > q2) + (c > q3) for c in counts]
    body = bytes(codes[k] << 6 | codes[k + 1] << 4 | codes[k + 2] << 2 | codes[k + 3] for k in range(0, 128, 4))
    head = bytes([min(255, round(8 * np.log2(1 + len(raw)))), (15 * q1 // q3 << 4 | 15 * q2 // q3) if q3 else 0])
    return (head + body).hex()


def plain_rows(rows):
    """Rows of (doc_id, text) in the order of the contract, each with the next one."""
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: (-r[0], r[1] is not None, r[1] or ""))
    order = known + sorted((r for r in rows if r[0] is None), key=lambda r: (r[1] is not None, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, n = t or "", order[(k + 1) % len(order)][1] or ""
        e = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        out.append((i, len(t), e, plain_digest(t), plain_digest(e), op.likeness(plain_digest(t), plain_digest(e)),
                    op.likeness(plain_digest(t), plain_digest(n))))
    return out


key = lambda r: (r[0] is None, r[0] or 0, *r[1:])


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(i, n, hashlib.sha256(e.encode()).hexdigest(), *rest) for i, n, e, *rest in plain_rows(docs)]
    got = [tuple(r) for r in op4_fingerprints(spark, SF).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert np.mean([r[5] for r in got]) > np.mean([r[6] for r in got]) + 0.1


@pytest.mark.parametrize("rows", [1, 3, 1000])
def test_ranges(documents, rows):
    texts = [(k * k % 97 * 10**12, f"text {k} é🦙 " * (k % 7)) for k in range(60)] + [
        (5, None), (5, ""), (5, "same"), (5, "same"), (None, "no id"), (None, None), (-3, "x" * 200_000), (7, "a")]
    got = [tuple(r) for r in op.with_next(documents(texts, extra=["part", "last"]), rows).collect()]
    assert sorted(got, key=key) == sorted(plain_rows(texts), key=key)


@pytest.mark.parametrize("hot", [None, 11, 2**60])
def test_rows_of_one_id_are_cut(documents, hot):
    texts = [(hot, f"{k * 7919 % 1000} words of text {k}") for k in range(400)] + [(hot, None), (hot, "")]
    texts += [(k, f"other {k}") for k in range(5, 20) if k != hot] + [(2**60 + k, f"near {k}") for k in (-1, 1, 2)]
    docs = documents(texts)
    sizes = [r["count"] for r in op._ranges(docs.select("doc_id", "text"), 20).groupBy("part").count().collect()]
    assert max(sizes) <= 60 and len(sizes) >= 12
    assert sorted((tuple(r) for r in op.with_next(docs, 20).collect()), key=key) == sorted(plain_rows(texts), key=key)


def test_one_and_none(documents):
    assert [tuple(r)[:3] for r in op.with_next(documents([(4, "abcd")])).collect()] == [(4, 4, "abab")]
    assert op.with_next(documents([])).count() == 0


def test_difference_is_bounded():
    rng = np.random.default_rng(1)
    texts = ["", "a", "ab", "abc" * 1000, *(bytes(rng.integers(97, 97 + k, 50 * k).astype(np.uint8)).decode() for k in range(2, 26))]
    found = [op.digest(t) for t in texts]
    for a in found:
        assert op.difference(a, a) == 0 and op.likeness(a, a) == 1
        for b in found:
            assert 0 <= op.difference(a, b) == op.difference(b, a) <= op.WORST
