import hashlib
import struct
import zlib

import numpy as np
import pytest

from notelens.llm import media as op
from notelens.llm.media_queries import op7_media

SF = "/root/testdata/sf0.001"


def plain_payload(text):
    raw = (text or "").encode()
    size = max(576, -(-len(raw) // 576) * 576)
    return raw + b"\xff" * (size - len(raw))


def test_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in op7_media(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        r, want = got[d.doc_id], plain_payload(d.text)
        assert (r.n_bytes, r.payload_bytes) == (len(d.text.encode()), len(want))
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-32:])
        stored = op.write_png(want)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and len(r.feature) == 16


def filtered_png(image, kinds):
    """A file whose rows use given filters, written by the definition."""
    rows, above = b"", [0] * image.shape[1]
    for row, kind in zip(image.tolist(), kinds):
        out, left, corner = [], 0, 0
        for x, up in zip(row, above):
            p = left + up - corner
            pa, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
            paeth = left if pa <= pb and pa <= pc else up if pb <= pc else corner
            out.append((x - [0, left, up, (left + up) // 2, paeth][kind]) % 256)
            left, corner = x, up
        rows += bytes([kind, *out])
        above = row
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    data = zlib.compress(rows)
    return (op.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", image.shape[1], len(image), 8, 0, 0, 0, 0)) + chunk(b"tEXt", b"a\0b")
            + chunk(b"IDAT", data[:7]) + chunk(b"IDAT", data[7:]) + chunk(b"IEND", b""))


def test_all_filters_and_split_data():
    image = np.random.default_rng(1).integers(0, 256, (10, 33)).astype(np.uint8)
    assert (op.read_png(filtered_png(image, [0, 1, 2, 3, 4] * 2)) == image).all()
    assert (op.read_png(filtered_png(image, [4, 3, 2, 1, 0] * 2)) == image).all()


@pytest.mark.parametrize("text", [None, "", "x", "é" * 288, "a" * 576, "a" * 577, "🦙\x00\n" * 50_000])
def test_round_trip(text):
    png = op.write_png(op.payload(text))
    assert op.read_png(png).tobytes() == plain_payload(text) and len(op.feature(op.read_png(png))) == 8


def test_damage_is_noticed():
    png = op.write_png(op.payload("some text"))
    for at in (3, 20, 60, len(png) - 2):
        with pytest.raises((ValueError, zlib.error)):
            op.read_png(png[:at] + bytes([png[at] ^ 1]) + png[at + 1:])
    for size in (0, 8, 30, len(png) - 1):
        with pytest.raises(ValueError):
            op.read_png(png[:size])


def test_feature_against_plain_transform():
    image = np.random.default_rng(2).integers(0, 256, (64, 96)).astype(np.uint8)
    small = image.reshape(32, 2, 32, 3).mean((1, 3))
    low = [sum(small[y, x] * np.cos(np.pi / 32 * (y + 0.5) * u) * np.cos(np.pi / 32 * (x + 0.5) * v) for y in range(32) for x in range(32))
           for u in range(8) for v in range(8)]
    bits = [x > np.median(low[1:]) for x in low]
    assert op.feature(image) == np.packbits(bits).tobytes()


def test_rows(documents):
    docs = documents([(1, "same"), (1, "same"), (2, None), (3, ""), (None, "x")], extra=["media", "payload", "feature", "n_bytes"])
    rows = op.read(op.store(docs)).collect()
    assert len(rows) == 5 and len({bytes(r.media) for r in rows if r.doc_id == 1}) == 1
    assert {bytes(r.payload) for r in rows if r.doc_id in (2, 3)} == {b"\xff" * 576}
    assert op.read(op.store(documents([]))).count() == 0
    assert op.read(op.store(docs).selectExpr("doc_id", "n_bytes", "cast(null as binary) as media")).first().feature is None
