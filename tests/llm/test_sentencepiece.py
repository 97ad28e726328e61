import hashlib

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import sentencepiece  # noqa: E402
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from notelens.llm import sentencepiece_bpe as op  # noqa: E402
from notelens.llm.token_queries import digests, op1_sentencepiece  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
CODEC = op.Codec(open(PATH, "rb").read())

TEXTS = [
    None, "", " ", "  a  b ", "a\n\tb", "▁x", " \n \n", "ﬁ ①", "a\x00b", "日本語 の", "<s> </s> <unk> <0x41>", "🦙🦙 x", "the " * 30_000,
    "e" * 50_000, " " * 999, "same", "same",
]


def test_codec_equals_library():
    for text in TEXTS[1:]:
        assert CODEC.encode(text) == LIBRARY.encode(text)
        assert CODEC.convert(text)[1] == LIBRARY.decode(LIBRARY.encode(text)) == CODEC.decode(CODEC.encode(text))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([p.replace("▁", " ") for p in CODEC.pieces[259:]]), st.text(" \n▁aeinrst.é日", max_size=12),
                          st.text(max_size=4)), max_size=8))
def test_codec_equals_library_on_mixed_pieces(parts):
    text = "".join(parts)
    if any("\ud800" <= c <= "\udfff" for c in text):
        return
    ids = LIBRARY.encode(text)
    assert CODEC.encode(text) == ids and CODEC.decode(ids) == LIBRARY.decode(ids) == CODEC.convert(text)[1]


def test_small_caches_change_nothing(monkeypatch):
    monkeypatch.setattr(op, "CACHED_SEGMENTS", 3)
    monkeypatch.setattr(op, "CACHED_PAIRS", 3)
    codec = op.Codec(open(PATH, "rb").read())
    text = "some words come again and some words do not come again"
    assert codec.encode(text) == LIBRARY.encode(text) and codec.convert(text)[1] == text


def test_rows(documents):
    docs = documents(TEXTS, extra=["ids", "decoded"])
    got = {r.doc_id: r for r in op.encode(docs, PATH).collect()}
    for k, text in enumerate(TEXTS):
        assert got[k].ids == LIBRARY.encode(text or "") and got[k].decoded == LIBRARY.decode(got[k].ids)
    back = {r.doc_id: r.decoded for r in op.decode(op.encode(docs, PATH), PATH).collect()}
    assert back == {k: r.decoded for k, r in got.items()}


def test_empty_table(documents):
    assert op.encode(documents([]), PATH).count() == 0


def test_query_equals_library(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op1_sentencepiece(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = LIBRARY.encode(d.text or "")
        assert got[d.doc_id].n_tokens == len(ids)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_digest_of_nothing(documents):
    row = digests(op.encode(documents([None]), PATH)).first()
    assert row.n_tokens == 0 and row.ids_sha256 == row.decoded_sha256 == hashlib.sha256(b"").hexdigest()
