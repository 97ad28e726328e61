from collections import Counter

import numpy as np
import pytest
import sentencepiece

cp = pytest.importorskip("corpus_pipeline")
from notelens.llm import mixing, quality, simhash  # noqa: E402
from notelens.llm.tables import DOCUMENT_COLUMNS  # noqa: E402

SF = "/root/testdata/sf0.001"


def plain_windows(rows, width=50):
    """{doc_id: kept words} by the definition."""
    smallest, words = {}, {i: (t or "").encode().split() for i, t in rows}
    for i, w in words.items():
        for k in range(len(w) - width + 1):
            key = tuple(w[k:k + width])
            smallest[key] = min(i, smallest.get(key, i))
    kept = {}
    for i, w in words.items():
        gone = {p for k in range(len(w) - width + 1) if smallest[tuple(w[k:k + width])] < i for p in range(k, k + width)}
        kept[i] = (len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode())
    return kept


def plain_groups(rows):
    points = [int.from_bytes(simhash.fingerprint(t), "big") for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if (points[a] ^ points[b]).bit_count() <= 4 and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {min(rows[k][0] for k in range(len(rows)) if label[k] == v) for v in set(label)}


def test_stages_equal_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in cp.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        kept[name] = (before.collect(), docs.collect())
        if name != "tokens":
            assert docs.columns == list(DOCUMENT_COLUMNS)
    texts = lambda rows: {r.doc_id: r.text for r in rows}

    before, after = kept["quality"]
    model = quality.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    good = model.score(np.array([quality.statistics(r.text) for r in before])) >= 0.3
    assert texts(after) == {r.doc_id: r.text for r, g in zip(before, good) if g} and len(after) < len(before)

    before, after = kept["near_duplicates"]
    assert set(texts(after)) == plain_groups([(r.doc_id, r.text) for r in before]) and len(after) == len(texts(after))

    before, after = kept["substrings"]
    want = plain_windows([(r.doc_id, r.text) for r in before])
    own = texts(before)
    assert texts(after) == {i: (t if n else own[i]) for i, (n, t) in want.items()}
    assert all(r.n_chars == len(r.text) for r in after if want[r.doc_id][0])

    before, after = kept["mixing"]
    counts = Counter(r.doc_id for r in after)
    assert set(counts) == set(texts(before)) and all(own == texts(before)[i] for i, own in texts(after).items())
    rates = {r.doc_id: r.rate for r in mixing.mix(*[spark.createDataFrame(before)] * 2, least=1.0, keep_all=True).collect()}
    assert all(int(rates[i]) <= n <= int(rates[i]) + 1 for i, n in counts.items())

    before, after = kept["tokens"]
    library = sentencepiece.SentencePieceProcessor(model_file=cp.public_tokenizers.path("piece_bpe_32k.model"))
    assert Counter((r.doc_id, r.n_tokens) for r in after) == Counter((r.doc_id, len(library.encode(r.text or ""))) for r in before)


def test_odd_rows_pass_all_stages(spark, documents, tmp_path):
    long = " ".join(f"word{k}" for k in range(20_000))
    docs = documents([(1, None), (2, ""), (3, long), (3, long), (4, long + " more"), (None, "a few words of text"), (5, "x" * 100_000)],
                     extra=["score", "component_id", "kept", "rate", "_row"])
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_empty_table(spark, documents, tmp_path):
    docs = documents([])
    for name, stage in cp.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() == 0


def test_run_is_registered(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is cp.run and "pipeline" not in entry.oracle_sql()
    assert cp.run(spark, SF).count() > 0
