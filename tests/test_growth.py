"""What a row of an intermediate table carries, and how many tasks make many rows of few."""

import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from notelens.operators import examples as ex
from notelens.operators import labelled as la
from notelens.operators import mining as mi
from notelens.operators import scale
from notelens.operators import scoring as sc


def test_places_carry_no_whole_text(spark):
    words = spark.createDataFrame([(1, [f"w{i}" for i in range(3000)])], "doc_id long, words array<string>")
    for kinds in ([mi.BREAK], [mi.LONE], [mi.BREAK, mi.LONE, mi.PAIR]):
        got = mi.anchor_places(words, kinds, 3).agg(F.max(F.size("words")), F.max(F.col("at") - F.col("low")), F.max("at")).first()
        assert got[0] == 5 and got[1] == 2 and got[2] >= 2998


def test_hits_of_entries_of_all_lengths(spark):
    docs = spark.createDataFrame([(1, "a b-c d e a b"), (2, "b c d")], "doc_id long, text string")
    entries = spark.createDataFrame([("ab", "a b", 2), ("c", "c", 1), ("cde", "c d e", 3), ("bc", "b-c", 1)], "lf string, phrase string, n_words int")
    entries = scale.stage(entries.withColumn("priority", F.struct((-F.col("n_words")).alias("longest"), F.lit(0).alias("place"))), "entries")
    hits = {(r.doc_id, r.lf, r["at"]) for r in mi.scan(docs, entries).collect()}
    assert hits == {(1, "ab", 0), (1, "ab", 4), (1, "c", 1), (1, "cde", 1), (1, "bc", 1), (2, "c", 1)}


def test_sequences_of_pieces_are_not_taken_apart(spark):
    rows = [(1, p, p, i, "section" if i == 9 else "token", 9) for p, i in enumerate([9, 1, 2, 3, 4])]
    filled = spark.createDataFrame(rows, "doc_id long, pos long, gpos long, id long, kind string, metadata_id long")
    pieces = scale.stage(spark.createDataFrame([(1, [11, 12]), (2, [21]), (3, [31]), (9, [91])], "id long, pieces array<long>"), "pieces")
    got = ex.joint_sequences(filled, pieces, pieces, 1, 101, 102)
    assert not [c for c in got.collect() if c.ids and 41 in c.ids]
    ids = {r.gpos: r.ids and [x for x in r.ids if x] for r in got.collect()}
    assert ids[1] == [101, 11, 12, 21, 102, 91, 11, 12, 102] and ids[2] == [101, 11, 12, 21, 31, 102, 91, 21, 102] and ids[4] is None
    assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_wide_rows_are_looked_up_in_parts(spark, monkeypatch):
    right = scale.stage(spark.range(60).select("id", F.array_repeat(F.col("id").cast("double"), 16).alias("vec")), "wide")
    left = spark.range(200).select("id", (F.col("id") % 70).alias("a"), (F.col("id") * 7 % 70).alias("b"))
    want = [(i, i % 70, i * 7 % 70, *[float(k) if k < 60 else None for k in (i % 70, i * 7 % 70)]) for i in range(200)]
    show = lambda df: sorted(map(tuple, df.select("id", "a", "b", F.get("_a.vec", F.lit(3)), F.get("_b.vec", F.lit(3))).collect()))
    assert show(scale.wide_lookup(left, right, {"_a": "a", "_b": "b"}, ["vec"])) == want
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 3000)
    cut = scale.wide_lookup(left, right, {"_a": "a", "_b": "b"}, ["vec"])
    assert show(cut) == want and "hashpartitioning" not in cut._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 300)
    assert scale.wide_lookup(left, right, {"_a": "a"}, ["vec"]) is None


def test_cells_of_bad_vectors_fail(spark):
    grams = spark.createDataFrame([(1, 0, [1, 2])], "center_id long, metadata_id long, context_ids array<long>")
    for bad in (None, [1.0], [1.0, None]):
        vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, bad)], "id long, vec array<double>")
        with pytest.raises(PySparkException):
            sc.cell_gaussians(grams, vectors).collect()


def test_draws_are_dealt_to_tasks(spark, monkeypatch):
    counts = scale.stage(spark.range(4000).select((F.col("id") % 40).alias("id"), F.floor(F.col("id") / 40).alias("metadata_id"), F.lit(3).cast("bigint").alias("n")), "counts")
    want = sorted(map(tuple, ex.metadata_samples(counts, 0, 101).collect()))
    assert len(want) == 40 * 1000 * 3
    monkeypatch.setattr(ex, "ROWS_PER_TASK", 5000)
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 100)
    got = ex.metadata_samples(counts, 0, 101)
    assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan and ", 24), REPARTITION_BY_NUM" in plan and "BroadcastHashJoin" not in plan


def test_first_of_each_groups_the_rest_only(spark):
    rows = spark.createDataFrame([(2, "x", "k"), (1, "y", "k"), (3, "z", None)], "row_idx long, v string, k string")
    got = la.first_of_each(rows, ["k"], "row_idx")
    assert got.columns == rows.columns and sorted(map(tuple, got.collect())) == [(1, "y", "k"), (3, "z", None)]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_of_short_entries_run_no_lambda_per_word(spark):
    words = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["d"]), (3, [])], "doc_id long, words array<string>")
    for longest in (1, 2, 3, 4, 5):
        got = mi.anchor_places(words, [mi.LONE], longest)
        assert ("lambda" in got._jdf.queryExecution().analyzed().toString().split("Generate")[-1]) == (longest > mi.ZIPPED)
        near = {(r.doc_id, r["at"]): [r.words[r["at"] - r.low + k] for k in range(longest) if r["at"] - r.low + k < len(r.words)] for r in got.collect()}
        assert sorted(near) == [(1, 0), (1, 1), (1, 2), (2, 0)]
        assert [w for w in near[1, 1] if w] == ["b", "c"][:longest] and near[2, 0][0] == "d"


def test_large_dictionary_meets_places_without_a_shuffle(spark, monkeypatch):
    docs = spark.createDataFrame([(d, " ".join(f"w{(d * 7 + i) % 40}" for i in range(30))) for d in range(20)], "doc_id long, text string")
    senses = spark.createDataFrame([(f"w{i} w{i + 1};w{i} w{i + 2}",) for i in range(30)] + [("w3 w4 w5;w9",)], "lf string")
    entries = scale.stage(mi.long_form_entries(senses), "entries")
    show = lambda df: sorted((r.doc_id, r.lf, r["at"], r.n_words, r.first, r.last) for r in df.collect())
    want = show(mi.scan(docs, entries))
    assert len(want) > 400
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 2500)
    parts = mi.scan(docs, entries)
    assert show(parts) == want and "hashpartitioning" not in _plan(parts)
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 200)
    assert show(mi.scan(docs, entries)) == want


def test_hits_carry_numbers_of_long_forms(spark, monkeypatch):
    senses = spark.createDataFrame([("a b;c d",), ("e f",), ("a b;c d",)], "lf string")
    entries, forms = mi.with_form_numbers(scale.stage(mi.long_form_entries(senses), "entries"))
    assert dict(entries.dtypes)["lf"] == "bigint" and entries.count() == 3
    assert sorted(map(tuple, forms.select("id", "lf").collect())) == [(0, "a b;c d"), (1, "e f")]
    rows = spark.createDataFrame([(7, 1, "x"), (8, 0, "y")], "doc_id long, lf long, v string")
    want = [(7, "e f", "x"), (8, "a b;c d", "y")]
    assert sorted(map(tuple, mi.name_forms(rows, forms).collect())) == want
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 4)
    named = mi.name_forms(rows, forms)
    assert named.columns == rows.columns and sorted(map(tuple, named.collect())) == want


def test_words_of_a_hit_are_cut_into_parts_once(spark):
    docs = spark.createDataFrame([(1, "c", "u (a b) v")], "doc_id long, category string, text string")
    chosen = spark.createDataFrame([(1, "a b", [(1, 1, 2, 1)])], "doc_id long, lf string, kept array<struct<at:int,first:int,n_words:int,last:int>>")
    got = mi.word_contexts(docs, chosen)
    assert got.select("lf_match", "context").first()[:] == ("a b", "u TARGETWORD v")
    assert got._jdf.queryExecution().analyzed().toString().split("Join")[0].count("regexp_extract_all") <= 4


def test_masks_are_drawn_a_batch_at_once(spark):
    """The draws are those of ``uniform``, without a lambda that hashes slot by slot."""
    rows = [(5, [1, 2, None]), (None, [4, 5]), (6, None), (7, []), (8, list(range(1, 130))), (10**12, [3] * 12)]
    given = spark.createDataFrame(rows, "gpos long, ids array<long>")
    draw = lambda key, i: int(hashlib.md5(f"{'' if key is None else f'{key}:'}{i}:9".encode()).hexdigest()[:13], 16) / 2.0**52
    got = given.select("gpos", ex.mask_slots(F.col("ids"), F.col("gpos"), 0.2, 9).alias("ids"))
    assert "lambda" not in _plan(got) and "md5" not in _plan(got)
    assert list(map(tuple, got.collect())) == [(k, x and [0 if draw(k, i) < 0.2 else y for i, y in enumerate(x)]) for k, x in rows]


def test_cells_of_vectors_need_no_row_per_slot(spark, monkeypatch):
    rows = [(c, m, [None if i % 5 == 4 else (c or 0) * i % 7 for i in range(n)]) for c in (1, 2, None) for m in (0, None) for n in (0, 3, 11)]
    grams = spark.createDataFrame([*rows, *rows, (1, 0, None)], "center_id long, metadata_id long, context_ids array<long>")
    vectors = spark.createDataFrame([(i, [i * 0.5, 1.0 - i]) for i in (0, 1, 2, 5)] + [(2, [3.0, 3.0])], "id long, vec array<double>")
    show = lambda df: sorted((str(r[:2]), [round(x, 9) for x in r[2] + r[3]], r[4]) for r in df.collect())
    monkeypatch.setattr(sc, "SLOTS_AT_ONCE", 4)
    summed = sc.cell_gaussians(grams, vectors)
    assert "Generate" not in _plan(summed)
    monkeypatch.setattr(sc, "MATRIX_BYTES", -1)
    assert show(summed) == show(sc.cell_gaussians(grams, vectors)) != []


def _metadata(path):
    import glob

    import pyarrow.parquet as pq

    return [pq.ParquetFile(f).metadata.row_group(0) for f in glob.glob(f"{path}/*.parquet")]


def test_stage_tables_are_packed(spark):
    rows = spark.range(4000).select((F.col("id") % 40).alias("doc_id"), F.col("id").alias("pos"), F.concat(F.lit("w"), F.col("id") % 7).alias("token"))
    staged, by_doc = scale.stage(rows, "packed"), scale.stage_by(rows, "doc_id", "pos", "packed")
    assert sorted(map(tuple, staged.collect())) == sorted(map(tuple, by_doc.collect())) == sorted(map(tuple, rows.collect()))
    for table, at in ((staged, None), (by_doc, 1)):
        for group in _metadata(table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]):
            assert {group.column(k).compression for k in range(3)} == {"ZSTD"}
            assert at is None or group.column(at).encodings == ("DELTA_BINARY_PACKED",)


def test_words_of_a_piece_move_as_one_text(spark):
    from notelens.operators import vocabulary as vo

    notes = spark.createDataFrame([(1, "a", "Plan Notes: one\u0001two  three.\nmore"), (1, "a", "Plan Notes: zero"), (2, None, "four"), (3, "b", None), (4, "c", "")], "doc_id long, category string, text string")
    sections = scale.stage(spark.createDataFrame([("PLAN NOTES", 3)], "section string, count long"), "sections")
    docs = vo.tokenize_notes(notes, sections)
    assert "array_join(" in _plan(docs).split("hashpartitioning(doc_id")[1]  # below the exchange
    got = {r.doc_id: r.tokens for r in docs.collect()}
    assert got == {1: ["document=A", "header=PLANNOTES", "header=PLANNOTES", "one\u0001two", "three", "more", "zero"], 2: [None, "four"], 3: ["document=B"], 4: ["document=C"]}


def test_shuffled_rows_move_without_their_draws(spark, monkeypatch):
    rows = spark.range(3000).select(F.col("id").alias("gpos"))
    show = lambda df: sorted(map(tuple, df.select("batch", "gpos").collect()))
    want = show(ex.shuffled_batches(rows, ["gpos"], 64))
    draw = lambda k: int(hashlib.md5(f"{k}:0".encode()).hexdigest()[:13], 16)
    assert want == sorted((i // 64, k) for i, k in enumerate(sorted(range(3000), key=draw)[: 3000 // 64 * 64]))
    monkeypatch.setattr(ex, "ROWS_PER_TASK", 200)
    staged = []
    monkeypatch.setattr(ex, "stage", lambda df, name: staged.append(df.columns) or scale.stage(df, name))
    assert show(ex.shuffled_batches(rows, ["gpos"], 64)) == want and staged == [["gpos"]]
    same = rows.select(F.lit(1).alias("gpos"), F.col("gpos").alias("other"))
    got = [tuple(r) for r in ex.shuffled_batches(same, ["gpos"], 64).select("batch", "other").collect()]
    assert sorted(b for b, _ in got) == sorted(i // 64 for i in range(3000 // 64 * 64)) and len({o for _, o in got}) == len(got)


def test_texts_meet_their_hits_before_they_are_cut(spark):
    docs = spark.createDataFrame([(1, "x", "a b c d"), (2, "y", "no")], "doc_id long, category string, text string")
    entries = scale.stage(mi.long_form_entries(spark.createDataFrame([("b c",)], "lf string")), "entries")
    cut = mi.word_contexts(docs, mi.choose(mi.scan(docs, entries)), 1)
    assert [tuple(r) for r in cut.select("doc_id", "category", "lf_match", "context").collect()] == [(1, "x", "b c", "a TARGETWORD d")]
    side = cut._jdf.queryExecution().optimizedPlan().toString().split("Join Inner, (doc_id")[1].split("Aggregate")[0]
    assert "text#" in side and "split(" not in side
