from notelens.operators import examples as ex
from notelens.operators import vocabulary as vo
from notelens.operators import windows as wi
from notelens.operators.scale import stage, stage_by
from notelens.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(doc_id")


def test_one_exchange_by_document_from_notes_to_examples(spark):
    tokens = fx.raw_tokens(spark, SF)
    assert exchanges(tokens) == 1
    raw = stage_by(tokens, "doc_id", "pos", "tokens")
    counts = stage(vo.token_counts(raw), "counts")
    clean = vo.subsample(raw, counts, fx.MIN_COUNT, fx.THRESHOLD)
    assert exchanges(clean) == 0
    stream = stage_by(clean, "doc_id", "pos", "clean")
    ids = vo.id_stream(stream, fx.vocab(spark, SF, stream))
    grams = ex.skip_grams(wi.fill_metadata(ids), fx.WINDOW)
    assert exchanges(grams) == 0
    # the same rows as from tables without buckets
    plain = ex.skip_grams(wi.fill_metadata(vo.id_stream(stage(stream, "plain"), fx.vocab(spark, SF, stream))), fx.WINDOW)
    assert exchanges(plain) > 0
    assert sorted(map(str, grams.collect())) == sorted(map(str, plain.collect()))


def test_written_buckets_hold_all_rows(spark):
    rows = spark.range(500).selectExpr("id % 37 as doc_id", "id as pos").repartition(5)
    table = stage_by(rows, "doc_id", "pos", "odd-name")
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, rows.collect()))
    assert stage_by(rows.limit(0), "doc_id", "pos", "none").count() == 0
