from pyspark.sql import functions as F

from notelens.operators import scale
from notelens.sources import files


def test_documents_over_split_ends(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scale, "ROWS_PER_TASK", 40)
    lines = [" " * (k % 3) if k % 7 == 6 or k % 31 > 28 else f"line {k} of é " + "x" * (k % 40) for k in range(900)]
    table = spark.createDataFrame(list(enumerate(lines)), "n long, line string").repartition(4)
    path = str(tmp_path / "corpus")
    files.write_lines(table, ["n"], path, files=1)
    assert len(list((tmp_path / "corpus").glob("part-*"))) == 1
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    got = files.read_lines(spark, path, split_bytes=2000)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert [r.line for r in got.orderBy("line_no").collect()] == lines
    documents = files.assemble_documents(got.withColumn("file", F.lit("f")), "file", "line_no").collect()
    want = [[]]
    for line in lines:
        want += [[line.strip()]] if not line.strip() else []
        want[-1] += [line.strip()] if line.strip() else []
    assert sorted(r.text for r in documents) == sorted(" ".join(w).strip() for w in want if any(w))


def test_a_file_is_read_in_splits(spark, tmp_path):
    table = spark.range(3000).select("id", F.format_string("%0100d", "id").alias("line"))
    path = str(tmp_path / "corpus")
    files.write_lines(table, ["id"], path, files=1)
    size = "spark.sql.files.maxPartitionBytes"
    usual = spark.conf.get(size)
    spark.conf.set(size, "65536")
    try:
        assert spark.read.text(path).rdd.getNumPartitions() >= 4
    finally:
        spark.conf.set(size, usual)
    assert files.read_lines(spark, path, split_bytes=65536).count() == 3000


def test_labelled_sentences_are_packed(spark, tmp_path):
    import __spark_entry__ as entry

    rows = [(f"S{k}", 'a "long" form|of two' if k % 3 else None, k, "", f"S{k} in a\ncontext") for k in range(20)]
    given = spark.createDataFrame(rows, "sf string, target_lf string, start_idx int, section string, context string")
    for how, end in ((None, ".csv"), ("gzip", ".csv.gz")):
        path = str(tmp_path / str(how))
        files.write_labelled(given, path, how) if how else files.write_labelled(given, path)
        assert all(f.name.endswith(end) for f in (tmp_path / str(how)).glob("part-*"))
        got = files.read_labelled(spark, path).select("sf", "target_lf", "start_idx", "context")
        assert sorted(map(tuple, got.collect())) == sorted((a, b, c, e) for a, b, c, _, e in rows if b)
    assert "gzip" in entry.queries()["s02_labelled_scan"].__code__.co_consts
