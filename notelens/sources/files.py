"""Reading and writing the file forms of a corpus: CSV, pipe-delimited, JSON, text, parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelens.functions import text as tx
from notelens.functions.hashing import uniform
from notelens.operators.scale import number_rows, running_total, stage

NOTE_SCHEMA = "doc_id LONG, category STRING, text STRING"
LABELLED_SCHEMA = "sf STRING, target_lf STRING, start_idx INT, section STRING, context STRING"


def read_notes_csv(spark: SparkSession, path: str) -> DataFrame:
    """Notes with quoted multi-line text; the schema is declared, never inferred."""
    return spark.read.schema(NOTE_SCHEMA).csv(path, header=True, multiLine=True, quote='"', escape='"')


def write_notes_csv(notes: DataFrame, path: str) -> None:
    notes.select("doc_id", "category", "text").write.csv(path, header=True, quote='"', escape='"', quoteAll=True)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-delimited labelled sentences; rows without a key column go.

    Quoted fields may hold pipes, line ends, and quotes written twice.
    """
    rows = spark.read.schema(LABELLED_SCHEMA).csv(path, sep="|", header=True, quote='"', escape='"', multiLine=True)
    return rows.na.drop(subset=["sf", "target_lf", "context"])


def write_labelled(rows: DataFrame, path: str, compression: str = "none") -> None:
    """Labelled sentences in the form that ``read_labelled`` reads."""
    columns = [c.split()[0] for c in LABELLED_SCHEMA.split(", ")]
    rows.select(*columns).write.csv(path, sep="|", header=True, quote='"', escape='"', quoteAll=True, compression=compression)


def write_lines(lines: DataFrame, order: Sequence[str], path: str, files: int) -> None:
    """Write the column ``line`` along ``order`` as text files, whose names ascend along it, too."""
    ranges = lines.repartitionByRange(files, *order).sortWithinPartitions(*order)
    ranges.select("line").write.option("lineSep", "\n").text(path)


def read_lines(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """``(line_no, line)``, written: the lines of all text files of a folder, numbered along file names and places.

    Files are read in splits of ``split_bytes`` (none: of the session's size), wherever a document is cut; a line belongs to the
    split it starts in, and the start of its split and its place there order it.
    """
    size = "spark.sql.files.maxPartitionBytes"
    usual = spark.conf.get(size)
    if split_bytes:
        spark.conf.set(size, str(split_bytes))
    try:
        rows = spark.read.option("lineSep", "\n").text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
        lines = stage(rows.select(
            "file_path", "file_block_start", F.monotonically_increasing_id().alias("n"), F.col("value").alias("line")), "lines")
    finally:
        spark.conf.set(size, usual)
    return stage(number_rows(lines, ["file_path", "file_block_start", "n"], "line_no").select("line_no", "line"), "lines")


def assemble_documents(lines: DataFrame, file: str, line_no: str, compat: bool = False) -> DataFrame:
    """Lines between blank lines, stripped and joined by one space; the id is the closing line.

    The running count of blank lines along ``(file, line_no)`` is taken in ranges, so one long file is no single task.
    ``lines`` should be staged. With ``compat`` the third blank line of a run
    closes an empty document.
    """
    stripped = F.regexp_replace("line", f"^{tx.SPACES}|{tx.SPACES}$", "")
    rows = lines.withColumn("_text", stripped)
    blank = (F.col("_text") == "").cast("int")
    numbered = running_total(rows, [file, line_no], blank, "_island")
    grouped = numbered.groupBy(file, "_island").agg(
        F.max(line_no).alias("closing"),
        F.array_sort(F.collect_list(F.when(F.col("_text") != "", F.struct(F.col(line_no).alias("at"), F.col("_text").alias("text"))))).alias("_lines"),
    )
    if compat:
        from pyspark.sql import Window

        order = Window.partitionBy(file).orderBy("_island")
        filled = F.size("_lines") > 0
        group = F.sum(filled.cast("int")).over(order)
        runs = grouped.withColumn("_group", group)
        place = F.row_number().over(Window.partitionBy(file, "_group").orderBy("_island"))
        is_first = (F.col("_group") > 0) & (F.size("_lines") > 0)
        empties = F.when(F.col("_group") > 0, place - 1).otherwise(place)
        grouped = runs.withColumn("_nth_blank", empties).where(is_first | ((F.col("_nth_blank") > 0) & (F.col("_nth_blank") % 2 == 0)))
    else:
        grouped = grouped.where(F.size("_lines") > 0)
    return grouped.select(file, "closing", F.array_join("_lines.text", " ").alias("text"))


def read_inventory(spark: SparkSession, path: str, one_object: bool = False) -> DataFrame:
    """``senses(sf, lf_idx, lf)`` from JSON objects ``{short form: [long forms]}``.

    A large inventory has an object on each line, and is read in parallel. With ``one_object`` a file is one object over
    any number of lines, which is one row; that is the form for small files.
    """
    raw = spark.read.text(path, wholetext=one_object)
    parsed = F.from_json("value", T.MapType(T.StringType(), T.ArrayType(T.StringType())))
    return raw.select(F.explode(parsed).alias("sf", "lfs")).select("sf", F.posexplode("lfs").alias("lf_idx", "lf"))


def write_inventory(senses: DataFrame, path: str) -> None:
    """An object on each line, one for each short form."""
    per_sf = senses.groupBy("sf").agg(F.array_sort(F.collect_list(F.struct("lf_idx", "lf"))).alias("l"))
    per_sf.select(F.to_json(F.map_from_arrays(F.array("sf"), F.array(F.col("l.lf")))).alias("value")).write.text(path)


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """One word per line, trimmed, without repeats."""
    word = F.regexp_replace("value", f"^{tx.SPACES}|{tx.SPACES}$", "").alias("word")
    return spark.read.text(path).select(word).where(F.col("word") != "").distinct()


def read_parts(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All part files of a folder as one table."""
    return spark.read.schema(schema).parquet(folder)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).save(path)


def nested_marginals(counts: DataFrame) -> DataFrame:
    """``(lf, json)``: one JSON object per sense with its metadata names, counts and shares."""
    rows = F.array_sort(F.collect_list(F.struct("metadata", "n", "p"))).alias("rows")
    packed = counts.groupBy("lf").agg(rows)
    return packed.select("lf", F.to_json(F.struct(
        F.col("rows.metadata").alias("name"), F.col("rows.n").alias("count"), F.col("rows.p").alias("p"))).alias("json"))


def write_sentences(sentences: DataFrame, path: str, per_file: int = 1_000_000) -> None:
    """One sentence per line, a bounded number of lines per file; an existing folder is replaced."""
    sentences.select("sentence").write.mode("overwrite").option("maxRecordsPerFile", per_file).text(path)


def write_by_key(df: DataFrame, key: str, columns: list[str], path: str) -> None:
    """One folder per key value, holding the chosen columns only."""
    df.select(key, *columns).write.partitionBy(key).parquet(path)


def sample_rows(df: DataFrame, keys: list[str], n: int, seed: int = 1992) -> DataFrame:
    """Exactly ``n`` rows without replacement, the same ones for a seed (top-n by hash)."""
    return df.withColumn("_u", uniform(*keys, seed=seed)).orderBy("_u", *keys).limit(n).drop("_u")
