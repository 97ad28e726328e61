"""Inputs the queries run on, derived by Spark from the given tables (always whole tables).

The given documents carry no section headers, so ``notes`` puts header names in
front of lines by a fixed rule on document and line number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelens.functions import text as tx
from notelens.operators import vocabulary as vo
from notelens.operators.scale import first_k_in_group, stage, stage_by
from notelens.plans.registry import documents

HEADER_NAMES = [
    "Chief Complaint", "HISTORY", "Social History", "Family History", "HISTORY OF ILLNESS", "Physical Exam",
    "Lab Results", "Medications", "Allergies", "Assessment", "Discharge Plan", "Follow Up",
]
STOPS = ["the", "of", "and", "is", "it", "an", "le", "la", "les", "des", "der", "die", "das", "und", "el", "los"]
MIN_COUNT = 10
THRESHOLD = 0.001
WINDOW = 10


def _line_prefix(doc_id: Column, line_no: Column) -> Column:
    slot = (doc_id + line_no * 3) % 17
    letter = lambda n: F.char(F.lit(97) + n % 26)
    names = tx.words_array(HEADER_NAMES)
    return (
        F.when(slot < 12, F.concat(F.get(names, slot.cast("int")), F.lit(": ")))
        .when(slot == 12, F.concat(F.lit("Visit "), F.upper(letter(doc_id)), F.lit("x: ")))
        .when(slot == 13, F.concat(F.lit("Plan "), letter(doc_id), letter(F.floor(doc_id / 26)), F.lit(": ")))
        .otherwise(F.lit(""))
    )


def notes(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    lines = F.transform(
        F.split("text", "\n"), lambda line, i: F.concat(_line_prefix(F.col("doc_id"), i), line)
    )
    return docs.select("doc_id", F.col("source").alias("category"), F.array_join(lines, "\n").alias("text"))


def corpus_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the documents with some of them blanked, runs of blanks included."""
    docs = documents(spark, sf)
    line = F.posexplode(F.split("text", "\n")).alias("line_no", "line")
    blank = ((F.col("line_no") + F.col("doc_id")) % 5 == 4) | ((F.col("line_no") + F.col("doc_id")) % 11 >= 8)
    return docs.select("doc_id", line).withColumn("line", F.when(blank, F.lit(" ")).otherwise(F.col("line")))


def sections(spark: SparkSession, sf: str) -> DataFrame:
    return stage(vo.section_frequency(notes(spark, sf), MIN_COUNT), "sections")


def docs(spark: SparkSession, sf: str, sentences: bool = False, compat: bool = False) -> DataFrame:
    return vo.tokenize_notes(notes(spark, sf), sections(spark, sf), STOPS, sentences, compat)


def raw_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return vo.token_rows(docs(spark, sf))


def clean_tokens(spark: SparkSession, sf: str) -> DataFrame:
    raw = stage_by(raw_tokens(spark, sf), "doc_id", "pos", "tokens")
    counts = stage(vo.token_counts(raw), "token-counts")
    return stage_by(vo.subsample(raw, counts, MIN_COUNT, THRESHOLD), "doc_id", "pos", "clean-tokens")


def vocab(spark: SparkSession, sf: str, tokens: DataFrame | None = None) -> DataFrame:
    stream = clean_tokens(spark, sf) if tokens is None else tokens
    return stage(vo.build_vocabulary(stream), "vocab")


def ids(spark: SparkSession, sf: str) -> DataFrame:
    stream = clean_tokens(spark, sf)
    return vo.id_stream(stream, vocab(spark, sf, stream))


def frequent_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``(sf, pair, n)``: all pairs of words that occur five times, with their initials as short form."""
    words = documents(spark, sf).select(F.split(F.lower("text"), tx.SPACES).alias("w"))
    pairs = F.filter(
        tx.let(F.col("w"), lambda w: F.transform(w, lambda a, i: F.concat_ws(" ", a, F.get(w, i + 1)))),
        lambda p: p.rlike("^[a-z]+ [a-z]+$"),
    )
    counted = words.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    initials = F.upper(
        F.concat(F.substring("pair", 1, 1), F.substring(F.substring_index("pair", " ", -1), 1, 1))
    )
    return counted.where(F.col("n") >= 5).withColumn("sf", initials)


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """``dictionary(sf, lf)``: every frequent pair is in a long form; some share one by their digests, as synonyms."""
    pairs = frequent_pairs(spark, sf).withColumn("bucket", F.substring(F.md5(F.col("pair").cast("binary")), 1, 3))
    return pairs.groupBy("sf", "bucket").agg(F.array_join(F.array_sort(F.collect_list("pair")), ";").alias("lf")).select("sf", "lf")


def senses(spark: SparkSession, sf: str) -> DataFrame:
    """``senses(sf, lf_idx, lf, n)``: an inventory of the commonest pairs.

    The ten most frequent pairs of a short form make up to five long forms of
    one or two synonyms each.
    """
    frequent = frequent_pairs(spark, sf)
    top = first_k_in_group(frequent, ["sf"], [F.desc("n"), "pair"], 10)
    ranked = top.groupBy("sf").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), F.col("pair")))).alias("top")
    )
    lf = F.transform(
        F.slice("top", 1, 5),
        lambda p, i: F.struct(
            i.cast("int").alias("lf_idx"),
            F.concat_ws(";", p["pair"], F.get("top", i + 5)["pair"]).alias("lf"),
            (-(p["minus"] + F.coalesce(F.get("top", i + 5)["minus"], F.lit(0)))).cast("bigint").alias("n"),
        ),
    )
    return ranked.where(F.size("top") >= 2).select("sf", F.explode(lf).alias("s")).select("sf", "s.*")
