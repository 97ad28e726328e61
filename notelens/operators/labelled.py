"""Preparing a hand-labelled set: inventory, canonical senses, validity, section mapping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notelens.functions import text as tx
from notelens.functions.hashing import uniform
from notelens.operators.scale import number_rows, sized, stage
from notelens.operators.windows import nth_position, occurrence_ordinal, window_around

# Labels that mean "no usable sense".
UNUSABLE_MARKS = ["UNSURED SENSE", "MISTAKE", "GENERAL ENGLISH", "NAME"]
# Senses and short forms left out, and senses renamed, in the labelled set.
SENSE_BLACKLIST = [
    "type A, type B",
    "American Society of Anaesthesiologists;American Society of Anesthesiologists",
    "California",
    "Iowa",
    "Fairview Southdale Hospital",
    "Los Angeles",
    "Louisiana;louisiana;Louisiana (geographic location)",
    "physician associates",
    "right",
]
SHORT_FORM_BLACKLIST = ["C3", "C4", "T1", "T2", "T3", "T4"]
SENSE_RENAMES = {"gutta": "guttae"}
# End of fixed values.


def parse_inventory(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Long forms, the last short form of each long form, and numbered senses per short form.

    ``rows(row_idx, sf, lf)``; an inventory holds few long forms per short form.
    """
    rows = rows.na.drop(subset=["sf", "lf"])
    lfs = rows.select("lf").distinct()
    lf_sf = rows.groupBy("lf").agg(F.max_by("sf", "row_idx").alias("sf"))
    order = Window.partitionBy("sf").orderBy("lf")
    senses = rows.select("sf", "lf").distinct().withColumn("lf_idx", F.row_number().over(order) - 1)
    return lfs, lf_sf, senses


def synonyms(senses: DataFrame) -> DataFrame:
    """``(sf, synonym, sense, place)``: lower-cased synonyms, the first sense of a short form first."""
    exploded = senses.select("sf", "lf", F.explode(F.split(F.lower("lf"), ";")).alias("synonym"))
    return exploded.groupBy("sf", "synonym").agg(F.min("lf").alias("sense"))


def canonical_sense(labels: DataFrame, senses: DataFrame) -> DataFrame:
    """Add ``target_lf_sense``; rows whose label names no usable sense go.

    A ``:SF`` suffix moves the label to that short form if the inventory has
    it. A label equal to a synonym becomes the whole sense, others stay.
    """
    label = F.col("target_lf")
    bad = label.contains(UNUSABLE_MARKS[0])
    for mark in UNUSABLE_MARKS[1:]:
        bad = bad | label.contains(mark)
    parts = F.filter(F.split(F.regexp_replace(label, r":([a-zA-Z]+)", f"{tx.GUARD}$1{tx.GUARD}"), tx.GUARD), lambda p: p != "")
    table = sized(synonyms(senses))
    known = sized(senses.select(F.col("sf").alias("proposed")).distinct().withColumn("known", F.lit(True)))
    rows = (
        labels.where(~bad).withColumn("_parts", parts)
        .withColumn("stripped", F.get("_parts", 0))
        .withColumn("proposed", F.when(F.size("_parts") == 1, F.col("sf")).otherwise(F.upper(F.get("_parts", 1))))
        .join(known, "proposed", "left")
        .withColumn("_sf", F.when(F.col("known"), F.col("proposed")).otherwise(F.col("sf")))
        .withColumn("_low", F.lower("stripped"))
    )
    found = rows.join(table.select(F.col("sf").alias("_sf"), F.col("synonym").alias("_low"), "sense"), ["_sf", "_low"], "left")
    return found.withColumn("target_lf_sense", F.coalesce("sense", "stripped")).drop(
        "_parts", "stripped", "proposed", "known", "_sf", "_low", "sense")


def remap_senses(rows: DataFrame, renames: dict[str, str], sense_blacklist: Sequence[str], sf_blacklist: Sequence[str]) -> DataFrame:
    """Drop listed short forms and senses, then rename senses."""
    kept = rows.where(~F.col("sf").isin(list(sf_blacklist) or [""]) & ~F.col("target_lf_sense").isin(list(sense_blacklist) or [""]))
    if not renames:
        return kept
    table = F.create_map(*[F.lit(v) for pair in renames.items() for v in pair])
    return kept.withColumn("target_lf_sense", F.coalesce(F.try_element_at(table, F.col("target_lf_sense")), F.col("target_lf_sense")))


def without_self_named(rows: DataFrame) -> DataFrame:
    """Drop rows whose short form is a word of its own long form."""
    return rows.where(~F.array_contains(tx.split_spaces(F.lower("target_lf")), F.lower("sf")))


def _once(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """``rows`` with ``value``, worked out once: a test of a plain column moves ahead of it and works it out again."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def locate(rows: DataFrame) -> DataFrame:
    """Keep rows whose offset is a whole-word match with a space close behind; add its ordinal."""
    near = F.substring(F.col("context"), F.col("start_idx") + F.length("sf") + 1, F.lit(2))
    ordinal = occurrence_ordinal(F.col("context"), F.col("sf"), F.col("start_idx"))
    return _once(rows.where(near.contains(" ")), ordinal, "ordinal").where("ordinal is not null")


def first_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of every key, for keys with any number of copies."""
    rest = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.min_by(rest, order).alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def with_several_senses(rows: DataFrame) -> DataFrame:
    """Drop short forms with one sense left."""
    ends = rows.groupBy("sf").agg(F.min("target_lf_sense").alias("low"), F.max("target_lf_sense").alias("high"))
    return rows.join(sized(ends.where(F.col("low") != F.col("high")).select("sf")), "sf", "left_semi")


def number_senses(rows: DataFrame) -> DataFrame:
    """Ordinal of the sense among the sorted distinct senses of its short form."""
    order = Window.partitionBy("sf").orderBy("target_lf_sense")
    senses = rows.select("sf", "target_lf_sense").distinct().withColumn("target_lf_idx", F.row_number().over(order) - 1)
    return rows.join(sized(senses), ["sf", "target_lf_sense"])


def map_sections(rows: DataFrame, sections: DataFrame, mapping: DataFrame) -> DataFrame:
    """Add ``section_mapped``: padding for none, a known header, else the mapped one; anything else fails."""
    name = F.upper(F.btrim(F.btrim(F.regexp_replace("section", tx.SPACES, " "), F.lit(tx.PUNCTUATION))))
    known = sized(sections.select(F.col("section").alias("_name"), F.lit(True).alias("_known")))
    mapped = sized(mapping.select(F.col("source").alias("_name"), F.col("target").alias("_target"), F.lit(True).alias("_listed")))
    both = rows.withColumn("_name", name).join(known, "_name", "left").join(mapped, "_name", "left")
    empty = F.col("section").isNull() | (F.col("section") == "")
    out = (
        F.when(empty, F.lit(tx.PAD)).when(F.col("_known"), tx.section_token(F.col("_name")))
        .when(F.col("_listed") & (F.coalesce("_target", F.lit("")) == ""), F.lit(tx.PAD))
        .when(F.col("_listed"), tx.section_token(F.col("_target")))
        .otherwise(F.raise_error(F.concat(F.lit("section without mapping: "), F.col("_name"))).cast("string"))
    )
    return both.withColumn("section_mapped", out).drop("_name", "_known", "_target", "_listed")


def map_sections_or_keep(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Add ``section_mapped``: padding for none, the mapped header, else the section itself."""
    table = sized(mapping.select(F.col("source").alias("section"), F.col("target").alias("_target")))
    empty = F.col("section").isNull() | (F.col("section") == "")
    out = F.when(empty, F.lit(tx.PAD)).otherwise(F.coalesce("_target", "section"))
    return rows.join(table, "section", "left").withColumn("section_mapped", out).drop("_target")


def restrict_to_short_forms(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of the short forms that occur in ``other``."""
    return rows.join(sized(other.select("sf").distinct()), "sf", "left_semi")


def split_by_share(rows: DataFrame, keys: list[str], train_share: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Hash split into train and test; a share of 0 or 1 gives all rows to both."""
    if train_share in (0.0, 1.0):
        return rows, rows
    u = uniform(*keys, seed=seed)
    return rows.where(u < train_share), rows.where(u >= train_share)


def prepare_labelled(rows: DataFrame, senses: DataFrame, window: int = 10, blacklist: Sequence[str] = ()) -> DataFrame:
    """From labelled sentences ``(row_idx, sf, target_lf, start_idx, context)`` to a ready example table."""
    rows = rows.na.drop(subset=["sf", "target_lf", "context"])
    rows = remap_senses(canonical_sense(without_self_named(rows), senses), SENSE_RENAMES, SENSE_BLACKLIST, SHORT_FORM_BLACKLIST)
    tokens = _once(locate(rows), tx.eval_tokenize(F.col("context"), blacklist), "tokens")
    placed = _once(tokens, nth_position(F.col("tokens"), F.lower("sf"), F.col("ordinal")), "target_at").where("target_at is not null")
    cut = placed.withColumn("tokenized_context", F.array_join("tokens", " ")).withColumn(
        "trimmed_tokens", F.array_join(window_around(F.col("tokens"), F.col("target_at"), window, with_target=True), " ")
    ).drop("tokens")
    unique = stage(first_of_each(cut, ["target_lf", "tokenized_context"], "row_idx"), "labelled")
    done = number_senses(with_several_senses(unique)).withColumnRenamed("row_idx", "_source")
    return number_rows(stage(done, "labelled-done"), ["_source"], "row_idx").drop("_source")
