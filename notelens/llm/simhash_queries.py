"""Query of operator 5."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelens.llm import simhash
from notelens.llm.registry import register
from notelens.llm.tables import table


@register("op5_simhash")
def op5_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lower(F.lpad(F.hex("point"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")
