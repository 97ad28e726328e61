"""Query of operator 3."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelens.llm import quality
from notelens.llm.registry import register
from notelens.llm.tables import held_out, table


@register("op3_quality")
def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))
