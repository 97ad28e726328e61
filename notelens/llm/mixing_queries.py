"""Query of operator 8: languages, learned from the labelled documents, mixed to shares smoothed by the power 0.7."""

from __future__ import annotations

from notelens.llm import mixing
from notelens.llm.registry import register
from notelens.llm.tables import table


@register("op8_mixing")
def op8_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, docs)
