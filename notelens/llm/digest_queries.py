"""Query of operator 4."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelens.llm import digests
from notelens.llm.registry import register
from notelens.llm.tables import table


@register("op4_fingerprints")
def op4_fingerprints(spark, sf_dir):
    return digests.with_next(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        "near_edited", "near_next")
