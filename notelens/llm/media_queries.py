"""Query of operator 7."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelens.llm import media
from notelens.llm.registry import register
from notelens.llm.tables import table


@register("op7_media")
def op7_media(spark, sf_dir):
    found = media.read(media.store(table(spark, sf_dir, "documents")))
    return found.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("feature")).alias("feature"))
