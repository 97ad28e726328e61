"""Query of operator 1."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from notelens.llm import sentencepiece_bpe
from notelens.llm.registry import register
from notelens.llm.tables import table


def digests(coded):
    """Number of ids and digests of the ids and of the decoded text."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@register("op1_sentencepiece")
def op1_sentencepiece(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return digests(sentencepiece_bpe.encode(docs, public_tokenizers.path("piece_bpe_32k.model")))
