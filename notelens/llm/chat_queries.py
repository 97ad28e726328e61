"""Query of operator 6."""

from __future__ import annotations

from pyspark.sql import functions as F

from notelens.llm import chat
from notelens.llm.registry import register
from notelens.llm.tables import table


@register("op6_chat_repair")
def op6_chat_repair(spark, sf_dir):
    found = chat.repair(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "part", "n_turns", "n_messages", F.array_join("steps", " ").alias("steps"), "cost", "rendered")
