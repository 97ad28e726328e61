"""Query of operator 9."""

from __future__ import annotations

from notelens.llm import language
from notelens.llm.registry import register
from notelens.llm.tables import held_out, table


@register("op9_language")
def op9_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(~held_out()))
    return language.predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "switches")
