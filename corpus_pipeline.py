"""A training-data pipeline of the numbered operators: each stage reads what its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``. All
but the last return the columns of ``documents``.

* quality: rejected documents go. Nulls and empty texts are scored like any other.
* near_duplicates: of each group the document with the smallest id stays, once.
* substrings: words of repeated windows go from the text, what is left is joined by
  spaces and ``n_chars`` follows; a text that lost nothing stays as it is, a null stays
  null, and a document that lost all its words stays with an empty text.
* mixing: documents come as often as their copies say; no domain shrinks and no
  document goes. Domains are the languages of the documents that name one.
* tokens: ids of every row, with digests, and the text read back from them.

Extra columns of ``docs`` are left out. Empty tables give empty tables.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelens.llm import mixing, quality, sentencepiece_bpe, simhash, substrings
from notelens.llm.tables import DOCUMENT_COLUMNS, table
from notelens.llm.token_queries import digests
from notelens.session import stage_dir


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*DOCUMENT_COLUMNS)


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = _documents(docs)
    model = quality.fit(own, table(spark, sf_dir, "labels"))
    scored = quality.score(own, model, keep=DOCUMENT_COLUMNS)
    return _documents(scored.filter(F.col("score") >= quality.THRESHOLD))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(_documents(docs))


def stage_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(_documents(docs), keep=DOCUMENT_COLUMNS)
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    n_chars = F.when(changed, F.length("kept").cast("bigint")).otherwise(F.col("n_chars"))
    return found.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = _documents(docs)
    return mixing.remix(own, own, least=1.0, keep_all=True)


def stage_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digests(sentencepiece_bpe.encode(_documents(docs), public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("quality", stage_quality), ("near_duplicates", stage_near_duplicates), ("substrings", stage_substrings),
    ("mixing", stage_mixing), ("tokens", stage_tokens),
]

#: The quality classifier and the mixing fit cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written below the shared stage folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{stage_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
