"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notelens.session import stage_dir

#: Columns of the ``documents`` table.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the folder that ``spark.checkpoint.dir`` names and read it back.

    Several users of the result then share one computation, and a lost executor costs no more than the tasks it ran.
    """
    path = f"{stage_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is in the held-out fold: crc32 of its id as text, modulo 5, is 0 (null id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, nbytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into pieces of at most ``rows`` rows and about ``nbytes`` bytes (one row at least)."""
    for batch in batches:
        step = max(1, min(rows, int(batch.num_rows * nbytes / max(batch.nbytes, 1))))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def map_rows(df: DataFrame, fn, fields: list[T.StructField]) -> DataFrame:
    """``mapInArrow`` with a schema given as fields."""
    return df.mapInArrow(fn, T.StructType(fields))
