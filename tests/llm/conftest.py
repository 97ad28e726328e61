import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def documents(spark):
    """Make a documents table of texts, or of (doc_id, text) pairs."""

    def make(rows, extra=()):
        rows = [r if isinstance(r, tuple) else (k, r) for k, r in enumerate(rows)]
        full = [(i, t, "en", "src0", len(t) if t is not None else None, *[str(i)] * len(extra)) for i, t in rows]
        return spark.createDataFrame(full, T.StructType([*DOCUMENTS.fields, *[T.StructField(c, T.StringType()) for c in extra]]))

    return make
