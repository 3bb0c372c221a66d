import pytest
from pyspark.sql import types as T

#: Columns that clash with names used inside the operators.
EXTRA = ["_hash", "_key", "path", "label", "k", "id", "n", "rep", "print", "spans", "keep", "domain", "rate"]


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text[, lang, source, n_chars]) with clashing extra columns."""

    def make(rows, parts=3):
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in EXTRA]])
        full = [(*r, *[None] * (5 - len(r)), *["x"] * len(EXTRA)) for r in rows]
        return spark.createDataFrame(full, schema).repartition(parts)

    return make
