import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCUMENTS = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
    StructField("source", StringType()), StructField("n_chars", LongType()),
])


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, first=0):
        """Documents with ids from `first`; an item may be a (doc_id, text) pair."""
        rows = [t if isinstance(t, tuple) else (first + i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCUMENTS)

    return make
