import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

COLUMNS = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()),
    *[StructField(n, StringType()) for n in ("fp", "bytes", "spans", "toxicity", "hub", "rid", "shard", "count", "score", "word")],  # names that operators use inside
])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from ``(doc_id, text)`` pairs, with extra columns whose names clash."""
    def make(rows):
        return spark.createDataFrame([(i, t, None, None, None if t is None else len(t), *["x"] * 10) for i, t in rows], COLUMNS)

    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Null id, null and empty texts, repeated rows, a tie, blanks, a very long text."""
    long = "lorem ipsum dolor sit amet " * 20_000
    return make_docs([(None, "a null id"), (1, None), (2, ""), (3, "  \n "), (4, "same text here"), (5, "same text here"), (5, "same text here"), (6, long), (7, "é" * 3000)])
