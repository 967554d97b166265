import pytest
from pyspark.sql import types as T

from creaseline.session import materialize

DOCS = T.StructType(
    [T.StructField(n, k) for n, k in [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType())]]
)


@pytest.fixture(scope="session")
def keep():
    return materialize


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from ``(doc_id, text)`` or ``(doc_id, text, lang)``, over several partitions."""

    def build(rows, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(partitions) if full else spark.createDataFrame([], DOCS)

    return build


@pytest.fixture(scope="session")
def corpus(spark, data):
    """The given documents as ``{doc_id: text}``."""
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
