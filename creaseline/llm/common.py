"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_CONF, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 4000


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, the whole text (null counts as empty) and the named columns; whatever else there is goes.

    Texts are long rows, so a session that leaves Spark's number of rows in an Arrow batch gets a smaller one.
    """
    if docs.sparkSession.conf.get(BATCH_CONF) == "10000":
        docs.sparkSession.conf.set(BATCH_CONF, str(BATCH_ROWS))
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a piece holds about ``size`` bytes of ``column``; one longer row is a piece by itself."""
    for batch in batches:
        start = total = 0
        lengths = pc.binary_length(batch.column(column)).to_pylist()
        for i, length in enumerate(lengths):
            length = length or 0
            if i > start and total + length > size:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += length
        if len(lengths) > start:
            yield batch.slice(start, len(lengths) - start)
