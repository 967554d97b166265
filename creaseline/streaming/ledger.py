"""Append-only tables for ``foreachBatch``: every micro-batch owns one sub-folder.

A batch that runs again after a failure overwrites its own folder, so each batch counts once. What a
batch writes is proportional to the batch, never to the table; readers fold to the newest row per key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from creaseline.session import shared_folder

BATCH = "batch_id"
BUCKET = "bucket"
BUCKETS_CONF = "spark.creaseline.storeBuckets"
PROGRESS = T.StructType([T.StructField("input_rows", T.LongType())])
COMPACTION = T.StructType([T.StructField("up_to", T.LongType()), T.StructField("folder", T.StringType())])


def bucket_of(spark: SparkSession, key: str) -> Column:
    """Folder number of a key. A store at scale wants some thousands of them."""
    buckets = int(spark.conf.get(BUCKETS_CONF, "8"))
    return F.pmod(F.hash(key), F.lit(buckets)).cast("int")


def existing(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


class Ledger:
    """``bucket_by`` splits each batch further by a hash of that column, so that a join on it can leave
    folders out.

    A compaction folds batches that cannot run again and is recorded beside the ledger; from then on
    their own folders are not read. Whoever opens the path finds it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, bucket_by: str | None = None):
        self.spark, self.path, self.bucket_by = spark, path, bucket_by
        self.columns = schema.fieldNames()
        parts = [T.StructField(BATCH, T.LongType())]
        if bucket_by:
            parts.append(T.StructField(BUCKET, T.IntegerType()))
        self.schema = T.StructType([*schema.fields, *parts])
        self.folded = self._last_compaction()

    def _last_compaction(self) -> tuple[int, str] | None:
        recorded = existing(self.spark, f"{self.path}-compactions", COMPACTION)
        row = recorded and recorded.agg(F.max_by(F.struct("up_to", "folder"), "up_to").alias("r")).first()
        return tuple(row.r) if row and row.r else None

    def _write(self, rows: DataFrame, target: str) -> None:
        if self.bucket_by:
            rows = rows.withColumn(BUCKET, bucket_of(self.spark, self.bucket_by))
            rows.write.mode("overwrite").partitionBy(BUCKET).parquet(target)
        else:
            rows.write.mode("overwrite").parquet(target)

    def write(self, df: DataFrame, batch_id: int) -> None:
        self._write(df.select(*self.columns), f"{self.path}/{BATCH}={batch_id}")

    def read(self, before: int | None = None) -> DataFrame:
        """Rows of the batches before one, or of all; the folder filter prunes files."""
        rows = existing(self.spark, self.path, self.schema)
        if rows is None:
            rows = self.spark.createDataFrame([], self.schema)
        if self.folded:
            up_to, folder = self.folded
            base = self.spark.read.schema(self.schema).parquet(folder)
            rows = rows.where(F.col(BATCH) > up_to).unionByName(base)
        return rows if before is None else rows.where(F.col(BATCH) < before)

    def batch(self, batch_id: int) -> DataFrame:
        return self.read().where(F.col(BATCH) == batch_id)

    def latest(self, keys: Sequence[str], before: int | None = None) -> DataFrame:
        """Newest row per key."""
        return self._newest(self.read(before), keys).drop(BATCH)

    def _newest(self, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        values = [c for c in [*self.columns, BATCH] if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(BATCH)).alias("r")).select(*keys, "r.*")

    def compact(self, up_to: int, keys: Sequence[str] | None = None) -> None:
        """Fold the batches up to ``up_to``, or the newest row per key of them, into few files.

        Rows keep their batch numbers. None of these batches may run again.
        """
        if self.folded and up_to <= self.folded[0]:
            return
        rows = self.read(before=up_to + 1).select(*self.columns, BATCH)
        folder = f"{self.path}-compacted/{uuid.uuid4().hex}"
        self._write((self._newest(rows, keys) if keys else rows).hint("rebalance"), folder)
        record = self.spark.range(1).select(F.lit(up_to).cast("long").alias("up_to"), F.lit(folder).alias("folder"))
        record.write.mode("append").parquet(f"{self.path}-compactions")
        self.folded = up_to, folder


class Stream:
    """What every stream has: a root folder, and under it a checkpoint and a record of finished batches.

    Opened with the ``root`` of an earlier one, also of another driver, it goes on where that one stopped.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or shared_folder(spark)).rstrip("/")
        self.progress = Ledger(spark, f"{self.root}/progress", PROGRESS)

    def process(self, batch: DataFrame, batch_id: int) -> DataFrame | None:
        """Write the sinks. A stream whose batch is dear to evaluate returns where it has written its rows, one for one."""
        raise NotImplementedError

    def finished(self, batch: DataFrame, batch_id: int) -> None:
        """A batch whose sinks are all written."""
        written = self.process(batch, batch_id)
        rows = batch if written is None else written
        self.progress.write(rows.agg(F.count(F.lit(1)).alias("input_rows")), batch_id)

    def run_available(self, stream: DataFrame) -> None:
        run_available(stream, self.finished, f"{self.root}/checkpoint")

    def safe(self) -> int:
        """The newest batch that cannot run again: the one before the newest finished one."""
        last = self.progress.read().agg(F.max(BATCH)).first()[0]
        return -1 if last is None else last - 1


def run_available(
    stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    """Process everything that is there, then stop."""
    query = (
        stream.writeStream.foreachBatch(process)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def arrivals(df: DataFrame, column: str, cuts: Sequence[str]) -> list[DataFrame]:
    """Cut a table into consecutive time slices, as deliveries to a file stream."""
    edges = [F.lit(c).cast("timestamp_ntz") for c in cuts]
    slices = []
    for low, high in zip([None, *edges], [*edges, None]):
        part = df
        if low is not None:
            part = part.where(F.col(column) >= low)
        if high is not None:
            part = part.where(F.col(column) < high)
        slices.append(part)
    return slices


def deliver(df: DataFrame, path: str) -> None:
    """Append files to a stream folder."""
    df.write.mode("append").parquet(path)
