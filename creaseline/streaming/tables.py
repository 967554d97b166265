"""Streams over other tables: change feeds, windowed metrics, bounded de-duplication, refreshes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from creaseline.operators.buckets import BucketTable
from creaseline.session import shared_folder
from creaseline.sources import changes
from creaseline.streaming.ledger import Ledger, Stream, deliver, run_available

CHANGE_LOG = T.StructType(
    [
        T.StructField("change_key", T.LongType()),
        T.StructField("sequence", T.IntegerType()),
        T.StructField("value", T.StringType()),
    ]
)


def _drive(spark: SparkSession, root: str, schema: T.StructType, deliveries: list[DataFrame], step: Callable) -> None:
    """Deliver each slice to a file stream and let ``step(stream)`` process what has arrived."""
    for part in deliveries:
        deliver(part, f"{root}/in")
        step(spark.readStream.schema(schema).parquet(f"{root}/in"))


class ChangeStream(Stream):
    """Change feed onto an empty table. A batch leaves its last change per key; reading folds them."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        super().__init__(spark, root)
        schema = "change_key bigint, op string, o_orderstatus string, o_totalprice double, sequence int"
        self.changes = Ledger(spark, f"{self.root}/changes", T.StructType.fromDDL(schema))

    def process(self, batch: DataFrame, batch_id: int) -> None:
        decoded = changes.read_changes(batch).select(
            "change_key", "sequence", "op", F.col("after.o_orderstatus").alias("o_orderstatus"), F.col("after.o_totalprice").alias("o_totalprice")
        )
        row = F.struct("op", "o_orderstatus", "o_totalprice", "sequence")
        last = decoded.groupBy("change_key").agg(F.max_by(row, "sequence").alias("r")).select("change_key", "r.*")
        self.changes.write(last, batch_id)

    def consume(self, deliveries: list[DataFrame]) -> ChangeStream:
        _drive(self.spark, self.root, CHANGE_LOG, deliveries, self.run_available)
        return self

    def table(self) -> DataFrame:
        return self.changes.latest(["change_key"]).where("op <> 'd'").drop("op", "sequence")


EVENT_LOG = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"


def tumbling_metrics(
    spark: SparkSession, deliveries: list[DataFrame], period: str, late: str, root: str | None = None
) -> DataFrame:
    """Counts, sums and maxima per period and type, kept in streaming state with a watermark.

    Every batch emits the windows it changed; the newest state per window is the result.
    """
    root = root or shared_folder(spark)
    schema = T.StructType(
        [
            T.StructField("period_start", T.TimestampType()),
            T.StructField("event_type", T.StringType()),
            T.StructField("n", T.LongType()),
            T.StructField("errors", T.LongType()),
            T.StructField("total", T.DecimalType(28, 2)),
            T.StructField("highest", T.DoubleType()),
        ]
    )
    sink = Ledger(spark, f"{root}/metrics", schema)

    def step(stream: DataFrame) -> None:
        grouped = stream.withWatermark("ts", late).groupBy(F.window("ts", period), "event_type")
        metrics = grouped.agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.col("event_type") == "error").alias("errors"),
            F.sum(F.col("value").cast("decimal(18,2)")).alias("total"),
            F.max("value").alias("highest"),
        ).withColumn("period_start", F.col("window.start"))
        run_available(metrics, sink.write, f"{root}/checkpoint", "update")

    log_schema = T.StructType.fromDDL(EVENT_LOG)
    casted = [d.select("event_id", F.col("ts").cast("timestamp"), "user_id", "event_type", "value") for d in deliveries]
    _drive(spark, root, log_schema, casted, step)
    return sink.latest(["period_start", "event_type"])


def bounded_dedup(
    spark: SparkSession, deliveries: list[DataFrame], keys: list[str], within: str, root: str | None = None
) -> DataFrame:
    """Drop repeats that arrive within a bounded time; state older than that is released."""
    root = root or shared_folder(spark)
    schema = T.StructType([T.StructField(k, T.StringType()) for k in keys])
    sink = Ledger(spark, f"{root}/unique", schema)

    def step(stream: DataFrame) -> None:
        unique = stream.withWatermark("arrival", within).dropDuplicatesWithinWatermark(keys)
        run_available(unique, sink.write, f"{root}/checkpoint")

    casted = [d.select(*keys, F.col("arrival").cast("timestamp").alias("arrival")) for d in deliveries]
    _drive(spark, root, schema.add("arrival", T.TimestampType()), casted, step)
    return sink.read().select(*keys)


def refresh_days(spark: SparkSession, old: DataFrame, new: DataFrame, summarize: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Materialised daily summary: write it for the old rows, then recompute only the days that new
    rows touch and overwrite just those partitions."""
    path = shared_folder(spark)

    def write(df: DataFrame) -> None:
        rebalanced = df.hint("rebalance", F.col("day"))
        rebalanced.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)

    first = summarize(old)
    write(first)
    touched = new.select(F.to_date("ts").alias("_day")).distinct()
    # the range of the new rows reaches the scan of the history, the days in it are picked by the join
    low, high = new.agg(F.min(F.to_date("ts")), F.date_add(F.max(F.to_date("ts")), 1)).first()
    if low is not None:
        ts = F.col("ts")
        earlier = old.where((ts >= F.lit(low).cast("timestamp_ntz")) & (ts < F.lit(high).cast("timestamp_ntz")))
        rows = earlier.unionByName(new).withColumn("_day", F.to_date("ts")).join(touched, "_day", "left_semi").drop("_day")
        write(summarize(rows))
    return spark.read.schema(first.schema).parquet(path)


def apply_change_table(stored: BucketTable, log: DataFrame) -> BucketTable:
    """Batch form of the change feed, onto a stored table with the same key; only buckets of changed keys are written."""
    decoded = changes.read_changes(log).select(
        F.col("change_key").alias("o_orderkey"),
        "sequence",
        "op",
        F.col("after.o_orderstatus").alias("o_orderstatus"),
        F.col("after.o_totalprice").alias("o_totalprice"),
    )
    stored.apply_changes(decoded, "sequence", ["o_orderstatus", "o_totalprice"])
    return stored
