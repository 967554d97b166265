"""Anomalous buckets as a stream: counts per host and period close with the watermark, and each closed bucket is held
against the ones before it, which wait in the host's state.

Rows fold map-side into one count per host and period before any state is touched, so a host that has a third of all rows
costs its ring no more than others. A ring holds as many closed buckets as the trailing window has, whatever the data.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from math import sqrt

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from creaseline.streaming.ledger import BATCH, Ledger, Stream, deliver, existing
from creaseline.streaming.retries import PROVIDER, PROVIDER_CONF

# the processor travels with its class, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Trailing buckets, the fewest of them that allow a judgement, and standard deviations above their mean.
TRAILING, FEWEST, HIGH = 24, 8, 1.9876
#: An alert is raised by more than ALERT anomalies among the last RECENT periods.
RECENT, ALERT = 12, 1

SEEN = T.StructType([T.StructField("host", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("tick", T.BooleanType())])
BUCKET_OF_RING = T.StructType([T.StructField("period", T.LongType()), T.StructField("n", T.LongType()), T.StructField("anomaly", T.BooleanType())])
RING = T.StructType([T.StructField("buckets", T.ArrayType(BUCKET_OF_RING))])
JUDGED = "host string, period long, n long, anomaly boolean, recent long, alert boolean"


class Trailing(StatefulProcessor):
    """Judges the closed buckets of a host in their order; they close in that order over the batches too."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle) -> None:
        self.ring = handle.getValueState("ring", RING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        ring = [tuple(b) for b in self.ring.get()[0]] if self.ring.exists() else []
        for period, n in sorted((row.period, row.n) for row in rows):
            anomaly = len(ring) >= FEWEST and n > self._bound([b[1] for b in ring])
            since = period - (RECENT - 1) * self.seconds
            recent = sum(b[2] for b in ring if b[0] >= since) + anomaly
            yield Row(host=key[0], period=period, n=n, anomaly=anomaly, recent=recent, alert=recent > ALERT)
            ring = [*ring, (period, n, anomaly)][-TRAILING:]
        self.ring.update((ring,))

    @staticmethod
    def _bound(counts: list[int]) -> float:
        mean = sum(counts) / len(counts)
        return mean + HIGH * sqrt(sum((c - mean) ** 2 for c in counts) / (len(counts) - 1))

    def close(self) -> None:
        pass


class AnomalyStream(Stream):
    """``host, ts`` rows to ``buckets``: one row per host and period that had rows, with ``period`` in epoch seconds.

    Rows may come in any order within ``late`` of the newest; a row older than that is not counted if its bucket has
    closed. A null host is a host; a row without a time is in no bucket. ``RECENT`` periods lie within ``TRAILING`` buckets.
    """

    def __init__(self, spark: SparkSession, period: str, late: str = "10 minutes", root: str | None = None):
        super().__init__(spark, root)
        self.period, self.late = period, late
        self.buckets = Ledger(spark, f"{self.root}/buckets", T.StructType.fromDDL(JUDGED))

    def judged(self, seen: DataFrame) -> DataFrame:
        counted = (
            seen.where("ts IS NOT NULL")
            .withWatermark("ts", self.late)
            .groupBy(F.window("ts", self.period), "host")
            .agg(F.count_if(~F.col("tick")).alias("n"))
        )
        closed = counted.where("n > 0").select("host", F.unix_seconds("window.start").alias("period"), "n")
        seconds = int(self.spark.range(1).select(F.expr(f"unix_seconds(timestamp_seconds(0) + INTERVAL {self.period})")).first()[0])
        return closed.groupBy("host").transformWithState(Trailing(seconds), JUDGED, "append", "none")

    def process(self, batch: DataFrame, batch_id: int) -> DataFrame:
        self.buckets.write(batch, batch_id)
        return self.buckets.batch(batch_id)

    def run(self) -> None:
        """Work through what has arrived since the last run."""
        before = self.spark.conf.get(PROVIDER_CONF)
        self.spark.conf.set(PROVIDER_CONF, PROVIDER)
        try:
            self.run_available(self.judged(self.spark.readStream.schema(SEEN).parquet(f"{self.root}/in")))
        finally:
            self.spark.conf.set(PROVIDER_CONF, before)

    def _deliver(self, rows: DataFrame, tick: bool) -> None:
        deliver(rows.select(F.col("host").cast("string"), F.col("ts").cast("timestamp"), F.lit(tick).alias("tick")), f"{self.root}/in")

    def consume(self, deliveries: list[DataFrame]) -> AnomalyStream:
        for part in deliveries:
            self._deliver(part, tick=False)
            self.run()
        return self

    def close_all(self) -> AnomalyStream:
        """Let the clock pass the newest bucket, as the next period's rows would; the tick is in no count."""
        arrived = existing(self.spark, f"{self.root}/in", SEEN)
        newest = None if arrived is None else arrived.agg(F.max("ts").alias("ts")).first().ts
        if newest is not None:
            late = F.expr(f"INTERVAL {self.period}") + F.expr(f"INTERVAL {self.late}") + F.expr("INTERVAL 1 SECOND")
            self._deliver(arrived.agg((F.max("ts") + late).alias("ts"), F.lit(None).cast("string").alias("host")), tick=True)
            self.run()
        return self

    def read(self) -> DataFrame:
        return self.buckets.read().drop(BATCH)
