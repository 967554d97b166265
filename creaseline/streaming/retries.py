"""Retry tiers as a stream: attempts wait in keyed state until a timer of the event clock lets them run.

Only records whose first attempt fails enter the state, under their match and one of a few slots, so that a match that
holds a third of all records is not one task. The clock is the watermark of all records' times and never goes back.
What waits carries no event time of its own, so the engine drops nothing as late: an attempt whose time has
passed runs at once.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from creaseline.functions.scalars import event_sequence
from creaseline.operators import retry
from creaseline.operators.store import first_arrivals, storable, stored_rows
from creaseline.operators.view import live_view
from creaseline.schemas import BALL_KEY, LOG_ORDER, LOG_SCHEMA
from creaseline.sources import log as logs
from creaseline.streaming.ingest import EVENT_SCHEMA
from creaseline.streaming.ledger import BATCH, BUCKET, Ledger, Stream, bucket_of, deliver

# the processor travels with its class, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RETRY_ORDER = ["effective_arrival", *LOG_ORDER]
SETTLED_SCHEMA = T.StructType([*EVENT_SCHEMA.fields, T.StructField("effective_arrival", T.TimestampNTZType())])
CLOCK_SCHEMA = T.StructType([T.StructField("now", T.TimestampNTZType())])
SLOTS = 16  # of a match, for its waiting attempts
PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

DUE = T.StructType([T.StructField("due_ms", T.LongType())])
ATTEMPT = T.StructType(
    [
        T.StructField("payload", T.StringType()),
        T.StructField("failures", T.IntegerType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("due_us", T.LongType()),
    ]
)
WAITING = T.StructType([T.StructField("attempts", T.ArrayType(ATTEMPT))])
OUTCOME = "payload string, status string, due_us long"
#: Pauses before attempts 2, 3 and 4, in microseconds.
PAUSES = [min(retry.FIRST_DELAY_MS * retry.MULTIPLIER**n, retry.MAX_DELAY_MS) * 1000 for n in range(retry.MAX_ATTEMPTS - 1)]


class Attempts(StatefulProcessor):
    """Runs the attempts of failing records. What waits is kept by the millisecond in which it falls due."""

    def __init__(self, pauses: list[int]):
        self.pauses = pauses

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", DUE, WAITING)

    def _run(self, payload: str, failures: int, attempt: int, due: int | None, clock_ms: int) -> Iterator[Row]:
        """Attempts from one on, as far as the clock allows."""
        while due is None or -(-due // 1000) <= clock_ms:
            if attempt > failures or attempt > len(self.pauses):
                yield Row(payload=payload, status="ok" if attempt > failures else "dlt", due_us=due)
                return
            due = None if due is None else due + self.pauses[attempt - 1]
            attempt += 1
        key = (-(-due // 1000),)
        before = list(self.waiting.getValue(key)[0]) if self.waiting.containsKey(key) else []
        self.waiting.updateValue(key, ([*before, (payload, failures, attempt, due)],))
        self.handle.registerTimer(key[0])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        clock = timerValues.getCurrentWatermarkInMs()
        for row in rows:
            due = None if row.arrival_us is None else row.arrival_us + self.pauses[0]
            yield from self._run(row.payload, row.failures, 2, due, clock)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = (expiredTimerInfo.getExpiryTimeInMs(),)
        if not self.waiting.containsKey(due):
            return
        attempts = self.waiting.getValue(due)[0]
        self.waiting.removeKey(due)
        clock = max(timerValues.getCurrentWatermarkInMs(), due[0])
        for payload, failures, attempt, due_us in attempts:
            yield from self._run(payload, failures, attempt, due_us, clock)

    def close(self) -> None:
        pass


class FirstLedger(Ledger):
    """Rows of which the first per ball counts, by effective arrival, whichever batch brought it."""

    def read(self, before: int | None = None) -> DataFrame:
        return first_arrivals(super().read(before), BALL_KEY, RETRY_ORDER)

    def batch(self, batch_id: int) -> DataFrame:
        return super().read().where(F.col(BATCH) == batch_id)

    def of(self, keys: DataFrame, columns: list[str], before: int) -> DataFrame:
        """What batches before one have for the keys. The keys are few, so they narrow the store where it is read."""
        listed = keys.select(bucket_of(self.spark, "match_id").alias(BUCKET), *columns).distinct()
        return first_arrivals(super().read(before).join(listed, [BUCKET, *columns], "left_semi"), BALL_KEY, RETRY_ORDER)


class RetryStream(Stream):
    """Decoded records, their retries, dead letters, event store and live view, each batch to one ledger each.

    ``failures`` and ``error_class`` say, per decoded row, how many attempts fail and why. Store and view do not depend
    on the order or the cuts of the deliveries: a ball belongs to its first effective arrival, and one that turns up
    later replaces what the store had. A match that loses a row this way has its view folded anew from the store; the
    others go on from their last ball.
    """

    def __init__(self, spark: SparkSession, failures: Column, error_class: Column, root: str | None = None):
        super().__init__(spark, root)
        self.failures, self.error_class = failures, error_class
        outcome = [T.StructField("status", T.StringType()), T.StructField("record", LOG_SCHEMA)]
        replacing = T.StructType([*SETTLED_SCHEMA.fields, T.StructField("replaces", T.BooleanType())])
        self.outcomes = Ledger(spark, f"{self.root}/outcomes", T.StructType([*outcome, *SETTLED_SCHEMA.fields]))
        self.events = FirstLedger(spark, f"{self.root}/events", replacing, bucket_by="match_id")
        self.last = Ledger(spark, f"{self.root}/last", SETTLED_SCHEMA)
        self.dead = Ledger(spark, f"{self.root}/dead", SETTLED_SCHEMA)
        self.poison = Ledger(spark, f"{self.root}/poison", LOG_SCHEMA)

    def attempted(self, log: DataFrame) -> DataFrame:
        """A log as the rows of ``outcomes``, in any batch in which they come about."""
        both = logs.parsed(log)
        poison = F.col("is_poison")
        failures = F.when(poison, 0).when(storable(), self.failures).otherwise(retry.MAX_ATTEMPTS)
        final = F.col("error_class").isin(retry.NOT_RETRIED)
        record = F.struct(*[F.col(c) for c in LOG_SCHEMA.fieldNames()])
        tried = (
            both.select(F.when(poison, record).alias("record"), *LOG_ORDER, F.col("timestamp").alias("arrival"), "is_poison", *logs.ball_fields())
            .withColumn("event_sequence", event_sequence())
            .withColumns({"failures": failures.cast("int"), "error_class": self.error_class})
        )
        again = (F.col("failures") > 0) & ~F.coalesce(final, F.lit(False))
        first = stored_rows(
            tried.where(~again).withColumn("effective_arrival", F.col("arrival")),
            *LOG_ORDER,
            "effective_arrival",
            F.when(poison, "poison").when(F.col("failures") > 0, "dlt").otherwise("ok").alias("status"),
            "record",
        )
        return first.select(*self.outcomes.columns).unionByName(self._retried(tried, again))

    def _retried(self, tried: DataFrame, again: Column) -> DataFrame:
        """Outcomes of the records that are tried again. Every record moves the clock; those to be tried come once more
        without a time, which the engine cannot take for late."""
        micros = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
        named = stored_rows(tried, *LOG_ORDER, "arrival", "failures", again.alias("again"))
        payload = F.when(F.col("again"), F.to_json(F.struct(*EVENT_SCHEMA.fieldNames()), micros))
        sides = F.when(F.col("again"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
        rows = named.select(
            "match_id",
            F.pmod(F.hash(*LOG_ORDER), F.lit(SLOTS)).alias("slot"),
            payload.alias("payload"),
            "failures",
            "arrival",
            F.explode(sides).alias("waits"),
        )
        clock = F.when(~F.col("waits"), F.coalesce("arrival", F.lit("1970-01-01").cast("timestamp_ntz"))).cast("timestamp")
        ticks = self._ticks().select(F.col("now").cast("timestamp").alias("clock"))
        clocked = rows.withColumn("clock", clock).unionByName(ticks, allowMissingColumns=True).withWatermark("clock", "0 seconds")
        waiting = clocked.where(F.col("clock").isNull()).select(
            "match_id", "slot", "payload", "failures", F.unix_micros(F.col("arrival").cast("timestamp")).alias("arrival_us"), "clock"
        )
        done = waiting.groupBy("match_id", "slot").transformWithState(Attempts(PAUSES), OUTCOME, "append", "eventTime")
        due = F.timestamp_micros("due_us").cast("timestamp_ntz")
        event = F.from_json("payload", EVENT_SCHEMA, micros)
        settled = done.select("status", F.lit(None).cast(LOG_SCHEMA).alias("record"), event.alias("event"), due.alias("effective_arrival"))
        return settled.select("status", "record", "event.*", "effective_arrival").select(*self.outcomes.columns)

    def _ticks(self) -> DataFrame:
        """Times that move the clock when no records come."""
        path = f"{self.root}/ticks"
        self.spark.createDataFrame([], CLOCK_SCHEMA).coalesce(1).write.mode("append").parquet(path)
        return self.spark.readStream.schema(CLOCK_SCHEMA).parquet(path)

    def process(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The batch is evaluated once, into the ledger of outcomes; all else reads that."""
        self.outcomes.write(batch, batch_id)
        rows = self.outcomes.batch(batch_id)
        present = {r.status for r in rows.select("status").distinct().collect()}  # three at most
        if "poison" in present:
            self.poison.write(rows.where("status = 'poison'").select("record.*"), batch_id)
        if "dlt" in present:
            self.dead.write(rows.where("status = 'dlt'"), batch_id)
        if "ok" in present:
            self._store(rows.where("status = 'ok'"), batch_id)
        return rows

    def _store(self, settled: DataFrame, batch_id: int) -> None:
        """Store what is first so far, and set the views of the matches that got something."""
        due = first_arrivals(settled, BALL_KEY, RETRY_ORDER)
        order = F.struct(*RETRY_ORDER)
        known = self.events.of(due, BALL_KEY, batch_id).select(*BALL_KEY, order.alias("_known"))
        better = due.join(known, BALL_KEY, "left").where(F.col("_known").isNull() | (order < F.col("_known")))
        self.events.write(better.withColumn("replaces", F.col("_known").isNotNull()), batch_id)

        written = self.events.batch(batch_id).select(*SETTLED_SCHEMA.fieldNames(), "replaces")
        matches = written.groupBy("match_id").agg(F.bool_or("replaces").alias("replaces"))
        folded = self.events.of(matches.where("replaces"), ["match_id"], batch_id + 1)
        before = self.last.latest(["match_id"], before=batch_id).join(matches.where("not replaces"), "match_id", "left_semi")
        kept = written.join(matches.where("not replaces").select("match_id"), "match_id", "left_semi")
        names = SETTLED_SCHEMA.fieldNames()
        candidates = folded.select(*names).unionByName(before.select(*names)).unionByName(kept.select(*names))
        last = candidates.groupBy("match_id").agg(F.max_by(F.struct(*names), order).alias("r"))
        self.last.write(last.select("r.*"), batch_id)

    def run(self, source: str | DataFrame) -> None:
        """Work through what has arrived since the last run, files below a path or any stream with the log's columns."""
        stream = logs.stream_log(self.spark, source) if isinstance(source, str) else source
        before = self.spark.conf.get(PROVIDER_CONF)
        self.spark.conf.set(PROVIDER_CONF, PROVIDER)  # map state and timers need it
        try:
            self.run_available(self.attempted(stream))
        finally:
            self.spark.conf.set(PROVIDER_CONF, before)

    def tick(self, now: Column) -> None:
        """Move the clock without a record; the next run lets it go by."""
        deliver(self.spark.range(1).select(now.alias("now")), f"{self.root}/ticks")

    def consume(self, deliveries: list[DataFrame]) -> RetryStream:
        """Work through the deliveries, then let the clock run out for what still waits."""
        path = f"{self.root}/in"
        for part in deliveries:
            deliver(part, path)
            self.run(path)
        newest = self.spark.read.schema(LOG_SCHEMA).parquet(path).agg(F.max("timestamp")).first()[0]
        if newest is not None:
            self.tick(F.lit(newest) + F.make_dt_interval(secs=F.lit(sum(PAUSES) / 10**6 + 1).cast("decimal(18,6)")))
            self.run(path)
        return self

    def waiting(self) -> DataFrame:
        """Attempts whose time has not come, from the state of the last finished batch."""
        state = self.spark.read.format("statestore").option("path", f"{self.root}/checkpoint").option("stateVarName", "waiting").load()
        return state.select("key.match_id", F.explode("user_map_value.attempts").alias("a")).select("match_id", "a.*")

    def store(self) -> DataFrame:
        return self.events.read().drop(BATCH, BUCKET, "replaces")

    def view(self) -> DataFrame:
        last = self.last.latest(["match_id"]).withColumnRenamed("event_ts", "ts")
        return live_view(last, RETRY_ORDER)
