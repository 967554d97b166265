"""The scoring stream: decode, first write wins, live view, notifications, dead letters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from creaseline.functions.scalars import event_sequence
from creaseline.operators.store import first_arrivals, storable, stored_rows
from creaseline.operators.view import VIEW_COLUMNS, live_view
from creaseline.schemas import BALL_COLUMNS, BALL_KEY, LOG_ORDER, LOG_SCHEMA
from creaseline.sources import log as logs
from creaseline.streaming.ledger import BATCH, BUCKET, Ledger, Stream, bucket_of, deliver

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("match_id", T.StringType()),
        T.StructField("event_sequence", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("inning", T.IntegerType()),
        T.StructField("over_no", T.IntegerType()),
        T.StructField("ball", T.IntegerType()),
        T.StructField("team", T.StringType()),
        T.StructField("runs", T.IntegerType()),
        T.StructField("extras", T.IntegerType()),
        T.StructField("wicket", T.BooleanType()),
        T.StructField("total_runs", T.IntegerType()),
        T.StructField("wickets", T.IntegerType()),
        T.StructField("event_ts", T.TimestampNTZType()),
        T.StructField("ttl", T.LongType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
    ]
)
VIEW_SCHEMA = T.StructType(
    [
        T.StructField("match_id", T.StringType()),
        *[
            T.StructField(c, T.BooleanType() if c == "is_wicket" else T.IntegerType())
            for c in list(VIEW_COLUMNS)[:-1]
        ],
        T.StructField("last_updated", T.TimestampNTZType()),
    ]
)
FEED_COLUMNS = ["match_id", "event_sequence", "event_id", "total_runs"]
FEED_SCHEMA = T.StructType([EVENT_SCHEMA[c] for c in FEED_COLUMNS])
COUNT_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in ("received", "poison", "dlt", "accepted")])
STORE_ERROR = "java.lang.RuntimeException"
NOTIFICATION_SCHEMA = T.StructType(
    [
        T.StructField("match_id", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("payload", T.StringType()),
        T.StructField("error_fqcn", T.StringType()),
        T.StructField("error_message", T.StringType()),
    ]
)


def stored_keys(events: Ledger, before: int, balls: DataFrame) -> DataFrame:
    """Those ball keys of a batch that earlier batches have stored.

    The store is narrowed by the batch's keys where it is read: the batch is the small side, so what
    moves between tasks follows the batch and not the store.
    """
    keys = balls.select(bucket_of(events.spark, "match_id").alias(BUCKET), *BALL_KEY).distinct()
    return events.read(before).select(BUCKET, *BALL_KEY).join(keys, [BUCKET, *BALL_KEY], "left_semi").select(*BALL_KEY)


class ScoreStream(Stream):
    """Event store, live view, unreadable records, dead letters, processed feed and counters, one ledger each.

    Store and view come from the same accepted rows, so a batch that failed half-way and runs again
    completes both, also under another driver that opens the same ``root``.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        super().__init__(spark, root)
        self.events = Ledger(spark, f"{self.root}/events", EVENT_SCHEMA, bucket_by="match_id")
        self.views = Ledger(spark, f"{self.root}/view", VIEW_SCHEMA)
        self.poison = Ledger(spark, f"{self.root}/poison", LOG_SCHEMA)
        self.feed = Ledger(spark, f"{self.root}/processed", FEED_SCHEMA)
        self.counts = Ledger(spark, f"{self.root}/counts", COUNT_SCHEMA)
        self.dead = Ledger(spark, f"{self.root}/dead", LOG_SCHEMA)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch to all sinks. Records are decoded once; the view and the feed read back
        the accepted rows of this batch, and the counters are taken while those are written."""
        both = logs.parsed(batch).persist()
        try:
            log_columns = LOG_SCHEMA.fieldNames()
            self.poison.write(both.where("is_poison"), batch_id)
            decoded = both.where(~F.col("is_poison")).select(*log_columns, *logs.ball_fields())
            failing, dead = decoded.where(~storable()).select(*log_columns), Observation()
            letters = logs.to_dead_letters(failing, F.lit(STORE_ERROR), F.lit("incomplete event"))
            self.dead.write(letters.observe(dead, F.count(F.lit(1)).alias("n")), batch_id)

            balls = decoded.where(storable()).select(*LOG_ORDER, *BALL_COLUMNS, event_sequence().alias("event_sequence"))
            first, stored = first_arrivals(balls), Observation()
            accepted = stored_rows(first.join(stored_keys(self.events, batch_id, first), BALL_KEY, "left_anti"), *LOG_ORDER)
            self.events.write(accepted.observe(stored, F.count(F.lit(1)).alias("n")), batch_id)

            written = self.events.batch(batch_id)
            self.views.write(live_view(written.withColumnRenamed("event_ts", "ts")), batch_id)
            self.feed.write(written, batch_id)
            tallies = {"dlt": F.lit(dead.get.get("n", 0)).cast("long"), "accepted": F.lit(stored.get.get("n", 0)).cast("long")}
            received = both.agg(F.count(F.lit(1)).alias("received"), F.count_if("is_poison").alias("poison"))
            self.counts.write(received.withColumns(tallies), batch_id)
        finally:
            both.unpersist()

    def run(self, source: str | DataFrame, files_per_trigger: int | None = None) -> None:
        """Work through what has arrived since the last run: files below a path, or any stream with the
        log's columns, such as a broker's.

        A cap on files per batch asks for files that follow the offsets, as a broker delivers them.
        """
        stream = logs.stream_log(self.spark, source, files_per_trigger) if isinstance(source, str) else source
        self.run_available(stream)

    def consume(self, deliveries: list[DataFrame]) -> ScoreStream:
        """Deliver slices of a log one after the other and process each."""
        path = f"{self.root}/in"
        for part in deliveries:
            deliver(part, path)
            self.run(path)
        return self

    def compact(self) -> None:
        """Fold the small files of batches that cannot run again; call it while the stream rests."""
        up_to = self.safe()
        if up_to >= 0:
            self.events.compact(up_to)
            self.views.compact(up_to, ["match_id"])

    def view(self) -> DataFrame:
        return self.views.latest(["match_id"])

    def store(self) -> DataFrame:
        return self.events.read().drop(BATCH, BUCKET)


class DeadLetterStream(Stream):
    """Dead letters: notify, then count; every record is consumed."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        super().__init__(spark, root)
        self.notifications = Ledger(spark, f"{self.root}/notifications", NOTIFICATION_SCHEMA)
        self.counts = Ledger(spark, f"{self.root}/counts", T.StructType([T.StructField("dlt", T.LongType())]))

    def process(self, batch: DataFrame, batch_id: int) -> None:
        self.notifications.write(notifications(logs.dead_letter_rows(batch)), batch_id)
        written = self.notifications.batch(batch_id)
        self.counts.write(written.agg(F.count(F.lit(1)).alias("dlt")), batch_id)

    def consume(self, deliveries: list[DataFrame]) -> DeadLetterStream:
        path = f"{self.root}/in"
        for part in deliveries:
            deliver(part, path)
            self.run_available(logs.stream_log(self.spark, path))
        return self


def notifications(rows: DataFrame) -> DataFrame:
    """Alert rows of dead letters; absent error headers stay null."""
    return rows.select(
        F.col("key").alias("match_id"),
        "partition",
        "offset",
        F.col("value").alias("payload"),
        "error_fqcn",
        "error_message",
    )
