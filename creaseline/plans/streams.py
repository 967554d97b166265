"""ST: streaming operators, driven over the given tables and read back from their sinks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from creaseline.operators import retry
from creaseline.operators.buckets import BucketTable
from creaseline.operators.replay import replay_log
from creaseline.operators.store import first_arrivals
from creaseline.operators.view import live_view
from creaseline.plans import inputs
from creaseline.plans.aggregates import ACTIVITY_SQL, activity
from creaseline.plans.inputs import SQL_ACCEPTED, SQL_FEED, SQL_LOG, SQL_VIEW
from creaseline.plans.registry import ORACLES, query
from creaseline.plans.sources import STORED_SQL, TTL_SQL, dead_letter_log
from creaseline.plans.writes import RETRY_FAILURES
from creaseline.schemas import LOG_SCHEMA
from creaseline.session import materialize, shared_folder
from creaseline.sources import changes
from creaseline.sources.tables import table
from creaseline.streaming.anomalies import AnomalyStream
from creaseline.streaming.ingest import DeadLetterStream, ScoreStream
from creaseline.streaming.ledger import Ledger, arrivals, deliver, run_available
from creaseline.streaming.retries import RetryStream
from creaseline.streaming.tables import (
    ChangeStream,
    apply_change_table,
    bounded_dedup,
    refresh_days,
    tumbling_metrics,
)

CUTS = ["2024-01-11", "2024-01-21"]
VIEW_ROW = """match_id, total_runs, wickets, inning AS current_inning, over_no AS current_over, ball AS current_ball,
  runs AS last_ball_runs, wicket AS is_wicket, ts AS last_updated"""


def log_slices(spark, folder):
    """The log, written once and cut into three deliveries."""
    return arrivals(materialize(inputs.log(spark, folder)), "timestamp", CUTS)


def full_stream(spark, folder):
    return ScoreStream(spark).consume(log_slices(spark, folder))


@query("st1_ordered_ingest_view", SQL_VIEW + "SELECT * FROM live")
def ordered_ingest_view(spark, folder):
    return full_stream(spark, folder).view()


@query("st1_ordered_ingest_store", SQL_ACCEPTED + f"SELECT {STORED_SQL}, ts AS event_ts, {TTL_SQL} FROM accepted")
def ordered_ingest_store(spark, folder):
    return full_stream(spark, folder).store().drop("partition", "offset")


@query(
    "k9_multi_output",
    SQL_ACCEPTED
    + f""", sliced AS (SELECT *, CASE WHEN arrival < TIMESTAMP '{CUTS[0]}' THEN 0 WHEN arrival < TIMESTAMP '{CUTS[1]}' THEN 1 ELSE 2 END AS batch_id FROM feed),
    a AS (SELECT CASE WHEN arrival < TIMESTAMP '{CUTS[0]}' THEN 0 WHEN arrival < TIMESTAMP '{CUTS[1]}' THEN 1 ELSE 2 END AS batch_id, count(*) AS accepted FROM accepted GROUP BY 1)
    SELECT CAST(batch_id AS BIGINT) AS batch_id, count(*) AS received, count(*) FILTER (kind = 3) AS poison, CAST(0 AS BIGINT) AS dlt, any_value(accepted) AS accepted
    FROM sliced JOIN a USING (batch_id) GROUP BY 1""",
)
def multi_output(spark, folder):
    """One batch to several sinks; the counters are written last, keyed by the same batch."""
    return full_stream(spark, folder).counts.read()


@query("st2_idempotent_redelivery", SQL_VIEW + "SELECT * FROM live")
def idempotent_redelivery(spark, folder):
    """The first two deliveries come a second time; nothing changes."""
    slices = log_slices(spark, folder)
    return ScoreStream(spark).consume([*slices, slices[0], slices[1]]).view()


@query("st2_bounded_dedup", SQL_FEED + "SELECT DISTINCT match_id, event_sequence FROM sequenced")
def bounded(spark, folder):
    rows = materialize(inputs.sequenced(spark, folder).select("match_id", "event_sequence", "arrival"))
    return bounded_dedup(spark, arrivals(rows, "arrival", CUTS), ["match_id", "event_sequence"], "1 hour")


SQL_ATTEMPTS = (
    SQL_LOG
    + f""", tried AS (SELECT l.*, inning || '#' || CASE WHEN over_no < 10 THEN '0' ELSE '' END || over_no || '#' || ball AS event_sequence,
      {RETRY_FAILURES} AS failures FROM log l WHERE kind <> 3),
    attempts AS (SELECT t.*, attempt,
      arrival + CASE attempt WHEN 1 THEN INTERVAL 0 SECOND WHEN 2 THEN INTERVAL 1 SECOND WHEN 3 THEN INTERVAL 6 SECOND ELSE INTERVAL 21 SECOND END AS due_at,
      CASE WHEN attempt > failures THEN 'ok' WHEN attempt = 4 THEN 'dlt' ELSE 'retry' END AS status
      FROM tried t JOIN (VALUES (1), (2), (3), (4)) AS n(attempt) ON attempt <= least(failures + 1, 4)),
    settled AS (SELECT * FROM attempts WHERE status = 'ok'),
    first_settled AS (SELECT * FROM settled
      QUALIFY row_number() OVER (PARTITION BY match_id, event_sequence ORDER BY due_at, "partition", "offset") = 1)"""
)


def injected():
    """(failures, error class): every 31st event fails twice, every 97th always."""
    number = F.split("event_id", "-")[0].cast("long")
    failures = F.when(number % 97 == 0, 4).when(number % 31 == 0, 2).otherwise(0)
    return failures, F.lit("java.lang.RuntimeException")


def attempt_rows(spark, folder):
    from creaseline.sources.feed import with_offsets, sequenced

    rows = with_offsets(inputs.feed(spark, folder))
    return retry.attempts(sequenced(rows), *injected())


@query(
    "st3_retry_attempts",
    SQL_ATTEMPTS + """SELECT event_id, kind, attempt, due_at, status, CASE WHEN status <> 'ok' THEN 'java.lang.RuntimeException' END AS error_class FROM attempts""",
)
def retry_attempts(spark, folder):
    return attempt_rows(spark, folder).select("event_id", "kind", "attempt", "due_at", "status", "error_class")


RETRY_VIEW_SQL = SQL_ATTEMPTS + f"""SELECT {VIEW_ROW} FROM first_settled
    QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY due_at DESC, "partition" DESC, "offset" DESC) = 1"""


@query("st3_retry_effective_view", RETRY_VIEW_SQL)
def retry_effective_view(spark, folder):
    order = ["effective_arrival", "partition", "offset"]
    settled = retry.settled(attempt_rows(spark, folder))
    return live_view(first_arrivals(settled, order=order), order)


@query("st3_retry_stream", RETRY_VIEW_SQL)
def retry_stream(spark, folder):
    return RetryStream(spark, *injected()).consume(log_slices(spark, folder)).view()


@query("st3_retry_late_delivery", RETRY_VIEW_SQL)
def retry_late_delivery(spark, folder):
    """The first delivery comes last, and again with the second: nothing is lost, and the view is the same."""
    first, second, third = log_slices(spark, folder)
    return RetryStream(spark, *injected()).consume([third, second, first.unionByName(second)]).view()


@query("st3_retry_store", SQL_ATTEMPTS + f"SELECT {STORED_SQL}, ts AS event_ts, {TTL_SQL}, due_at AS effective_arrival FROM first_settled")
def retry_store(spark, folder):
    """Every ball that any attempt stored, under its first effective arrival, from deliveries out of order."""
    first, second, third = log_slices(spark, folder)
    return RetryStream(spark, *injected()).consume([second, first, third]).store().drop("partition", "offset")


@query(
    "st3_retry_exhausted",
    SQL_ATTEMPTS + """SELECT event_id, event_sequence, "partition", "offset", due_at AS effective_arrival FROM attempts WHERE status = 'dlt'""",
)
def retry_exhausted(spark, folder):
    dead = RetryStream(spark, *injected()).consume(log_slices(spark, folder)).dead.read()
    return dead.select("event_id", "event_sequence", "partition", "offset", "effective_arrival")


def dead_letters(spark, folder):
    rows = materialize(dead_letter_log(spark, folder).select(*LOG_SCHEMA.fieldNames()))
    return DeadLetterStream(spark).consume(arrivals(rows, "timestamp", CUTS))


@query("st4_dead_letter_consumer", ORACLES["k5_dead_letter_notifications"])
def dead_letter_consumer(spark, folder):
    return dead_letters(spark, folder).notifications.read().drop("batch_id")


@query("st4_dead_letter_count", SQL_FEED + "SELECT count(*) AS dlt FROM feed WHERE src_id % 97 = 0 AND kind <> 3")
def dead_letter_count(spark, folder):
    return dead_letters(spark, folder).counts.read().agg(F.sum("dlt").alias("dlt"))


def replayed_log(spark, folder):
    stored = replay_log(inputs.accepted(spark, folder))
    rows = stored.withColumn("timestamp", F.col("arrival"))
    return materialize(rows.select(*LOG_SCHEMA.fieldNames()))


@query("st5_replay_rebuild", ORACLES["a1_live_score_by_sequence"])
def replay_rebuild(spark, folder):
    """Stored balls replayed in playing order into a fresh store: the view ends at the furthest ball."""
    return ScoreStream(spark).consume([replayed_log(spark, folder)]).view()


@query(
    "st5_replay_on_full_store",
    SQL_ACCEPTED + "SELECT count(*) AS received, CAST(0 AS BIGINT) AS accepted FROM accepted",
)
def replay_on_full_store(spark, folder):
    """On a store that has the balls already, every replayed record is a duplicate."""
    stream = full_stream(spark, folder).consume([replayed_log(spark, folder)])
    last = stream.counts.read().agg(F.max_by(F.struct("received", "accepted"), "batch_id").alias("c"))
    return last.select("c.*")


@query(
    "st6_consumer_lag",
    SQL_LOG
    + f"""SELECT "partition", max("offset") + 1 AS end_offset, count(*) FILTER (arrival < TIMESTAMP '{CUTS[1]}') AS committed,
    count(*) FILTER (arrival >= TIMESTAMP '{CUTS[1]}') AS lag, count(*) FILTER (arrival >= TIMESTAMP '{CUTS[1]}') > 5000 AS scale_out,
    count(*) FILTER (arrival >= TIMESTAMP '{CUTS[1]}') > 10000 AS alarm FROM log GROUP BY 1""",
)
def consumer_lag(spark, folder):
    """Lag per log partition of a consumer that committed up to the last delivery."""
    log = inputs.log(spark, folder).select("partition", "offset", "timestamp")
    seen = F.col("timestamp") < F.lit(CUTS[1]).cast("timestamp_ntz")
    ends = log.groupBy("partition").agg(
        (F.max("offset") + 1).alias("end_offset"),
        F.coalesce(F.max(F.when(seen, F.col("offset"))) + 1, F.lit(0)).alias("committed"),
    )
    lag = F.col("end_offset") - F.col("committed")
    return ends.select("*", lag.alias("lag"), (lag > 5000).alias("scale_out"), (lag > 10000).alias("alarm"))


@query(
    "st6_stream_progress",
    SQL_FEED
    + f"""SELECT CASE WHEN arrival < TIMESTAMP '{CUTS[0]}' THEN 0::BIGINT WHEN arrival < TIMESTAMP '{CUTS[1]}' THEN 1 ELSE 2 END AS batch_id,
    count(*) AS input_rows FROM feed GROUP BY 1""",
)
def stream_progress(spark, folder):
    """Rows per batch, as recorded when the batch was finished."""
    return full_stream(spark, folder).progress.read().select("batch_id", "input_rows")


APPLIED_SQL = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 10 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 10 <> 0"""


@query("st7_change_apply", APPLIED_SQL)
def change_apply(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    stored = BucketTable.create(orders, ["o_orderkey"])
    return apply_change_table(stored, changes.order_changes(orders).where("sequence > 0")).read()


@query("st7_change_apply_stream", APPLIED_SQL)
def change_apply_stream(spark, folder):
    log = materialize(changes.order_changes(table(spark, folder, "orders")))
    deliveries = [log.where(F.col("sequence") == n) for n in range(3)]
    return ChangeStream(spark).consume(deliveries).table().withColumnRenamed("change_key", "o_orderkey")


def event_slices(spark, folder):
    return arrivals(table(spark, folder, "events"), "ts", ["2024-01-11 00:02:00", "2024-01-21 00:03:00"])


def period_sql(seconds: int) -> str:
    return f"""SELECT make_timestamp(epoch_us(ts) // {seconds}000000 * {seconds}000000) AS period_start, event_type, count(*) AS n,
    count(*) FILTER (event_type = 'error') AS errors, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total, max(value) AS highest
    FROM events GROUP BY 1, 2"""


@query("st8_tumbling_5_minutes", period_sql(300))
def tumbling_5_minutes(spark, folder):
    metrics = tumbling_metrics(spark, event_slices(spark, folder), "5 minutes", "10 minutes")
    return metrics.withColumn("period_start", F.col("period_start").cast("timestamp_ntz"))


@query("st8_tumbling_1_minute", period_sql(60))
def tumbling_1_minute(spark, folder):
    metrics = tumbling_metrics(spark, event_slices(spark, folder), "1 minute", "10 minutes")
    return metrics.withColumn("period_start", F.col("period_start").cast("timestamp_ntz"))


ANOMALY_SQL = """WITH b AS (SELECT event_type, epoch_us(ts) // 3600000000 AS step, count(*) AS n FROM events GROUP BY 1, 2),
    t AS (SELECT *, avg(n) OVER w AS mean, stddev_samp(n) OVER w AS sd, count(*) OVER w AS seen FROM b
      WINDOW w AS (PARTITION BY event_type ORDER BY step ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
    a AS (SELECT event_type, step, n, coalesce(seen >= 8 AND n > mean + 1.9876::DOUBLE * sd, false) AS anomaly FROM t),
    r AS (SELECT *, CAST(sum(anomaly::INTEGER) OVER (PARTITION BY event_type ORDER BY step RANGE BETWEEN 11 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent FROM a)
    SELECT event_type, step, n, anomaly, recent, recent > 1 AS alert FROM r"""


@query("st9_bucketed_anomalies", ANOMALY_SQL)
def bucketed_anomalies(spark, folder):
    """Buckets that lie far above the trailing day, and an alert when they cluster.

    The windows run over one row per bucket and host, so they grow with time and not with the data.
    """
    step = F.expr("unix_seconds(CAST(ts AS TIMESTAMP)) div 3600").alias("step")
    buckets = table(spark, folder, "events").groupBy("event_type", step).agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("event_type").orderBy("step")
    trailing = order.rowsBetween(-24, -1)
    high = F.col("n") > F.avg("n").over(trailing) + 1.9876 * F.stddev_samp("n").over(trailing)
    anomaly = F.coalesce((F.count("n").over(trailing) >= 8) & high, F.lit(False))
    flagged = buckets.withColumn("anomaly", anomaly)
    recent = F.sum(F.col("anomaly").cast("int")).over(order.rangeBetween(-11, 0))
    return flagged.withColumn("recent", recent).withColumn("alert", F.col("recent") > 1)


@query("st9_anomaly_stream", ANOMALY_SQL)
def anomaly_stream(spark, folder):
    """The same buckets from a stream that is stopped and opened again between its deliveries."""
    root = shared_folder(spark)
    for part in event_slices(spark, folder):
        seen = AnomalyStream(spark, "1 hour", root=root)
        seen.consume([part.select(F.col("event_type").alias("host"), "ts")])
    seen.close_all()
    return seen.buckets.read().select(F.col("host").alias("event_type"), F.expr("period div 3600").alias("step"), "n", "anomaly", "recent", "alert")


@query("st10_processed_feed", SQL_ACCEPTED + "SELECT match_id, event_sequence, event_id, total_runs FROM accepted")
def processed_feed(spark, folder):
    return full_stream(spark, folder).feed.read().drop("batch_id")


@query("st11_incremental_refresh", ACTIVITY_SQL)
def incremental_refresh(spark, folder):
    events = table(spark, folder, "events")
    cut = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    return refresh_days(spark, events.where(F.col("ts") < cut), events.where(F.col("ts") >= cut), activity)


@query("st12_rate_cap", SQL_FEED + "SELECT count(*) AS received, true AS capped FROM feed")
def rate_cap(spark, folder):
    """At most two files of the log per batch."""
    root = shared_folder(spark)
    deliver(inputs.log(spark, folder).repartition(6), f"{root}/in")
    schema = spark.createDataFrame([], "files bigint, received bigint").schema
    seen = Ledger(spark, f"{root}/seen", schema)

    def tally(batch, batch_id):
        counted = batch.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n"))
        seen.write(counted.agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("received")), batch_id)

    stream = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    run_available(stream, tally, f"{root}/checkpoint")
    batches = seen.read()
    return batches.agg(F.sum("received").alias("received"), (F.max("files") <= 2).alias("capped"))
