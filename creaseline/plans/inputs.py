"""Inputs shared by the queries, as DataFrames and as the SQL that derives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from creaseline.operators.store import first_arrivals
from creaseline.operators.view import live_view
from creaseline.sources import feed as feed_source
from creaseline.sources.feed import ARRIVAL_ORDER
from creaseline.sources.log import to_log
from creaseline.sources.tables import table


def balls(spark: SparkSession, folder: str) -> DataFrame:
    return feed_source.balls(table(spark, folder, "events"))


def feed(spark: SparkSession, folder: str) -> DataFrame:
    return feed_source.feed(balls(spark, folder))


def offset_feed(spark: SparkSession, folder: str) -> DataFrame:
    return feed_source.with_offsets(feed(spark, folder))


def log(spark: SparkSession, folder: str) -> DataFrame:
    """The feed in log form: unreadable deliveries carry broken JSON; every third has no trace."""
    rows = offset_feed(spark, folder)
    trace = F.when(F.col("src_id") % 3 != 0, F.concat(F.lit("t-"), F.col("src_id").cast("string")))
    broken = F.col("kind") == feed_source.POISON
    out = to_log(rows, trace).withColumn("value", F.when(broken, "{not-valid-json}").otherwise(F.col("value")))
    return out.select("topic", "partition", "offset", F.col("arrival").alias("timestamp"), "key", "value", "headers")


def sequenced(spark: SparkSession, folder: str) -> DataFrame:
    return feed_source.sequenced(feed(spark, folder))


def accepted(spark: SparkSession, folder: str) -> DataFrame:
    return first_arrivals(sequenced(spark, folder), order=ARRIVAL_ORDER)


def view(spark: SparkSession, folder: str) -> DataFrame:
    return live_view(accepted(spark, folder), ARRIVAL_ORDER)


SQL_BALLS = """
WITH numbered AS (
  SELECT event_id AS src_id, ts, user_id, event_type, CAST(floor(value) AS BIGINT) AS v,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn
  FROM events),
placed AS (
  SELECT src_id, ts, user_id,
         CASE WHEN rn < 36 THEN 1 ELSE 2 END AS inning,
         CASE WHEN rn < 36 THEN rn ELSE rn - 36 END AS k,
         CASE WHEN v % 6 = 5 THEN 6 ELSE v % 6 END AS runs,
         CASE WHEN event_type = 'view' THEN v % 3 END AS extras,
         event_type = 'error' AS wicket
  FROM numbered),
balls AS (
  SELECT CAST(src_id AS VARCHAR) AS event_id, 'M-' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS match_id,
         CAST(inning AS INTEGER) AS inning, CAST(k // 6 AS INTEGER) AS over_no, CAST(k % 6 + 1 AS INTEGER) AS ball,
         CASE WHEN inning = 1 THEN 'A' ELSE 'B' END AS team,
         CAST(runs AS INTEGER) AS runs, CAST(extras AS INTEGER) AS extras, wicket,
         CAST(sum(runs) OVER w AS INTEGER) AS total_runs,
         CAST(sum(CAST(wicket AS INTEGER)) OVER w AS INTEGER) AS wickets,
         CASE src_id % 3 WHEN 0 THEN CAST(date_trunc('second', placed.ts) AS TIMESTAMP)
                         WHEN 1 THEN CAST(date_trunc('millisecond', placed.ts) AS TIMESTAMP) ELSE placed.ts END AS ts,
         CASE WHEN src_id % 7 = 0 THEN placed.ts + INTERVAL 2 HOUR ELSE placed.ts END AS arrival, src_id, user_id
  FROM placed
  WINDOW w AS (PARTITION BY user_id, inning ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

SQL_FEED = (
    SQL_BALLS
    + """,
feed AS (
  SELECT b.event_id || CASE WHEN kind = 2 THEN '-c' ELSE '' END AS event_id, match_id, inning, over_no, ball, team,
         CAST(CASE WHEN kind = 2 THEN (runs + 1) % 7 ELSE runs END AS INTEGER) AS runs,
         extras, wicket, total_runs, wickets, ts,
         arrival + CASE kind WHEN 1 THEN INTERVAL 1 MINUTE WHEN 2 THEN INTERVAL 5 MINUTE
                   WHEN 3 THEN INTERVAL 10 MINUTE ELSE INTERVAL 0 MINUTE END AS arrival,
         kind, src_id, CAST(user_id % 192 AS INTEGER) AS "partition"
  FROM balls b CROSS JOIN (VALUES (0), (1), (2), (3)) AS kinds(kind)
  WHERE kind = 0 OR (kind = 1 AND src_id % 10 = 0) OR (kind = 2 AND src_id % 25 = 0) OR (kind = 3 AND src_id % 40 = 0)),
sequenced AS (
  SELECT *, inning || '#' || CASE WHEN over_no < 10 THEN '0' ELSE '' END || over_no || '#' || ball AS event_sequence
  FROM feed WHERE kind <> 3)"""
)

SQL_ACCEPTED = (
    SQL_FEED
    + """,
accepted AS (
  SELECT * FROM sequenced
  QUALIFY row_number() OVER (PARTITION BY match_id, event_sequence ORDER BY arrival, kind, src_id) = 1)"""
)

SQL_VIEW = (
    SQL_ACCEPTED
    + """,
live AS (
  SELECT match_id, total_runs, wickets, inning AS current_inning, over_no AS current_over, ball AS current_ball,
         runs AS last_ball_runs, wicket AS is_wicket, ts AS last_updated
  FROM accepted QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY arrival DESC, kind DESC, src_id DESC) = 1)"""
)

SQL_LOG = (
    SQL_FEED
    + """,
log AS (
  SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY arrival, kind, src_id) - 1 AS "offset",
         CASE WHEN src_id % 3 <> 0 THEN 't-' || src_id ELSE '' END AS trace_id,
         extract('microseconds' FROM ts) % 1000000 AS fraction,
         strftime(ts, '%Y-%m-%dT%H:%M:%S')
         || CASE WHEN fraction = 0 THEN '' WHEN fraction % 1000 = 0 THEN '.' || lpad(CAST(fraction // 1000 AS VARCHAR), 3, '0')
                 ELSE '.' || lpad(CAST(fraction AS VARCHAR), 6, '0') END || 'Z' AS iso,
         '{"eventId":"' || event_id || '","matchId":"' || match_id || '","inning":' || inning || ',"over":' || over_no
         || ',"ball":' || ball || ',"team":"' || team || '","runs":' || runs
         || CASE WHEN extras IS NULL THEN '' ELSE ',"extras":' || extras END
         || ',"wicket":' || CASE WHEN wicket THEN 'true' ELSE 'false' END || ',"totalRuns":' || total_runs
         || ',"wickets":' || wickets || ',"timestamp":"' || iso || '"}' AS json,
         CASE WHEN kind = 3 THEN '{not-valid-json}' ELSE json END AS value
  FROM feed)"""
)
