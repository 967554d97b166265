"""S: scans and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from creaseline.functions.scalars import header
from creaseline.operators import scans
from creaseline.operators.store import from_items, stored_rows, to_items
from creaseline.plans import inputs
from creaseline.plans.inputs import SQL_ACCEPTED, SQL_FEED, SQL_LOG, SQL_VIEW
from creaseline.plans.registry import query
from creaseline.session import materialize, shared_folder
from creaseline.sources import changes, log as logs
from creaseline.sources.tables import table

MATCH = "M-000007"
STORED_SQL = """match_id, event_sequence, event_id, inning, over_no, ball, team, runs, extras, wicket, total_runs, wickets"""
TTL_SQL = "CAST(epoch(date_trunc('second', ts)) AS BIGINT) + 7776000 AS ttl"


@query(
    "s1_topic_scan",
    SQL_LOG + """SELECT 'ball-events' AS topic, "partition", "offset", arrival AS "timestamp", match_id AS key, value FROM log""",
)
def topic_scan(spark, folder):
    path = shared_folder(spark)
    materialize(inputs.log(spark, folder), path)
    return logs.read_log(spark, path).drop("headers")


@query(
    "s2_header_extraction",
    SQL_LOG
    + """SELECT "partition", "offset", trace_id, match_id AS match_header, event_id AS event_header,
    CAST(NULL AS VARCHAR) AS absent_header FROM log""",
)
def header_extraction(spark, folder):
    return inputs.log(spark, folder).select(
        "partition",
        "offset",
        header("X-Trace-Id").alias("trace_id"),
        header("X-Match-Id").alias("match_header"),
        header("X-Event-Id").alias("event_header"),
        header("X-Not-There").alias("absent_header"),
    )


@query(
    "s3_decode",
    SQL_LOG
    + """SELECT "partition", "offset", event_id, match_id, inning, over_no, ball, team, runs, extras, wicket,
    total_runs, wickets, ts FROM log WHERE kind <> 3""",
)
def decode(spark, folder):
    ok, _ = logs.decode(inputs.log(spark, folder))
    return ok


@query("s3_poison_split", SQL_LOG + """SELECT "partition", "offset", match_id AS key, value FROM log WHERE kind = 3""")
def poison_split(spark, folder):
    _, poison = logs.decode(inputs.log(spark, folder))
    return poison.select("partition", "offset", "key", "value")


def dead_letter_log(spark, folder):
    """Deliveries whose four attempts all fail (every 97th event), in the dead-letter envelope."""
    rows = inputs.log(spark, folder).withColumn("event", header("X-Event-Id"))
    number = F.split("event", "-")[0].cast("long")
    failing = rows.where((number % 97 == 0) & (F.col("value") != "{not-valid-json}"))
    return logs.to_dead_letters(
        failing, F.lit("java.lang.RuntimeException"), F.concat(F.lit("store unavailable for "), F.col("key"))
    ).drop("event")


@query(
    "s4_dead_letter_scan",
    SQL_LOG
    + """SELECT 'ball-events-dlt' AS topic, "partition", "offset", match_id AS key, value,
    'store unavailable for ' || match_id AS error_message, 'java.lang.RuntimeException' AS error_fqcn,
    'ball-events' AS original_topic, CAST("offset" AS VARCHAR) AS original_offset
    FROM log WHERE src_id % 97 = 0 AND kind <> 3""",
)
def dead_letter_scan(spark, folder):
    stored = materialize(dead_letter_log(spark, folder))
    return logs.dead_letter_rows(stored).drop("headers", "timestamp")


def store(spark, folder):
    return stored_rows(inputs.accepted(spark, folder))


def stored_table(spark, folder, *by):
    """The store as a table, laid out by match and sequence or as asked for."""
    return scans.laid_out(store(spark, folder), *(by or ("match_id", "event_sequence")))


@query(
    "s5_match_events",
    SQL_ACCEPTED + f"SELECT {STORED_SQL}, ts AS event_ts, {TTL_SQL} FROM accepted WHERE match_id = '{MATCH}'",
)
def match_events(spark, folder):
    return scans.match_events(stored_table(spark, folder), MATCH)


@query("s6_point_get", SQL_VIEW + f"SELECT * FROM live WHERE match_id = '{MATCH}'")
def point_get(spark, folder):
    return scans.point_get(scans.laid_out(inputs.view(spark, folder), "match_id"), MATCH)


@query(
    "s6_batch_get",
    SQL_VIEW
    + """SELECT * FROM live WHERE match_id IN (SELECT 'M-' || lpad(CAST(user_id AS VARCHAR), 6, '0')
    FROM events WHERE event_type = 'purchase' AND value > 150)""",
)
def batch_get(spark, folder):
    buyers = table(spark, folder, "events").where("event_type = 'purchase' AND value > 150")
    keys = buyers.select(F.concat(F.lit("M-"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("match_id"))
    return scans.batch_get(scans.laid_out(inputs.view(spark, folder), "match_id"), keys)


@query(
    "s7_index_match_time",
    SQL_ACCEPTED
    + f"""SELECT match_id, event_sequence, event_id, ts AS event_ts FROM accepted WHERE match_id = '{MATCH}'
    AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'""",
)
def index_match_time(spark, folder):
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-05", "2024-01-12"))
    found = scans.by_match_and_time(stored_table(spark, folder), MATCH, start, end)
    return found.select("match_id", "event_sequence", "event_id", "event_ts")


@query("s7_index_event_id", SQL_ACCEPTED + "SELECT match_id, event_sequence, event_id, runs FROM accepted WHERE event_id = '77'")
def index_event_id(spark, folder):
    return scans.by_event_id(stored_table(spark, folder, "event_id"), "77").select("match_id", "event_sequence", "event_id", "runs")


CHANGES_SQL = """WITH changes AS (
  SELECT o_orderkey AS change_key, 0 AS sequence, 'c' AS op, NULL AS before_status, NULL AS before_price,
         o_orderstatus AS after_status, o_totalprice AS after_price FROM orders
  UNION ALL SELECT o_orderkey, 1, 'u', o_orderstatus, o_totalprice, 'U', o_totalprice + 10 FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, 2, 'd', CASE WHEN o_orderkey % 3 = 0 THEN 'U' ELSE o_orderstatus END,
         CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 10 ELSE o_totalprice END, NULL, NULL
  FROM orders WHERE o_orderkey % 10 = 0) """


@query("s8_change_feed", CHANGES_SQL + "SELECT * FROM changes")
def change_feed(spark, folder):
    decoded = changes.read_changes(changes.order_changes(table(spark, folder, "orders")))
    return decoded.select(
        "change_key",
        "sequence",
        "op",
        F.col("before.o_orderstatus").alias("before_status"),
        F.col("before.o_totalprice").alias("before_price"),
        F.col("after.o_orderstatus").alias("after_status"),
        F.col("after.o_totalprice").alias("after_price"),
    )


@query("s9_import_items", SQL_ACCEPTED + f"SELECT {STORED_SQL}, {TTL_SQL} FROM accepted")
def import_items(spark, folder):
    path = shared_folder(spark)
    items = to_items(store(spark, folder)).select("Item")
    items.write.json(path)
    return from_items(spark.read.schema(items.schema).json(path))


@query(
    "s10_scatter_gather",
    """SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_custkey % 3 AS INTEGER) AS shard FROM orders
    WHERE o_totalprice > 100000""",
)
def scatter_gather(spark, folder):
    root = shared_folder(spark)
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    orders.withColumn("s", F.col("o_custkey") % 3).write.partitionBy("s").parquet(root)
    shards = scans.gather(spark, [f"{root}/s={i}" for i in range(3)], orders.schema)
    return shards.where("o_totalprice > 100000")
