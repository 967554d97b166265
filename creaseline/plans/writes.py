"""K: sinks and table writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from creaseline.operators import retry, writes
from creaseline.operators.buckets import BucketTable
from creaseline.operators.replay import replay_log
from creaseline.operators.store import accept, first_arrivals, stored_rows, to_items
from creaseline.operators.transfers import guarded_transfers
from creaseline.operators.view import live_view
from creaseline.plans import inputs
from creaseline.plans.inputs import SQL_ACCEPTED, SQL_BALLS, SQL_FEED, SQL_LOG, SQL_VIEW
from creaseline.plans.registry import query
from creaseline.plans.sources import CHANGES_SQL, MATCH, STORED_SQL, TTL_SQL, dead_letter_log, store
from creaseline.streaming.ingest import notifications
from creaseline.session import materialize, shared_folder
from creaseline.sources import changes, log as logs
from creaseline.sources.feed import ARRIVAL_ORDER
from creaseline.sources.tables import table

CUTOFF = "2024-01-15"


@query(
    "k1_publish",
    SQL_LOG
    + """SELECT 'ball-events' AS topic, match_id AS key, json AS value,
    'X-Trace-Id=' || trace_id || ',X-Match-Id=' || match_id || ',X-Event-Id=' || event_id AS headers
    FROM log WHERE kind = 0""",
)
def publish(spark, folder):
    rows = inputs.balls(spark, folder)
    trace = F.when(F.col("src_id") % 3 != 0, F.concat(F.lit("t-"), F.col("src_id").cast("string")))
    text = F.transform("headers", lambda h: F.concat(h["key"], F.lit("="), h["value"].cast("string")))
    sent = materialize(logs.to_log(rows, trace).select("topic", "key", "value", "headers"))
    return sent.select("topic", "key", "value", F.array_join(text, ",").alias("headers"))


ACCEPT_COLUMNS = ["match_id", "event_sequence", "event_id", "runs", "total_runs", "arrival", "kind"]
ACCEPT_SQL = ", ".join(ACCEPT_COLUMNS)


@query("k2_first_write_wins", SQL_ACCEPTED + f"SELECT {ACCEPT_SQL} FROM accepted")
def first_write_wins(spark, folder):
    accepted, _ = accept(inputs.sequenced(spark, folder), order=ARRIVAL_ORDER)
    return accepted.select(*ACCEPT_COLUMNS)


@query(
    "k2_duplicates",
    SQL_FEED
    + f"""SELECT {ACCEPT_SQL} FROM sequenced
    QUALIFY row_number() OVER (PARTITION BY match_id, event_sequence ORDER BY arrival, kind, src_id) > 1""",
)
def duplicates(spark, folder):
    _, dups = accept(inputs.sequenced(spark, folder), order=ARRIVAL_ORDER)
    return dups.select(*ACCEPT_COLUMNS)


@query(
    "k2_by_event_id",
    SQL_FEED
    + f"""SELECT {ACCEPT_SQL} FROM sequenced
    QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY arrival, kind, src_id) = 1""",
)
def by_event_id(spark, folder):
    return first_arrivals(inputs.sequenced(spark, folder), ["event_id"], ARRIVAL_ORDER).select(*ACCEPT_COLUMNS)


def halves(spark, folder):
    """Store and view of the first weeks, and the deliveries after them."""
    rows = inputs.sequenced(spark, folder)
    early = F.col("arrival") < F.lit(CUTOFF).cast("timestamp_ntz")
    return first_arrivals(rows.where(early), order=ARRIVAL_ORDER), rows.where(~early)


@query(
    "k2_against_store",
    SQL_FEED
    + f""", stored AS (
      SELECT * FROM sequenced WHERE arrival < TIMESTAMP '{CUTOFF}'
      QUALIFY row_number() OVER (PARTITION BY match_id, event_sequence ORDER BY arrival, kind, src_id) = 1)
    SELECT {ACCEPT_SQL} FROM sequenced s WHERE arrival >= TIMESTAMP '{CUTOFF}'
    AND NOT EXISTS (SELECT 1 FROM stored t WHERE t.match_id = s.match_id AND t.event_sequence = s.event_sequence)
    QUALIFY row_number() OVER (PARTITION BY match_id, event_sequence ORDER BY arrival, kind, src_id) = 1""",
)
def against_store(spark, folder):
    stored, batch = halves(spark, folder)
    accepted, _ = accept(batch, stored, order=ARRIVAL_ORDER)
    return accepted.select(*ACCEPT_COLUMNS)


@query("k3_live_view_upsert", SQL_VIEW + "SELECT * FROM live")
def live_view_upsert(spark, folder):
    stored, batch = halves(spark, folder)
    accepted, _ = accept(batch, stored, order=ARRIVAL_ORDER)
    view = BucketTable.create(live_view(stored, ARRIVAL_ORDER), ["match_id"])
    view.upsert(live_view(accepted, ARRIVAL_ORDER))
    return view.read()


RETRY_FAILURES = "CASE WHEN src_id % 97 = 0 THEN 4 WHEN src_id % 31 = 0 THEN 2 ELSE 0 END"


@query(
    "k4_dead_letter_write",
    SQL_LOG
    + """SELECT 'ball-events-dlt' AS topic, "partition", "offset", match_id AS key, value,
    'X-Trace-Id=' || trace_id || ',X-Match-Id=' || match_id || ',X-Event-Id=' || event_id
    || ',kafka_dlt-exception-message=store unavailable for ' || match_id
    || ',kafka_dlt-exception-fqcn=java.lang.RuntimeException,kafka_dlt-original-topic=ball-events'
    || ',kafka_dlt-original-offset=' || "offset" AS headers
    FROM log WHERE src_id % 97 = 0 AND kind <> 3""",
)
def dead_letter_write(spark, folder):
    written = materialize(dead_letter_log(spark, folder))
    text = F.transform("headers", lambda h: F.concat(h["key"], F.lit("="), h["value"].cast("string")))
    return written.select("topic", "partition", "offset", "key", "value", F.array_join(text, ",").alias("headers"))


@query(
    "k5_dead_letter_notifications",
    SQL_LOG
    + """SELECT match_id, "partition", "offset", value AS payload, 'java.lang.RuntimeException' AS error_fqcn,
    'store unavailable for ' || match_id AS error_message FROM log WHERE src_id % 97 = 0 AND kind <> 3""",
)
def dead_letter_notifications(spark, folder):
    return notifications(logs.dead_letter_rows(dead_letter_log(spark, folder)))


@query(
    "k6_replay_publish",
    SQL_ACCEPTED
    + f""" SELECT 'ball-events-replay' AS topic, match_id AS key, event_sequence, event_id,
    row_number() OVER (PARTITION BY match_id ORDER BY inning, over_no, ball) - 1 AS "offset"
    FROM accepted WHERE match_id = '{MATCH}'""",
)
def replay_publish(spark, folder):
    one = inputs.accepted(spark, folder).where(F.col("match_id") == MATCH)
    return replay_log(one).select("topic", "key", "event_sequence", "event_id", "offset")


@query(
    "k7_replay_state",
    SQL_ACCEPTED
    + """, requests AS (
      SELECT 'M-' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS match_id, user_id, event_id AS request_id
      FROM events WHERE event_type = 'signup' AND value > 100),
    judged AS (
      SELECT r.match_id, request_id, user_id % 5 <> 0
             AND request_id = min(request_id) OVER (PARTITION BY r.match_id) AS granted, n
      FROM requests r LEFT JOIN (SELECT match_id, count(*) AS n FROM accepted GROUP BY 1) t USING (match_id))
    SELECT match_id, request_id, CASE WHEN granted THEN 202 ELSE 409 END AS http_status,
           CASE WHEN granted THEN 'STARTED' END AS status, CASE WHEN granted THEN 0 END AS processed,
           CASE WHEN granted THEN CAST(coalesce(n, 0) AS INTEGER) END AS total FROM judged""",
)
def replay_state(spark, folder):
    events = table(spark, folder, "events")
    match_id = F.concat(F.lit("M-"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("match_id")
    requests = events.where("event_type = 'signup' AND value > 100").select(match_id, F.col("event_id").alias("request_id"))
    status = F.when(F.col("user_id") % 5 == 0, "IN_PROGRESS").when(F.col("user_id") % 5 == 1, "COMPLETED").otherwise("FAILED")
    state = events.select("user_id").distinct().select(match_id, status.alias("status"))
    totals = inputs.accepted(spark, folder).groupBy("match_id").agg(F.count(F.lit(1)).alias("total"))
    return writes.start_replays(requests, state, totals)


@query(
    "k7_replay_progress",
    SQL_ACCEPTED
    + """, seated AS (SELECT match_id, row_number() OVER (PARTITION BY match_id ORDER BY inning, over_no, ball) AS place, src_id % 97 = 0 AS fails FROM accepted),
    g AS (SELECT match_id, CAST(max(place) AS INTEGER) AS total, min(place) FILTER (fails) AS bad FROM seated GROUP BY 1),
    t AS (SELECT *, CAST(coalesce(bad - 1, total) AS INTEGER) AS through FROM g)
    SELECT match_id, 'STARTED' AS status, 0 AS processed, total FROM t
    UNION ALL SELECT match_id, 'IN_PROGRESS', 1, total FROM t WHERE through > 0
    UNION ALL SELECT match_id, 'COMPLETED', through, total FROM t WHERE bad IS NULL
    UNION ALL SELECT match_id, 'FAILED', through, total FROM t WHERE bad IS NOT NULL""",
)
def replay_progress(spark, folder):
    """Every match replayed; every 97th ball cannot be published."""
    numbered = replay_log(inputs.accepted(spark, folder))
    balls = numbered.select("match_id", (F.col("offset") + 1).alias("place"), (F.col("src_id") % 97 == 0).alias("fails"))
    granted = balls.groupBy("match_id").agg(F.count(F.lit(1)).cast("int").alias("total"))
    return writes.replay_progress(granted, balls, shared_folder(spark))


def match_documents(spark, folder):
    """Search documents of matches: orders with their venue and home team."""
    orders = table(spark, folder, "orders")
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nations = table(spark, folder, "nation")
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey).join(
        nations, customers.c_nationkey == nations.n_nationkey
    )
    return joined.select(
        F.col("o_orderkey").alias("match_key"),
        F.concat(F.col("c_name"), F.lit(" at "), F.col("n_name")).alias("title"),
        F.struct(F.col("c_name").alias("team_name"), F.col("c_mktsegment").alias("segment")).alias("team"),
        F.struct(F.col("n_name").alias("name")).alias("venue"),
        F.col("o_orderpriority").alias("format"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderdate").alias("start_date"),
    )


DOCUMENT_SQL = """documents_of_matches AS (
  SELECT o_orderkey AS match_key, c_name || ' at ' || n_name AS title, c_name AS team_name, n_name AS venue_name,
         o_orderpriority AS format, o_orderstatus AS status, o_orderdate AS start_date
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def flat_documents(docs):
    return docs.select(
        "match_key",
        "title",
        F.col("team.team_name").alias("team_name"),
        F.col("venue.name").alias("venue_name"),
        "format",
        "status",
        "start_date",
    )


@query("k8_document_reindex", f"WITH {DOCUMENT_SQL} SELECT * FROM documents_of_matches")
def document_reindex(spark, folder):
    return flat_documents(materialize(match_documents(spark, folder)))


@query(
    "k8_document_upsert",
    f"""WITH {DOCUMENT_SQL} SELECT match_key, title, CASE WHEN match_key % 3 = 0 THEN 'U' ELSE status END AS status
    FROM documents_of_matches WHERE match_key % 10 <> 0""",
)
def document_upsert(spark, folder):
    docs = match_documents(spark, folder).select("match_key", "title", "status")
    feed = changes.read_changes(changes.order_changes(table(spark, folder, "orders"))).where("op <> 'c'")
    titled = feed.select(F.col("change_key").alias("match_key"), "sequence", "op", F.col("after.o_orderstatus").alias("status")).join(
        docs.select("match_key", "title"), "match_key"
    )
    stored = BucketTable.create(docs, ["match_key"])
    stored.apply_changes(titled, "sequence", ["title", "status"])
    return stored.read()


def layout(spark, folder, df, by, measures):
    path = shared_folder(spark)
    writes.write_layout(df, path, by)
    return spark.read.parquet(path).groupBy(*by).agg(*measures)


@query(
    "k10_range_quarter",
    """SELECT CAST(year(o_orderdate) AS INTEGER) AS o_year, CAST(quarter(o_orderdate) AS INTEGER) AS o_quarter,
    count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total FROM orders GROUP BY 1, 2""",
)
def range_quarter(spark, folder):
    df = table(spark, folder, "orders").select(
        F.year("o_orderdate").alias("o_year"), F.quarter("o_orderdate").alias("o_quarter"), "o_orderkey", "o_totalprice"
    )
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total")
    return layout(spark, folder, df, ["o_year", "o_quarter"], [F.count(F.lit(1)).alias("n"), total])


# Nation list of each named region partition; everything else goes to the default.
REGION_LISTS = {
    "us": ["NATION_0", "NATION_1"],
    "eu": ["NATION_2", "NATION_3", "NATION_4", "NATION_5", "NATION_6"],
    "asia": ["NATION_7", "NATION_8", "NATION_9", "NATION_10", "NATION_11"],
}
LIST_SQL = (
    "CASE "
    + " ".join("WHEN n_name IN (" + ", ".join(f"'{n}'" for n in ns) + f") THEN '{r}'" for r, ns in REGION_LISTS.items())
    + " ELSE 'other' END"
)


def region_list(name: str):
    out = F
    for region, names in REGION_LISTS.items():
        out = out.when(F.col(name).isin(names), region)
    return out.otherwise("other")


@query(
    "k10_list_category",
    f"""SELECT {LIST_SQL} AS region_list, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
)
def list_category(spark, folder):
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), region_list("n_name").alias("region_list"))
    df = table(spark, folder, "customer").select("c_custkey", "c_nationkey").join(nations, "c_nationkey")
    return layout(spark, folder, df, ["region_list"], [F.count(F.lit(1)).alias("n")])


@query("k10_hash_modulus", "SELECT CAST(user_id % 8 AS INTEGER) AS remainder, count(*) AS n FROM events GROUP BY 1")
def hash_modulus(spark, folder):
    df = table(spark, folder, "events").withColumn("remainder", F.pmod("user_id", F.lit(8)).cast("int"))
    return layout(spark, folder, df, ["remainder"], [F.count(F.lit(1)).alias("n")])


@query(
    "k10_two_level",
    f"""SELECT CAST(year(o_orderdate) AS INTEGER) AS o_year, {LIST_SQL} AS region_list, count(*) AS n
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE year(o_orderdate) = 1997 GROUP BY 1, 2""",
)
def two_level(spark, folder):
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), region_list("n_name").alias("region_list"))
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(nations, "c_nationkey")
    df = table(spark, folder, "orders").join(customers, "o_custkey").select(
        F.year("o_orderdate").alias("o_year"), "region_list", "o_orderkey"
    )
    return layout(spark, folder, df, ["o_year", "region_list"], [F.count(F.lit(1)).alias("n")]).where("o_year = 1997")


@query(
    "k11_export_items",
    SQL_ACCEPTED
    + """ SELECT strftime(ts, '%Y-%m') AS export_month,
    '{"Item":{"matchId":{"S":"' || match_id || '"},"eventSequence":{"S":"' || event_sequence || '"},"eventId":{"S":"' || event_id
    || '"},"inning":{"N":"' || inning || '"},"over":{"N":"' || over_no || '"},"ball":{"N":"' || ball || '"},"team":{"S":"' || team
    || '"},"runs":{"N":"' || runs || '"}' || CASE WHEN extras IS NULL THEN '' ELSE ',"extras":{"N":"' || extras || '"}' END
    || ',"wicket":{"BOOL":' || CASE WHEN wicket THEN 'true' ELSE 'false' END || '},"totalRuns":{"N":"' || total_runs
    || '"},"wickets":{"N":"' || wickets || '"},"ttl":{"N":"' || CAST(epoch(date_trunc('second', ts)) AS BIGINT) + 7776000 || '"}}}' AS value
    FROM accepted""",
)
def export_items(spark, folder):
    path = shared_folder(spark)
    items = to_items(store(spark, folder)).withColumn("export_month", F.date_format("event_ts", "yyyy-MM")).drop("event_ts")
    writes.write_layout(items, path, ["export_month"], "json")
    lines = spark.read.text(path)
    return lines.select("value", F.col("export_month").cast("string").alias("export_month"))


STORE_SHORT = "match_id, event_sequence, event_id"


def event_table(spark, folder):
    """The event store in buckets of its matches."""
    return BucketTable.create(store(spark, folder), ["match_id"])


@query(
    "k12_delete_by_key",
    SQL_ACCEPTED + f"SELECT {STORE_SHORT} FROM accepted WHERE NOT (match_id = '{MATCH}' AND event_sequence = '1#03#4')",
)
def delete_by_key(spark, folder):
    key = (F.col("match_id") == MATCH) & (F.col("event_sequence") == "1#03#4")
    events = event_table(spark, folder)
    events.delete_where(key)
    return events.read().select("match_id", "event_sequence", "event_id")


@query(
    "k12_delete_key_list",
    SQL_ACCEPTED
    + f"""SELECT {STORE_SHORT} FROM accepted WHERE match_id NOT IN
    (SELECT 'M-' || lpad(CAST(user_id AS VARCHAR), 6, '0') FROM events WHERE event_type = 'error' AND value > 150)""",
)
def delete_key_list(spark, folder):
    errors = table(spark, folder, "events").where("event_type = 'error' AND value > 150")
    keys = errors.select(F.concat(F.lit("M-"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("match_id"))
    events = event_table(spark, folder)
    events.delete_keys(keys)
    return events.read().select("match_id", "event_sequence", "event_id")


@query("k12_delete_conditional", SQL_ACCEPTED + f"SELECT {STORE_SHORT} FROM accepted WHERE extras IS NULL OR extras <> 2")
def delete_conditional(spark, folder):
    events = event_table(spark, folder)
    events.delete_where(F.col("extras") == 2)
    return events.read().select("match_id", "event_sequence", "event_id")


@query("k12_delete_match", SQL_ACCEPTED + f"SELECT {STORE_SHORT} FROM accepted WHERE match_id <> '{MATCH}'")
def delete_match(spark, folder):
    events = event_table(spark, folder)
    events.delete_keys(spark.range(1).select(F.lit(MATCH).alias("match_id")))
    return events.read().select("match_id", "event_sequence", "event_id")


@query("k12_delete_by_status", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'")
def delete_by_status(spark, folder):
    orders = BucketTable.create(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"])
    orders.delete_where(F.col("o_orderstatus") == "F")
    return orders.read()


@query(
    "k13_bulk_update",
    """SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'ARCHIVED' ELSE o_orderstatus END AS o_orderstatus
    FROM orders""",
)
def bulk_update(spark, folder):
    orders = BucketTable.create(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate"), ["o_orderkey"])
    old = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    orders.update_where(old, {"o_orderstatus": F.lit("ARCHIVED")})
    return orders.read().drop("o_orderdate")


@query(
    "k13_update_in_list",
    """SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)
    THEN 'BULK' ELSE o_orderstatus END AS o_orderstatus FROM orders""",
)
def update_in_list(spark, folder):
    keys = table(spark, folder, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = BucketTable.create(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"])
    orders.update_keys(keys, {"o_orderstatus": F.lit("BULK")})
    return orders.read()


def versioned_orders(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_orderkey") % 4).alias("version"), F.col("o_orderstatus").alias("value")
    )


def order_updates(spark, folder):
    keys = table(spark, folder, "orders").where("o_orderkey % 5 = 0")
    return keys.select("o_orderkey", (F.col("o_orderkey") % 3).alias("expected"), F.lit("X").alias("value"))


VERSION_SQL = "o_orderkey % 5 = 0 AND o_orderkey % 3 = o_orderkey % 4"


@query(
    "k14_versioned_update",
    f"""SELECT o_orderkey, CASE WHEN {VERSION_SQL} THEN o_orderkey % 4 + 1 ELSE o_orderkey % 4 END AS version,
    CASE WHEN {VERSION_SQL} THEN 'X' ELSE o_orderstatus END AS value FROM orders""",
)
def versioned_update(spark, folder):
    orders = BucketTable.create(versioned_orders(spark, folder), ["o_orderkey"])
    orders.versioned_update(order_updates(spark, folder), "version")
    return orders.read()


@query(
    "k14_update_outcomes",
    f"""SELECT o_orderkey, o_orderkey % 3 AS expected, 'X' AS value,
    CASE WHEN {VERSION_SQL} THEN 'applied' ELSE 'rejected' END AS outcome FROM orders WHERE o_orderkey % 5 = 0""",
)
def update_outcomes(spark, folder):
    orders = BucketTable.create(versioned_orders(spark, folder), ["o_orderkey"])
    return orders.versioned_update(order_updates(spark, folder), "version")


@query("k15_guarded_transfer")
def guarded_transfer(spark, folder):
    """Orders as transfers from their customer to one of a hundred busy accounts, in order-key order.

    No SQL: the result depends on the sequence of all transfers. The tests compare with brute force.
    """
    accounts = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("account"), F.round(F.col("c_acctbal") * 100).cast("long").alias("balance")
    )
    to = F.pmod(F.col("o_custkey") * 31 + 7, F.lit(100))
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.col("o_custkey").alias("src"),
        to.alias("dst"),
        F.round("o_totalprice").cast("long").alias("amount"),
    )
    return guarded_transfers(accounts, orders.where("src <> dst"))


@query(
    "k16_soft_delete",
    """SELECT c_custkey, c_acctbal < 0 AS deleted, CASE WHEN c_acctbal < 0 THEN TIMESTAMP '2024-02-01' END AS deleted_at FROM customer""",
)
def soft_delete(spark, folder):
    rows = table(spark, folder, "customer").select(
        "c_custkey", "c_acctbal", F.lit(False).alias("deleted"), F.lit(None).cast("timestamp_ntz").alias("deleted_at")
    )
    gone = {"deleted": F.lit(True), "deleted_at": F.lit("2024-02-01").cast("timestamp_ntz")}
    customers = BucketTable.create(rows, ["c_custkey"])
    customers.update_where(F.col("c_acctbal") < 0, gone)
    return customers.read().drop("c_acctbal")


@query(
    "k16_in_place_migration",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN lower(c_name) ELSE c_name END AS email, true AS migrated FROM customer""",
)
def in_place_migration(spark, folder):
    rows = table(spark, folder, "customer").select(
        "c_custkey", F.col("c_name").alias("email"), (F.col("c_custkey") % 4 == 0).alias("migrated")
    )
    customers = BucketTable.create(rows, ["c_custkey"])
    customers.update_where(~F.col("migrated"), {"email": F.lower("email"), "migrated": F.lit(True)})
    return customers.read()
