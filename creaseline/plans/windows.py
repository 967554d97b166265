"""W: window functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from creaseline.operators import windows
from creaseline.operators.aggregates import exact_percentiles
from creaseline.operators.hotkeys import running, spread
from creaseline.operators.store import first_arrivals
from creaseline.operators.view import view_history
from creaseline.plans import inputs
from creaseline.plans.inputs import SQL_ACCEPTED, SQL_FEED
from creaseline.plans.registry import query
from creaseline.sources.feed import ARRIVAL_ORDER
from creaseline.sources.tables import table


@query(
    "w1_running_total",
    SQL_ACCEPTED
    + """SELECT match_id, event_sequence, runs, CAST(sum(runs) OVER w AS BIGINT) AS running_total,
    CAST(sum(wicket::INTEGER) OVER w AS BIGINT) AS running_wickets FROM accepted
    WINDOW w AS (PARTITION BY match_id, inning ORDER BY over_no, ball ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def running_total(spark, folder):
    scored = windows.running_score(inputs.accepted(spark, folder))
    return scored.select("match_id", "event_sequence", "runs", "running_total", "running_wickets")


@query(
    "w2_first_arrival",
    SQL_FEED
    + """SELECT match_id, event_sequence, event_id, arrival FROM sequenced
    QUALIFY row_number() OVER (PARTITION BY match_id, event_sequence ORDER BY arrival, kind, src_id) = 1""",
)
def first_arrival(spark, folder):
    first = first_arrivals(inputs.sequenced(spark, folder), order=ARRIVAL_ORDER)
    return first.select("match_id", "event_sequence", "event_id", "arrival")


@query(
    "w3_view_history",
    SQL_ACCEPTED
    + """SELECT match_id, event_id, total_runs, wickets, arrival,
    coalesce((inning, over_no, ball) < lag((inning, over_no, ball)) OVER (PARTITION BY match_id ORDER BY arrival, kind, src_id), false) AS regressed
    FROM accepted""",
)
def history(spark, folder):
    tagged = spread(inputs.accepted(spark, folder), ["match_id"], ARRIVAL_ORDER)
    return view_history(tagged, ARRIVAL_ORDER).select(
        "match_id", "event_id", "total_runs", "wickets", "arrival", "regressed"
    )


@query(
    "w4_top_n_per_group",
    """SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank
    FROM orders QUALIFY rank <= 3""",
)
def top_n_per_group(spark, folder):
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return windows.top_per_group(orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3)


@query(
    "w5_audit_history",
    """SELECT o_custkey, o_orderkey, o_orderdate AS changed_at, lag(o_orderstatus) OVER w AS old_status, o_orderstatus AS new_status
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
)
def audit_history(spark, folder):
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    keyed = windows.with_previous(
        rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], {"old_status": "o_orderstatus"}
    )
    return keyed.withColumnsRenamed({"o_orderdate": "changed_at", "o_orderstatus": "new_status"})


@query(
    "w5_latest_change",
    """SELECT o_custkey, o_orderdate AS changed_at, o_orderkey, o_orderstatus FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def latest_change(spark, folder):
    rows = table(spark, folder, "orders").withColumnRenamed("o_orderdate", "changed_at")
    order = F.struct("changed_at", "o_orderkey")
    return windows.latest(rows, ["o_custkey"], order, ["changed_at", "o_orderkey", "o_orderstatus"])


@query(
    "w6_rate_check",
    """WITH n AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS n FROM events)
    SELECT event_id, event_type, n, n <= 3 AS allowed, greatest(3 - n, 0) AS remaining FROM n""",
)
def rate_check(spark, folder):
    requests = table(spark, folder, "events").select("event_id", "event_type", "ts")
    checked = windows.fixed_window_check(requests, "event_type", "ts", "event_id", 3600, 3)
    return checked.select("event_id", "event_type", "n", "allowed", "remaining")


SESSIONS_SQL = """WITH RECURSIVE per_ms AS (SELECT CAST(user_id AS VARCHAR) AS client, epoch_us(ts) // 1000 AS ms, count(*) AS requests FROM events GROUP BY 1, 2),
    gaps AS (SELECT *, coalesce(ms - lag(ms) OVER (PARTITION BY client ORDER BY ms) >= {gap}, true) AS starts FROM per_ms),
    numbered AS (SELECT client, ms, requests, CAST(sum(starts::INTEGER) OVER (PARTITION BY client ORDER BY ms) AS BIGINT) AS session FROM gaps),
    placed AS (SELECT *, row_number() OVER (PARTITION BY client, session ORDER BY ms) AS place FROM numbered),
    """


@query(
    "w7_sliding_log_check",
    SESSIONS_SQL.format(gap=172_800_000)
    + """steps AS (
      SELECT client, session, ms, requests, place, least(requests, 3) AS allowed, [{'at': ms, 'n': least(requests, 3)}] AS log FROM placed WHERE place = 1
      UNION ALL
      SELECT client, session, ms, requests, place, allowed, list_concat(kept, [{'at': ms, 'n': allowed}]) FROM (
        SELECT p.client, p.session, p.ms, p.requests, p.place, [x for x in log if x.at > p.ms - 172800000] AS kept,
          greatest(0, least(p.requests, 3 - coalesce(list_sum([x.n for x in log if x.at > p.ms - 172800000]), 0))) AS allowed
        FROM steps s JOIN placed p ON p.client = s.client AND p.session = s.session AND p.place = s.place + 1))
    SELECT client, session, ms, requests, CAST(allowed AS BIGINT) AS allowed, CAST(requests - allowed AS BIGINT) AS rejected FROM steps""",
)
def sliding_log_check(spark, folder):
    """Users as clients, two days as the window."""
    requests = table(spark, folder, "events").select("user_id", "ts")
    return windows.sliding_log_check(requests, "user_id", "ts", window_ms=2 * 86_400_000, limit=3)


@query(
    "w8_token_bucket_check",
    SESSIONS_SQL.format(gap=129_600_000)
    + """steps AS (
      SELECT client, session, ms, requests, place, least(requests, 3) AS allowed, 3 - least(requests, 3) AS tokens, ms AS refilled FROM placed WHERE place = 1
      UNION ALL
      SELECT client, session, ms, requests, place, least(requests, available),
        CASE WHEN least(requests, available) > 0 THEN available - least(requests, available) ELSE tokens END,
        CASE WHEN least(requests, available) > 0 THEN ms ELSE refilled END FROM (
        SELECT p.client, p.session, p.ms, p.requests, p.place, least(3, tokens + (p.ms - refilled) // 43200000) AS available, tokens, refilled
        FROM steps s JOIN placed p ON p.client = s.client AND p.session = s.session AND p.place = s.place + 1))
    SELECT client, session, ms, requests, CAST(allowed AS BIGINT) AS allowed, CAST(requests - allowed AS BIGINT) AS rejected FROM steps""",
)
def token_bucket_check(spark, folder):
    """Users as clients, one token per half day."""
    requests = table(spark, folder, "events").select("user_id", "ts")
    return windows.token_bucket_check(requests, "user_id", "ts", capacity=3, rate=1, period_ms=43_200_000)


@query(
    "w9_lag_alarm",
    """WITH m AS (SELECT epoch_us(ts) // 60000000 AS step, CAST(user_id % 4 AS INTEGER) AS "partition", count(*) AS n FROM events GROUP BY 1, 2),
    b AS (SELECT "partition", step, CAST(sum(n) OVER (PARTITION BY "partition" ORDER BY step) AS BIGINT) * 20 AS lag FROM m),
    f AS (SELECT *, lag > 10000 AS breach FROM b)
    SELECT "partition", step, lag, breach, coalesce(step - lag(step, 2) OVER w = 2, false)
      AND min(breach::INTEGER) OVER (PARTITION BY "partition" ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 1 AS alarm
    FROM f WINDOW w AS (PARTITION BY "partition" ORDER BY step)""",
)
def lag_alarm(spark, folder):
    """Lag over 10,000 in three minutes running, for a consumer that stands still: twenty records an event."""
    step = F.expr("unix_seconds(CAST(ts AS TIMESTAMP)) div 60").alias("step")
    part = (F.col("user_id") % 4).cast("int").alias("partition")
    arrived = table(spark, folder, "events").groupBy(step, part).agg(F.count(F.lit(1)).alias("n"))
    # one row per minute and partition
    waiting = running(spread(arrived, ["partition"], ["step"]), ["partition"], ["step"], {"lag": F.col("n") * 20})
    series = waiting.select("partition", "step", "lag")
    return windows.consecutive_breaches(series, ["partition"], "step", F.col("lag") > 10_000, 3)


@query(
    "w9_p99_alarm",
    """WITH e AS (SELECT epoch_us(ts) // 60000000 AS step, CAST(floor(value * 10) AS INTEGER) AS ms FROM events),
    r AS (SELECT step, ms, row_number() OVER (PARTITION BY step ORDER BY ms) AS rank, count(*) OVER (PARTITION BY step) AS n FROM e),
    p AS (SELECT step, min(ms) FILTER (rank >= 0.99 * n) AS p99 FROM r GROUP BY 1),
    b AS (SELECT *, p99 > 1000 AS breach FROM p)
    SELECT step, p99, breach, coalesce(step - lag(step, 4) OVER w = 4, false)
      AND min(breach::INTEGER) OVER (ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 1 AS alarm
    FROM b WINDOW w AS (ORDER BY step)""",
)
def p99_alarm(spark, folder):
    """P99 latency over a second in five minutes running. The last window runs over one row per minute."""
    step = F.expr("unix_seconds(CAST(ts AS TIMESTAMP)) div 60").alias("step")
    rows = table(spark, folder, "events").select(step, F.floor(F.col("value") * 10).cast("int").alias("ms"))
    series = exact_percentiles(rows, "step", "ms", [0.99]).withColumn("service", F.lit("score"))
    return windows.consecutive_breaches(series, ["service"], "step", F.col("p99") > 1000, 5).drop("service")


@query(
    "w9_consecutive_breach",
    """WITH h AS (SELECT event_type, epoch_us(date_trunc('hour', ts)) // 3600000000 AS step, count(*) AS lag FROM events GROUP BY 1, 2),
    b AS (SELECT *, lag > 3 AS breach FROM h)
    SELECT event_type, step, lag, breach, coalesce(step - lag(step, 2) OVER w = 2, false)
      AND min(breach::INTEGER) OVER (PARTITION BY event_type ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 1 AS alarm
    FROM b WINDOW w AS (PARTITION BY event_type ORDER BY step)""",
)
def consecutive_breach(spark, folder):
    step = F.expr("unix_seconds(CAST(ts AS TIMESTAMP)) div 3600").alias("step")
    series = table(spark, folder, "events").groupBy("event_type", step).agg(F.count(F.lit(1)).alias("lag"))
    return windows.consecutive_breaches(series, ["event_type"], "step", F.col("lag") > 3, 3)


@query(
    "w10_revision_list",
    """SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS revision, o_orderkey, o_orderstatus FROM orders""",
)
def revision_list(spark, folder):
    return revisions(spark, folder)


def revisions(spark, folder):
    """Orders of a customer as numbered revisions of one entity."""
    from creaseline.operators.writes import number_rows

    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return number_rows(orders, ["o_custkey"], ["o_orderkey"], name="revision")


@query(
    "w10_state_at_revision",
    """WITH r AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS revision, o_orderkey, o_orderstatus FROM orders)
    SELECT * FROM r WHERE revision <= 5 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY revision DESC) = 1""",
)
def state_at_revision(spark, folder):
    return windows.state_at(revisions(spark, folder), "o_custkey", "revision", 5, ["o_orderkey", "o_orderstatus"])
