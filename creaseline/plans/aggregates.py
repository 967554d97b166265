"""A and G: aggregations and custom collectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from creaseline.operators import aggregates as agg, geo, ingest, sharding, sketches
from creaseline.operators.hotkeys import paged_lists
from creaseline.operators.view import live_view, live_view_by_sequence
from creaseline.plans import inputs
from creaseline.plans.inputs import SQL_ACCEPTED, SQL_FEED, SQL_VIEW
from creaseline.plans.registry import query
from creaseline.plans.scalars import AS_OF, hash_sql
from creaseline.schemas import BALL_KEY, LOG_ORDER
from creaseline.session import materialize
from creaseline.functions.scalars import event_sequence
from creaseline.operators.store import first_arrivals, storable
from creaseline.sources import log as logs
from creaseline.sources.tables import table

DEC = "DECIMAL(18,2)"


@query("a1_live_score", SQL_VIEW + "SELECT * FROM live")
def live_score(spark, folder):
    """From raw log records to the live view: decode, first write wins, last arrival per match."""
    ok, _ = logs.decode(inputs.log(spark, folder))
    accepted = first_arrivals(ok.where(storable()).withColumn("event_sequence", event_sequence()))
    return live_view(accepted, LOG_ORDER)


@query(
    "a1_live_score_by_sequence",
    SQL_ACCEPTED
    + """SELECT match_id, total_runs, wickets, inning AS current_inning, over_no AS current_over, ball AS current_ball,
    runs AS last_ball_runs, wicket AS is_wicket, ts AS last_updated
    FROM accepted QUALIFY row_number() OVER (PARTITION BY match_id ORDER BY inning DESC, over_no DESC, ball DESC) = 1""",
)
def live_score_by_sequence(spark, folder):
    return live_view_by_sequence(inputs.accepted(spark, folder))


@query(
    "a2_ingest_counters",
    SQL_FEED
    + """, usable AS (SELECT * FROM feed WHERE kind <> 3 AND src_id % 97 <> 0)
    SELECT (SELECT count(*) FROM feed) AS received, (SELECT count(*) FROM feed WHERE kind = 3) AS poison,
    (SELECT count(*) FROM (SELECT DISTINCT match_id, inning, over_no, ball FROM usable)) AS processed,
    (SELECT count(*) FROM usable) - (SELECT count(*) FROM (SELECT DISTINCT match_id, inning, over_no, ball FROM usable)) AS duplicate,
    (SELECT count(*) FROM feed WHERE kind <> 3 AND src_id % 97 = 0) AS dlt""",
)
def ingest_counters(spark, folder):
    rows = inputs.feed(spark, folder).withColumn("event_sequence", event_sequence())
    return ingest.counters(rows, F.col("kind") == 3, F.col("src_id") % 97 == 0, BALL_KEY)


@query(
    "a2_publish_counters",
    "SELECT count(*) AS offered, count(*) FILTER (event_id % 97 <> 0) AS sent, count(*) FILTER (event_id % 97 = 0) AS failed FROM events",
)
def publish_counters(spark, folder):
    """Send callbacks: every 97th record cannot be sent."""
    failed = F.col("event_id") % 97 == 0
    return table(spark, folder, "events").agg(
        F.count(F.lit(1)).alias("offered"), F.count_if(~failed).alias("sent"), F.count_if(failed).alias("failed")
    )


def latencies(spark, folder):
    return table(spark, folder, "events").select(
        F.col("event_type").alias("operation"), F.floor(F.col("value") * 10).cast("int").alias("latency_ms")
    )


LATENCY_SQL = "WITH l AS (SELECT event_type AS operation, CAST(floor(value * 10) AS INTEGER) AS latency_ms FROM events) "


@query(
    "a3_latency_buckets",
    LATENCY_SQL
    + """SELECT operation, count(*) AS n, count(*) FILTER (latency_ms <= 250) AS le_250, count(*) FILTER (latency_ms <= 500) AS le_500,
    count(*) FILTER (latency_ms <= 1000) AS le_1000, max(latency_ms) AS max FROM l GROUP BY 1""",
)
def latency_buckets(spark, folder):
    return agg.latency_buckets(latencies(spark, folder), ["operation"], F.col("latency_ms"), [250, 500, 1000])


@query(
    "a3_write_latency_buckets",
    LATENCY_SQL
    + """SELECT count(*) AS n, count(*) FILTER (latency_ms <= 100) AS le_100, count(*) FILTER (latency_ms <= 250) AS le_250,
    count(*) FILTER (latency_ms <= 500) AS le_500, max(latency_ms) AS max FROM l""",
)
def write_latency_buckets(spark, folder):
    return agg.latency_buckets(latencies(spark, folder), [], F.col("latency_ms"), [100, 250, 500])


@query(
    "a3_latency_percentiles",
    LATENCY_SQL
    + """, c AS (SELECT operation, latency_ms, row_number() OVER (PARTITION BY operation ORDER BY latency_ms) AS cum,
      count(*) OVER (PARTITION BY operation) AS total FROM l)
    SELECT operation, min(latency_ms) FILTER (cum >= 0.5 * total) AS p50, min(latency_ms) FILTER (cum >= 0.95 * total) AS p95,
    min(latency_ms) FILTER (cum >= 0.99 * total) AS p99 FROM c GROUP BY 1""",
)
def latency_percentiles(spark, folder):
    return agg.exact_percentiles(latencies(spark, folder), "operation", "latency_ms", [0.5, 0.95, 0.99])


@query(
    "a3_latency_percentiles_approx",
    LATENCY_SQL + "SELECT operation, count(*) AS n, true AS p50_close, true AS p95_close, true AS p99_close FROM l GROUP BY 1",
)
def latency_percentiles_approx(spark, folder):
    """The sketch with its promise checked: the share of values up to each estimate lies within a thousandth
    of the point, or the point within the shares below and up to it."""
    points, rows = [0.5, 0.95, 0.99], latencies(spark, folder)
    sketch = rows.groupBy("operation").agg(F.percentile_approx("latency_ms", points, 10000).alias("at"))
    both = rows.join(sketch, "operation")
    ranks = [
        F.struct(F.count_if(F.col("latency_ms") < F.col("at")[i]).alias("below"), F.count_if(F.col("latency_ms") <= F.col("at")[i]).alias("up_to")).alias(f"r{i}")
        for i in range(len(points))
    ]
    ranked = both.groupBy("operation").agg(F.count(F.lit(1)).alias("n"), *ranks)

    def close(i: int, point: float):
        slack = F.col("n") * 0.001 + 1
        return ((F.col(f"r{i}.below") <= F.col("n") * point + slack) & (F.col(f"r{i}.up_to") >= F.col("n") * point - slack)).alias(f"p{round(point * 100)}_close")

    return ranked.select("operation", "n", *[close(i, p) for i, p in enumerate(points)])


LATENCY_SPAN = "CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"


@query(
    "a3_latency_span_sketch",
    f"""SELECT event_type AS operation, count(*) AS n, true AS p50_close, true AS p95_close, true AS p99_close
    FROM events WHERE {LATENCY_SPAN} GROUP BY 1""",
)
def latency_span_sketch(spark, folder):
    """Percentiles of some days from sketches kept by day, n from them too. What follows the roll-up is the check alone: the
    rows below and up to each percentile."""
    rows = table(spark, folder, "events").select(
        F.to_date("ts").alias("day"), F.col("event_type").alias("operation"), F.floor(F.col("value") * 10).cast("int").alias("latency_ms")
    )
    kept = sketches.SketchTable(spark, rows.schema, "day", ["operation"], [], ["latency_ms"], buckets=8)
    early = F.col("day") < F.lit("2024-01-12")
    kept.refresh(rows.where(early), 1)
    kept.refresh(rows.where(~early), 2)
    first, last = (F.lit(d).cast("date") for d in ("2024-01-05", "2024-01-20"))
    points = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    at = kept.rollup(first, last).select("operation", "n", *[sketches.quantile("latency_ms", p).alias(name) for name, p in points.items()])
    at = materialize(at)
    value = F.col("latency_ms")
    ranks = [c for name in points for c in (F.count_if(value < F.col(name)).alias(f"{name}_below"), F.count_if(value <= F.col(name)).alias(f"{name}_up_to"))]
    ranked = rows.where(F.col("day").between(first, last)).join(at, "operation").groupBy("operation", "n").agg(*ranks)
    close = [sketches.rank_close(F.col(f"{n}_below"), F.col(f"{n}_up_to"), F.col("n"), p).alias(f"{n}_close") for n, p in points.items()]
    return ranked.select("operation", "n", *close)


@query(
    "a4_on_demand_score",
    SQL_ACCEPTED
    + """SELECT match_id, inning, CAST(sum(runs) AS BIGINT) AS total_runs, count(*) FILTER (wicket) AS wickets, count(*) AS balls
    FROM accepted GROUP BY 1, 2""",
)
def on_demand_score(spark, folder):
    return inputs.accepted(spark, folder).groupBy("match_id", "inning").agg(
        F.sum("runs").alias("total_runs"), F.count_if("wicket").alias("wickets"), F.count(F.lit(1)).alias("balls")
    )


def appearances(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        F.col("l_partkey").alias("player_id"),
        F.col("l_quantity").cast("int").alias("runs"),
        (F.col("l_linenumber") * 6).alias("balls_faced"),
        (F.col("l_linenumber") % 3).alias("wickets"),
        (F.col("l_linenumber") % 2).alias("catches"),
    )


PLAYER_SQL = """SELECT l_partkey AS player_id, CAST(sum(l_quantity) AS BIGINT) AS total_runs, CAST(sum(l_linenumber * 6) AS BIGINT) AS total_balls,
    CAST(sum(l_linenumber % 3) AS BIGINT) AS total_wickets, CAST(sum(l_linenumber % 2) AS BIGINT) AS total_catches,
    count(*) AS matches_played, round(sum(l_quantity) / sum(l_linenumber * 6) * 100, 6) AS strike_rate FROM lineitem """
WINDOW_SQL = f"""JOIN orders ON o_orderkey = l_orderkey
    WHERE o_orderdate >= date_trunc('day', TIMESTAMP '{AS_OF}' - INTERVAL 1 YEAR) AND o_orderdate <= date_trunc('day', TIMESTAMP '{AS_OF}') """


def recent_appearances(spark, folder):
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    start = F.date_trunc("day", as_of - F.expr("INTERVAL 1 YEAR")).cast("timestamp_ntz")
    end = F.date_trunc("day", as_of).cast("timestamp_ntz")
    matches = table(spark, folder, "orders").where(F.col("o_orderdate").between(start, end)).select("o_orderkey")
    return appearances(spark, folder).join(matches, F.expr("l_orderkey = o_orderkey"))


@query("a5_player_stats", PLAYER_SQL + WINDOW_SQL + "AND l_partkey = 77 GROUP BY 1")
def player_stats(spark, folder):
    return agg.player_stats(recent_appearances(spark, folder).where("player_id = 77"))


@query("a5_player_stats_all", PLAYER_SQL + WINDOW_SQL + "GROUP BY 1")
def player_stats_all(spark, folder):
    return agg.player_stats(recent_appearances(spark, folder))


@query(
    "a6_career_stats",
    """SELECT l_partkey AS player_id, count(*) AS total_matches, CAST(sum(l_quantity) AS BIGINT) AS total_runs,
    round(CAST(sum(l_quantity) AS DOUBLE) / count(*), 6) AS average, round(sum(l_quantity) / sum(l_linenumber * 6) * 100, 6) AS strike_rate,
    CAST(sum(l_linenumber % 3) AS BIGINT) AS total_wickets, round(sum(l_quantity) / sum(l_linenumber), 6) AS economy FROM lineitem GROUP BY 1""",
)
def career_stats(spark, folder):
    stats = agg.player_stats(appearances(spark, folder))
    runs, balls = F.col("total_runs").cast("double"), F.col("total_balls")
    return stats.select(
        "player_id",
        F.col("matches_played").alias("total_matches"),
        "total_runs",
        F.round(runs / F.col("matches_played"), 6).alias("average"),
        "strike_rate",
        "total_wickets",
        F.round(F.when(balls > 0, runs / (balls / 6)).otherwise(F.lit(0.0)), 6).alias("economy"),
    )


FACETS = {"status": "o_orderstatus", "format": "o_orderpriority", "team": "o_custkey", "year": "year(o_orderdate)"}


@query(
    "a7_facets",
    "WITH terms AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS facet, CAST({c} AS VARCHAR) AS term FROM orders" for n, c in FACETS.items())
    + """), counted AS (SELECT facet, term, count(*) AS n FROM terms GROUP BY 1, 2)
    SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, term) <= 10""",
)
def facets(spark, folder):
    return agg.facets(table(spark, folder, "orders"), {n: F.expr(c) for n, c in FACETS.items()})


@query(
    "a8_month_histogram",
    """WITH c AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders WHERE o_totalprice > 495000 GROUP BY 1),
    g AS (SELECT CAST(unnest(generate_series((SELECT min(month) FROM c)::TIMESTAMP, (SELECT max(month) FROM c)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS month)
    SELECT month, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (month)""",
)
def month_histogram(spark, folder):
    return agg.month_histogram(table(spark, folder, "orders").where("o_totalprice > 495000"), "o_orderdate")


@query(
    "a8_hour_by_type",
    """WITH c AS (SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2),
    g AS (SELECT unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM c),
    t AS (SELECT DISTINCT event_type FROM c)
    SELECT hour, event_type, coalesce(n, 0) AS n FROM g CROSS JOIN t LEFT JOIN c USING (hour, event_type)""",
)
def hour_by_type(spark, folder):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    counts = table(spark, folder, "events").groupBy(hour, "event_type").agg(F.count(F.lit(1)).alias("n"))
    return agg.empty_hours_too(counts, "hour", "event_type")


@query(
    "a9_range_buckets",
    """SELECT CASE WHEN v < 100 THEN '0-100' WHEN v < 500 THEN '100-500' WHEN v < 1000 THEN '500-1000' ELSE '1000-*' END AS bucket, count(*) AS n
    FROM (SELECT l_extendedprice / 50 AS v FROM lineitem) GROUP BY 1""",
)
def range_buckets(spark, folder):
    return agg.range_buckets(table(spark, folder, "lineitem"), F.col("l_extendedprice") / 50, [0, 100, 500, 1000])


@query(
    "a10_wins_by_venue",
    """SELECT n_name AS venue, count(*) AS wins FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY 1""",
)
def wins_by_venue(spark, folder):
    won = table(spark, folder, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("w"))
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    joined = won.join(customers, F.expr("o_custkey = c_custkey")).join(
        table(spark, folder, "nation"), F.expr("c_nationkey = n_nationkey")
    )
    return joined.groupBy(F.col("n_name").alias("venue")).agg(F.sum("w").alias("wins"))


@query(
    "a10_average_score_by_format",
    f"""SELECT o_orderpriority AS format, count(*) AS n, round(CAST(sum(CAST(o_totalprice AS {DEC})) AS DOUBLE) / count(*), 6) AS average_score
    FROM orders GROUP BY 1""",
)
def average_score_by_format(spark, folder):
    return table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("format")).agg(
        F.count(F.lit(1)).alias("n"), agg.mean(F.col("o_totalprice")).alias("average_score")
    )


ACTIVITY_SQL = """SELECT CAST(ts AS DATE) AS day, user_id, event_type, count(*) AS n, count(DISTINCT props) AS distinct_props
    FROM events WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 90 DAY GROUP BY 1, 2, 3"""


def activity(events):
    """Events per day, user and type of the ninety days before a reference date."""
    since = F.lit("2024-02-01").cast("timestamp_ntz") - F.expr("INTERVAL 90 DAYS")
    recent = events.where(F.col("ts") >= since).withColumn("day", F.to_date("ts"))
    return recent.groupBy("day", "user_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("props").alias("distinct_props")
    )


@query("a11_daily_activity", ACTIVITY_SQL)
def daily_activity(spark, folder):
    return activity(table(spark, folder, "events"))


@query(
    "a11_daily_users",
    "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
)
def daily_users(spark, folder):
    return table(spark, folder, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users")
    )


@query(
    "a11_daily_users_approx",
    "SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users, true AS sketch_close FROM events GROUP BY 1",
)
def daily_users_approx(spark, folder):
    """The sketch (two per cent standard error) beside the exact number, and whether it is within five of these."""
    counted = table(spark, folder, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.approx_count_distinct("user_id", 0.02).alias("sketch")
    )
    off = F.abs(F.col("sketch") - F.col("users"))
    return counted.withColumn("sketch_close", off <= F.col("users") * 0.1 + 1).drop("sketch")


USERS_90_DAYS = "CAST(ts AS DATE) BETWEEN DATE '2024-01-20' - INTERVAL 89 DAY AND DATE '2024-01-20'"


@query(
    "a11_users_90_days_sketch",
    f"SELECT event_type, count(*) AS n, true AS users_close FROM events WHERE {USERS_90_DAYS} GROUP BY 1",
)
def users_90_days_sketch(spark, folder):
    """Users of ninety days per type from sketches kept by day; the events are read again for the check alone."""
    kept = activity_sketches(spark, folder)
    last = F.lit("2024-01-20").cast("date")
    first = F.date_sub(last, 89)
    found = kept.rollup(first, last).select("event_type", "n", sketches.distinct_count("user_id").alias("users"))
    exact = table(spark, folder, "events").where(F.to_date("ts").between(first, last))
    exact = exact.groupBy("event_type").agg(F.countDistinct("user_id").alias("exact"))
    close = sketches.distinct_close(F.col("users"), F.col("exact")).alias("users_close")
    return found.join(exact, "event_type").select("event_type", "n", close)


def activity_sketches(spark, folder):
    """Sketches per day and type, built by a first batch, late rows of the same days and a batch that runs twice."""
    events = table(spark, folder, "events").select(F.to_date("ts").alias("day"), "event_type", "user_id", "event_id")
    late = F.col("event_id") % 50 == 0
    kept = sketches.SketchTable(spark, events.schema, "day", ["event_type"], ["user_id"], [], buckets=8)
    kept.refresh(events.where(~late), 1)
    kept.refresh(events.where(late), 2)
    kept.refresh(events.where(late), 2)
    return kept


@query(
    "st11_sketch_refresh",
    "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, true AS users_close FROM events GROUP BY 1, 2",
)
def sketch_refresh(spark, folder):
    """Each day after the refreshes, its late rows in and none twice."""
    found = activity_sketches(spark, folder).rollup(by=["day", "event_type"]).select("day", "event_type", "n", sketches.distinct_count("user_id").alias("users"))
    exact = table(spark, folder, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.countDistinct("user_id").alias("exact"))
    close = sketches.distinct_close(F.col("users"), F.col("exact")).alias("users_close")
    return found.join(exact, ["day", "event_type"]).select("day", "event_type", "n", close)


@query(
    "a12_group_by_having",
    f"""SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS {DEC})) AS DECIMAL(28,2)) AS total FROM orders
    GROUP BY 1 HAVING count(*) > 12""",
)
def group_by_having(spark, folder):
    grouped = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), agg.money(F.col("o_totalprice")).alias("total")
    )
    return grouped.where("n > 12")


SUMMARY_SQL = f"""count(*) AS n, CAST(sum(CAST(s_acctbal AS {DEC})) AS DECIMAL(28,2)) AS total, min(s_acctbal) AS lowest,
    max(s_acctbal) AS highest, round(CAST(sum(CAST(s_acctbal AS {DEC})) AS DOUBLE) / count(*), 6) AS average FROM supplier"""


def summary():
    salary = F.col("s_acctbal")
    return [
        F.count(salary).alias("n"),
        agg.money(salary).alias("total"),
        F.min(salary).alias("lowest"),
        F.max(salary).alias("highest"),
        agg.mean(salary).alias("average"),
    ]


@query("a13_summary_global", f"SELECT {SUMMARY_SQL}")
def summary_global(spark, folder):
    return table(spark, folder, "supplier").agg(*summary())


@query("a13_summary_grouped", f"SELECT s_nationkey, {SUMMARY_SQL} GROUP BY 1")
def summary_grouped(spark, folder):
    return table(spark, folder, "supplier").groupBy("s_nationkey").agg(*summary())


@query(
    "a14_top_earner",
    """SELECT s_nationkey, arg_max(s_name, (s_acctbal, -s_suppkey)) AS top_name, max(s_acctbal) AS top_salary,
    arg_min(s_name, (s_acctbal, s_suppkey)) AS low_name, min(s_acctbal) AS low_salary FROM supplier GROUP BY 1""",
)
def top_earner(spark, folder):
    high = F.max_by("s_name", F.struct("s_acctbal", -F.col("s_suppkey")))
    low = F.min_by("s_name", F.struct("s_acctbal", "s_suppkey"))
    return table(spark, folder, "supplier").groupBy("s_nationkey").agg(
        high.alias("top_name"),
        F.max("s_acctbal").alias("top_salary"),
        low.alias("low_name"),
        F.min("s_acctbal").alias("low_salary"),
    )


def pages_sql(select: str, key: str, value: str, order: str, sep: str = ",") -> str:
    return f"""WITH src AS ({select}), numbered AS (
      SELECT *, CAST((row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1) // 1000 AS INTEGER) AS page FROM src)
    SELECT {key}, page, string_agg(CAST({value} AS VARCHAR), '{sep}' ORDER BY {order}) AS items FROM numbered GROUP BY {key}, page"""


@query("a15_group_list", pages_sql("SELECT s_nationkey, s_suppkey, s_name FROM supplier", "s_nationkey", "s_name", "s_suppkey"))
def group_list(spark, folder):
    names = paged_lists(table(spark, folder, "supplier"), ["s_nationkey"], ["s_suppkey"], F.col("s_name"))
    return names.withColumn("items", F.array_join("items", ","))


@query("a15_group_set", pages_sql("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer", "c_nationkey", "c_mktsegment", "c_mktsegment"))
def group_set(spark, folder):
    sets = agg.distinct_lists(table(spark, folder, "customer"), ["c_nationkey"], "c_mktsegment")
    return sets.withColumn("items", F.array_join("items", ","))


@query(
    "a15_joining",
    "SELECT o_orderpriority, '[' || string_agg(DISTINCT o_orderstatus, ', ' ORDER BY o_orderstatus) || ']' AS joined FROM orders GROUP BY 1",
)
def joining(spark, folder):
    """Delimiter, prefix and suffix around the distinct statuses of each priority."""
    unique = table(spark, folder, "orders").select("o_orderpriority", "o_orderstatus").distinct()
    text = F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ", ")
    return unique.groupBy("o_orderpriority").agg(F.concat(F.lit("["), text, F.lit("]")).alias("joined"))


@query(
    "a16_partitioning_by",
    f"""SELECT side, count(s_suppkey) AS n, CAST(coalesce(sum(CAST(s_acctbal AS {DEC})), 0) AS DECIMAL(28,2)) AS total
    FROM (VALUES (true), (false)) AS t(side) LEFT JOIN supplier ON (s_acctbal > 100000) = side GROUP BY 1""",
)
def partitioning_by(spark, folder):
    """Nobody earns that much, and the true side is still there."""
    return agg.partitioned_by(table(spark, folder, "supplier"), F.col("s_acctbal") > 100000, F.col("s_acctbal"))


@query("a17_filtering_downstream", "SELECT s_nationkey, count(*) FILTER (s_acctbal > 7000) AS n FROM supplier GROUP BY 1")
def filtering_downstream(spark, folder):
    return table(spark, folder, "supplier").groupBy("s_nationkey").agg(F.count_if(F.col("s_acctbal") > 7000).alias("n"))


@query(
    "a18_flat_mapping",
    pages_sql(
        "SELECT DISTINCT s_nationkey, p_brand FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey",
        "s_nationkey",
        "p_brand",
        "p_brand",
    ),
)
def flat_mapping(spark, folder):
    """Skills of a department: the distinct brands its suppliers deliver."""
    lines = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey")
    # few brands per supplier, so this distinct folds in the map tasks
    brands = lines.join(table(spark, folder, "part").select("p_partkey", "p_brand"), F.expr("l_partkey = p_partkey"))
    skills = brands.select("l_suppkey", "p_brand").distinct()
    staffed = skills.join(table(spark, folder, "supplier").select("s_suppkey", "s_nationkey"), F.expr("l_suppkey = s_suppkey"))
    return agg.distinct_lists(staffed, ["s_nationkey"], "p_brand").withColumn("items", F.array_join("items", ","))


@query(
    "a19_teeing",
    f"""SELECT count(*) AS n, max(l_quantity) - min(l_quantity) AS spread,
    round(CAST(sum(CAST(l_extendedprice AS {DEC})) AS DOUBLE) / count(*), 6) AS average FROM lineitem""",
)
def teeing(spark, folder):
    return table(spark, folder, "lineitem").agg(
        F.count(F.lit(1)).alias("n"),
        (F.max("l_quantity") - F.min("l_quantity")).alias("spread"),
        agg.mean(F.col("l_extendedprice")).alias("average"),
    )


@query(
    "a20_reduce",
    """SELECT coalesce(CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT), 0) AS total, max(l_quantity) AS largest,
    bit_xor(l_orderkey) AS checksum FROM lineitem""",
)
def reduce_all(spark, folder):
    """Folds with an associative operator: sum with identity 0, maximum, exclusive or."""
    return table(spark, folder, "lineitem").agg(
        F.coalesce(F.sum(F.col("l_quantity").cast("long")), F.lit(0)).alias("total"),
        F.max("l_quantity").alias("largest"),
        F.bit_xor("l_orderkey").alias("checksum"),
    )


@query(
    "a20_reduce_grouped",
    "SELECT p_type, arg_max(p_name, (length(p_name), -p_partkey)) AS longest_name FROM part GROUP BY 1",
)
def reduce_grouped(spark, folder):
    longest = F.max_by("p_name", F.struct(F.length("p_name"), -F.col("p_partkey")))
    return table(spark, folder, "part").groupBy("p_type").agg(longest.alias("longest_name"))


def entries_text():
    return F.array_join(F.transform(F.map_entries("entries"), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"])), ",")


@query(
    "a21_to_map_unique",
    "SELECT p_partkey // 1000 AS page, string_agg(p_partkey || '=' || p_name, ',' ORDER BY p_partkey) AS entries FROM part GROUP BY 1",
)
def to_map_unique(spark, folder):
    maps = agg.to_map(table(spark, folder, "part"), "p_partkey", "p_name")
    return maps.select("page", entries_text().alias("entries"))


@query(
    "a21_to_map_keep_first",
    """WITH f AS (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS v FROM orders GROUP BY 1)
    SELECT o_custkey // 1000 AS page, string_agg(o_custkey || '=' || v, ',' ORDER BY o_custkey) AS entries FROM f GROUP BY 1""",
)
def to_map_keep_first(spark, folder):
    maps = agg.to_map(table(spark, folder, "orders"), "o_custkey", "o_orderstatus", "first", "o_orderkey")
    return maps.select("page", entries_text().alias("entries"))


@query("a22_distinct_count", "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def distinct_count(spark, folder):
    return table(spark, folder, "lineitem").agg(
        F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers")
    )


SEARCH_SQL = """WITH s AS (SELECT event_type || json_extract_string(props, '$.k') AS query, event_type, user_id, ts, value,
    'q' || json_extract_string(props, '$.k') AS term FROM events) """


def searches(spark, folder):
    k = F.get_json_object("props", "$.k")
    return table(spark, folder, "events").select(
        F.concat("event_type", k).alias("query"), F.concat(F.lit("q"), k).alias("term"), "event_type", "user_id", "ts", "value"
    )


@query(
    "a23_popular_terms",
    SEARCH_SQL
    + """SELECT query, count(*) AS n FROM s WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'
    GROUP BY 1 ORDER BY n DESC, query LIMIT 20""",
)
def popular_terms(spark, folder):
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-05", "2024-01-25"))
    recent = searches(spark, folder).where(F.col("ts").between(start, end))
    return recent.groupBy("query").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "query").limit(20)


@query(
    "a24_click_through",
    SEARCH_SQL
    + f"""SELECT term, count(*) FILTER (event_type = 'view') AS searches, count(*) FILTER (event_type = 'click') AS clicks,
    round(CASE WHEN count(*) FILTER (event_type = 'view') > 0 THEN count(*) FILTER (event_type = 'click')::DOUBLE / count(*) FILTER (event_type = 'view') ELSE 0 END, 6) AS ctr,
    round(CAST(sum(CAST(value AS {DEC})) AS DOUBLE) / count(*), 6) AS avg_duration FROM s GROUP BY 1""",
)
def click_through(spark, folder):
    views, clicks = F.count_if(F.col("event_type") == "view"), F.count_if(F.col("event_type") == "click")
    ctr = F.when(views > 0, clicks / views).otherwise(F.lit(0.0))
    return searches(spark, folder).groupBy("term").agg(
        views.alias("searches"),
        clicks.alias("clicks"),
        F.round(ctr, 6).alias("ctr"),
        agg.mean(F.col("value")).alias("avg_duration"),
    )


@query(
    "a24_zero_result_queries",
    SEARCH_SQL
    + """SELECT term, count(*) AS n FROM s WHERE event_type = 'view' AND CAST(floor(value) AS BIGINT) % 10 = 0 GROUP BY 1""",
)
def zero_result_queries(spark, folder):
    empty = (F.col("event_type") == "view") & (F.floor("value") % 10 == 0)
    return searches(spark, folder).where(empty).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(
    "a24_volume_trend",
    """SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'view') AS searches,
    count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY 1""",
)
def volume_trend(spark, folder):
    return searches(spark, folder).groupBy(F.to_date("ts").alias("day")).agg(
        F.count_if(F.col("event_type") == "view").alias("searches"),
        F.count_if(F.col("event_type") == "click").alias("clicks"),
    )


@query(
    "a25_experiment_result",
    f"""WITH a AS (SELECT event_type = 'purchase' AS hit, CASE WHEN abs({hash_sql("CAST(user_id AS VARCHAR) || 'exp-1'")}) % 2 = 0 THEN 'A' ELSE 'B' END AS variant FROM events),
    c AS (SELECT count(*) FILTER (variant = 'A') AS n_a, count(*) FILTER (variant = 'B') AS n_b,
      count(*) FILTER (variant = 'A' AND hit) AS hits_a, count(*) FILTER (variant = 'B' AND hit) AS hits_b FROM a),
    r AS (SELECT *, hits_a::DOUBLE / n_a AS ra, hits_b::DOUBLE / n_b AS rb, (hits_a + hits_b)::DOUBLE / (n_a + n_b) AS pooled FROM c),
    z AS (SELECT *, abs((ra - rb) / sqrt(pooled * (1 - pooled) * (1.0::DOUBLE / n_a + 1.0::DOUBLE / n_b))) / sqrt(2) AS x FROM r),
    t AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + x * 0.3275911::DOUBLE) AS t FROM z),
    p AS (SELECT *, ((((1.061405429::DOUBLE * t - 1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t - 0.284496736::DOUBLE) * t + 0.254829592::DOUBLE) * t * exp(-x * x) AS p FROM t)
    SELECT n_a, n_b, hits_a, hits_b, round(ra, 6) AS rate_a, round(rb, 6) AS rate_b, round(p, 5) AS p_value, p < 0.05 AS significant,
    CASE WHEN p >= 0.05 THEN 'none' WHEN ra > rb THEN 'A' ELSE 'B' END AS winner FROM p""",
)
def experiment_result(spark, folder):
    _, variant = sharding.variant(F.col("user_id").cast("string"), "exp-1", 1.0)
    rows = table(spark, folder, "events").select(variant.alias("variant"), (F.col("event_type") == "purchase").alias("hit"))
    return agg.experiment_result(rows, F.col("variant"), F.col("hit"))


@query(
    "a26_key_distribution",
    """WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
    SELECT o_custkey, n, n > 10 * (SELECT avg(n) FROM c) AS hot FROM c ORDER BY n DESC, o_custkey LIMIT 20""",
)
def key_distribution(spark, folder):
    return agg.key_distribution(table(spark, folder, "orders"), "o_custkey")


@query(
    "a27_nested_average",
    f"""SELECT o_orderpriority, round(CAST(sum(CAST(l_quantity AS {DEC})) AS DOUBLE) / count(*), 6) AS avg_runs FROM orders
    JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""",
)
def nested_average(spark, folder):
    """Average over the nested players of each document; lines fold per match before the join."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("runs"), F.count(F.lit(1)).alias("players")
    )
    joined = table(spark, folder, "orders").join(lines, F.expr("o_orderkey = l_orderkey"))
    average = F.sum("runs").cast("double") / F.sum("players")
    return joined.groupBy("o_orderpriority").agg(F.round(average, 6).alias("avg_runs"))


@query(
    "a28_geo_grid",
    """SELECT CAST(floor((c_custkey % 181 - 90.0) / 30) AS INTEGER) AS lat_cell, CAST(floor((c_custkey * 7 % 361 - 180.0) / 60) AS INTEGER) AS lon_cell,
    count(*) AS n FROM customer GROUP BY 1, 2""",
)
def geo_grid(spark, folder):
    from creaseline.plans.filters import places

    cells = [F.floor(F.col("lat") / 30).cast("int").alias("lat_cell"), F.floor(F.col("lon") / 60).cast("int").alias("lon_cell")]
    return places(spark, folder).groupBy(*cells).agg(F.count(F.lit(1)).alias("n"))


@query(
    "a28_geo_cell_density",
    """SELECT CAST(least(floor((c_custkey % 181) / 180 * 16), 15) AS INTEGER) AS lat_cell,
    CAST(least(floor((c_custkey * 7 % 361) / 360 * 16), 15) AS INTEGER) AS lon_cell, count(*) AS n FROM customer GROUP BY 1, 2""",
)
def geo_cell_density(spark, folder):
    """Density from the cell numbers of a laid-out table."""
    from creaseline.plans.filters import places

    return geo.density(geo.lay_out(places(spark, folder), "lat", "lon"), 4)


# Alarm thresholds of error rate, message loss, dead letters per hour and latency.
SLO = {"error_rate": 0.001, "loss_rate": 0.0, "dlt_per_hour": 10, "p99_ms": 1000}


@query(
    "a29_slo_targets",
    f"""WITH e AS (SELECT date_trunc('hour', ts) AS hour, event_type, event_id, CAST(floor(value * 10) AS INTEGER) AS ms FROM events),
    h AS (SELECT hour, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_id % 97 = 0) AS dead,
      count(*) FILTER (event_id % 97 = 0 AND event_type <> 'error') AS lost FROM e GROUP BY 1),
    r AS (SELECT hour, ms, row_number() OVER (PARTITION BY hour ORDER BY ms) AS rank FROM e),
    p AS (SELECT hour, min(ms) FILTER (rank >= 0.99 * n) AS p99 FROM r JOIN h USING (hour) GROUP BY 1)
    SELECT hour, 'error_rate' AS target, round(errors::DOUBLE / n, 6) AS value, errors::DOUBLE / n > {SLO["error_rate"]} AS breach FROM h
    UNION ALL SELECT hour, 'loss_rate', round(lost::DOUBLE / n, 6), lost::DOUBLE / n > {SLO["loss_rate"]} FROM h
    UNION ALL SELECT hour, 'dlt_per_hour', dead::DOUBLE, dead > {SLO["dlt_per_hour"]} FROM h
    UNION ALL SELECT hour, 'p99_ms', p99::DOUBLE, p99 > {SLO["p99_ms"]} FROM p""",
)
def slo_targets(spark, folder):
    """One row per hour and target: what was measured and whether it breaches. A record is lost if it is neither
    stored nor reported as an error (here: every 97th is not stored)."""
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    rows = table(spark, folder, "events").select(hour, "event_type", "event_id", F.floor(F.col("value") * 10).cast("int").alias("ms"))
    dead, error = F.col("event_id") % 97 == 0, F.col("event_type") == "error"
    hourly = rows.groupBy("hour").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(error).alias("errors"), F.count_if(dead).alias("dead"), F.count_if(dead & ~error).alias("lost")
    )
    slowest = agg.exact_percentiles(rows.select("hour", "ms"), "hour", "ms", [0.99])
    measured = {
        "error_rate": F.col("errors") / F.col("n"),
        "loss_rate": F.col("lost") / F.col("n"),
        "dlt_per_hour": F.col("dead").cast("double"),
        "p99_ms": F.col("p99").cast("double"),
    }
    targets = F.explode(F.array(*[F.struct(F.lit(t).alias("target"), v.alias("raw"), F.lit(float(SLO[t])).alias("limit")) for t, v in measured.items()]))
    return hourly.join(slowest, "hour").select("hour", targets.alias("t")).select(
        "hour", "t.target", F.round("t.raw", 6).alias("value"), (F.col("t.raw") > F.col("t.limit")).alias("breach")
    )


@query(
    "a29_slo_report",
    """WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors,
      count(*) FILTER (event_id % 97 = 0) AS dead FROM events GROUP BY 1)
    SELECT hour, n, errors, dead, round(errors::DOUBLE / n, 6) AS error_rate, errors::DOUBLE / n > 0.001 AS error_breach, dead > 0 AS dlt_breach FROM h""",
)
def slo_report(spark, folder):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    hourly = table(spark, folder, "events").groupBy(hour).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.count_if(F.col("event_id") % 97 == 0).alias("dead"),
    )
    rate = F.col("errors") / F.col("n")
    return hourly.select(
        "*", F.round(rate, 6).alias("error_rate"), (rate > 0.001).alias("error_breach"), (F.col("dead") > 0).alias("dlt_breach")
    )


@query(
    "g1_oxford_join",
    """WITH v AS (SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders),
    l AS (SELECT o_orderpriority, list(o_orderstatus ORDER BY o_orderstatus) AS v FROM v GROUP BY 1)
    SELECT o_orderpriority, CASE WHEN len(v) = 1 THEN v[1] ELSE array_to_string(v[:-2], ', ') || ', and ' || v[-1] END AS phrase FROM l""",
)
def oxford_join(spark, folder):
    """Statuses of each priority; a status set is small however many orders there are."""
    unique = table(spark, folder, "orders").select("o_orderpriority", "o_orderstatus").distinct()
    lists = unique.groupBy("o_orderpriority").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("v"))
    return lists.select("o_orderpriority", agg.oxford_join(F.col("v")).alias("phrase"))


@query(
    "g2_upper_name_joiner",
    pages_sql("SELECT s_nationkey, s_suppkey, upper(s_name) AS s_name FROM supplier", "s_nationkey", "s_name", "s_suppkey", ", "),
)
def upper_name_joiner(spark, folder):
    names = paged_lists(table(spark, folder, "supplier"), ["s_nationkey"], ["s_suppkey"], F.upper("s_name"))
    return names.withColumn("items", F.array_join("items", ", "))
