"""F: filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from creaseline.functions.scalars import haversine_km
from creaseline.operators import geo, ingest, predicates, retry
from creaseline.operators.hotkeys import paged_lists
from creaseline.operators.store import unexpired
from creaseline.operators.view import active_matches
from creaseline.plans import inputs
from creaseline.plans.inputs import SQL_ACCEPTED, SQL_BALLS, SQL_VIEW
from creaseline.plans.registry import query
from creaseline.plans.scalars import SQL_REQUESTS, raw_requests
from creaseline.plans.sources import MATCH, TTL_SQL, stored_table
from creaseline.sources.tables import table


@query(
    "f1_validate_valid",
    SQL_REQUESTS + "SELECT event_id, match_id, runs FROM requests WHERE event_id NOT IN (SELECT event_id FROM errors)",
)
def validate_valid(spark, folder):
    valid, _ = ingest.validate(raw_requests(spark, folder))
    return valid.select("event_id", "match_id", "runs")


@query("f1_validate_errors", SQL_REQUESTS + "SELECT * FROM errors")
def validate_errors(spark, folder):
    _, invalid = ingest.validate(raw_requests(spark, folder))
    return invalid.select("event_id", F.explode("errors").alias("e")).select("event_id", "e.*")


SQL_TAMPERED = (
    SQL_BALLS
    + """, tampered AS (SELECT event_id, CASE WHEN src_id % 23 = 0 THEN 7 ELSE runs END AS runs,
  CASE WHEN src_id % 29 = 0 THEN 21 ELSE over_no END AS over_no, CASE WHEN src_id % 31 = 0 THEN 7 ELSE ball END AS ball,
  CASE WHEN src_id % 37 = 0 THEN 'x' ELSE inning || '' END AS head FROM balls)"""
)


@query(
    "f2_business_rules",
    SQL_TAMPERED
    + """SELECT event_id, 'eventSequence' AS field, CAST(NULL AS VARCHAR) AS rejected_value FROM tampered WHERE head = 'x'
    UNION ALL SELECT event_id, 'runs', CAST(runs AS VARCHAR) FROM tampered WHERE runs > 6
    UNION ALL SELECT event_id, 'over', CAST(over_no AS VARCHAR) FROM tampered WHERE over_no > 20
    UNION ALL SELECT event_id, 'ball', CAST(ball AS VARCHAR) FROM tampered WHERE ball > 6""",
)
def business_rules(spark, folder):
    n = F.col("src_id")
    over, ball = F.when(n % 29 == 0, 21).otherwise(F.col("over_no")), F.when(n % 31 == 0, 7).otherwise(F.col("ball"))
    head = F.when(n % 37 == 0, "x").otherwise(F.col("inning").cast("string"))
    tampered = inputs.balls(spark, folder).select(
        "event_id",
        F.when(n % 23 == 0, 7).otherwise(F.col("runs")).alias("runs"),
        F.format_string("%s#%02d#%d", head, over, ball).alias("event_sequence"),
    )
    errors = ingest.with_rule_errors(tampered).select("event_id", F.explode("errors").alias("e"))
    return errors.select("event_id", "e.field", "e.rejected_value")


@query("f3_prefix_filter", SQL_ACCEPTED + "SELECT match_id, event_sequence, runs FROM accepted WHERE starts_with(event_sequence, '1#')")
def prefix_filter(spark, folder):
    return stored_table(spark, folder).where(F.col("event_sequence").startswith("1#")).select("match_id", "event_sequence", "runs")


@query("f4_range_filter_literal", SQL_ACCEPTED + "SELECT count(*) AS n FROM accepted WHERE event_sequence BETWEEN '1#03#01' AND '1#03#06'")
def range_filter_literal(spark, folder):
    """The padded range finds nothing: balls are not padded in the sequence text."""
    return stored_table(spark, folder).where(F.col("event_sequence").between("1#03#01", "1#03#06")).agg(F.count(F.lit(1)).alias("n"))


@query("f4_over_lookup", SQL_ACCEPTED + "SELECT match_id, event_sequence, runs FROM accepted WHERE inning = 1 AND over_no = 3")
def over_lookup(spark, folder):
    over = F.col("event_sequence").between("1#03#1", "1#03#9")
    return stored_table(spark, folder).where(over).select("match_id", "event_sequence", "runs")


@query(
    "f5_active_matches",
    SQL_VIEW + "SELECT * FROM live WHERE NOT (current_inning = 2 AND (current_over >= 20 OR wickets >= 10))",
)
def active(spark, folder):
    return active_matches(inputs.view(spark, folder))


@query(
    "f6_time_range",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate <= TIMESTAMP '1998-06-30'",
)
def time_range(spark, folder):
    start, end = (F.lit(d).cast("timestamp_ntz") for d in ("1997-03-01", "1998-06-30"))
    return predicates.time_range(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", start, end)


@query("f6_open_range", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'")
def open_range(spark, folder):
    start = F.lit("2000-01-01").cast("timestamp_ntz")
    return predicates.time_range(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", start)


@query(
    "f7_term_filters",
    """SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 100000""",
)
def term_filters(spark, folder):
    must = F.col("o_orderstatus") == "F"
    kept = must & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_totalprice") >= 100000)
    return table(spark, folder, "orders").where(kept).select("o_orderkey")


@query("f8_optional_criteria", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 1000")
def optional_criteria(spark, folder):
    criteria = [
        ("c_mktsegment", "eq", "BUILDING"),
        ("c_acctbal", "ge", 1000),
        ("c_name", "contains", None),
        ("c_nationkey", "between", None, 5),
    ]
    return predicates.where_given(table(spark, folder, "customer"), criteria).select("c_custkey", "c_name")


# form -> (column, op, args, SQL condition)
PART_FORMS = {
    "eq": (("p_brand", "eq", "Brand#4"), "p_brand = 'Brand#4'"),
    "ne": (("p_brand", "ne", "Brand#4"), "p_brand <> 'Brand#4'"),
    "gt": (("p_size", "gt", 25), "p_size > 25"),
    "ge": (("p_size", "ge", 25), "p_size >= 25"),
    "lt": (("p_size", "lt", 25), "p_size < 25"),
    "le": (("p_size", "le", 25), "p_size <= 25"),
    "between": (("p_size", "between", 10, 20), "p_size BETWEEN 10 AND 20"),
    "like": (("p_name", "like", "%red%"), "p_name LIKE '%red%'"),
    "starts_with": (("p_name", "starts_with", "blue"), "starts_with(p_name, 'blue')"),
    "ends_with": (("p_name", "ends_with", "ring"), "ends_with(p_name, 'ring')"),
    "contains": (("p_name", "contains", "wid"), "contains(p_name, 'wid')"),
    "in": (("p_type", "in", "ECONOMY", "SMALL"), "p_type IN ('ECONOMY', 'SMALL')"),
    "not_in": (("p_type", "not_in", "ECONOMY", "SMALL"), "p_type NOT IN ('ECONOMY', 'SMALL')"),
    "ignore_case_like": (("p_name", "ilike", "%RED%"), "p_name ILIKE '%RED%'"),
    "eq_ignore_case": (("p_type", "eq_ignore_case", "Economy"), "lower(p_type) = 'economy'"),
}


def _register_vocabulary() -> None:
    for form, (criterion, sql) in PART_FORMS.items():

        @query(f"f9_{form}", f"SELECT p_partkey FROM part WHERE {sql}")
        def run(spark, folder, criterion=criterion):
            return table(spark, folder, "part").where(predicates.predicate(*criterion)).select("p_partkey")


_register_vocabulary()


@query("f9_and_or", "SELECT p_partkey FROM part WHERE (p_size > 40 AND p_brand = 'Brand#4') OR p_type = 'SMALL'")
def and_or(spark, folder):
    p = predicates.predicate
    condition = (p("p_size", "gt", 40) & p("p_brand", "eq", "Brand#4")) | p("p_type", "eq", "SMALL")
    return table(spark, folder, "part").where(condition).select("p_partkey")


@query("f9_is_null", SQL_ACCEPTED + "SELECT match_id, event_sequence FROM accepted WHERE extras IS NULL")
def is_null(spark, folder):
    return stored_table(spark, folder).where(predicates.predicate("extras", "is_null")).select("match_id", "event_sequence")


@query("f9_is_not_null", SQL_ACCEPTED + "SELECT match_id, event_sequence FROM accepted WHERE extras IS NOT NULL")
def is_not_null(spark, folder):
    return stored_table(spark, folder).where(predicates.predicate("extras", "is_not_null")).select("match_id", "event_sequence")


@query("f9_is_true", SQL_ACCEPTED + "SELECT match_id, event_sequence FROM accepted WHERE wicket")
def is_true(spark, folder):
    return stored_table(spark, folder).where(predicates.predicate("wicket", "is_true")).select("match_id", "event_sequence")


@query("f9_is_false", SQL_ACCEPTED + "SELECT match_id, event_sequence FROM accepted WHERE NOT wicket")
def is_false(spark, folder):
    return stored_table(spark, folder).where(predicates.predicate("wicket", "is_false")).select("match_id", "event_sequence")


@query(
    "f9_nested_property",
    "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'",
)
def nested_property(spark, folder):
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.struct("c_mktsegment", "c_name").alias("customer")
    )
    joined = table(spark, folder, "orders").select("o_orderkey", "o_custkey").join(customers, "o_custkey")
    return joined.where(predicates.predicate("customer.c_mktsegment", "eq", "MACHINERY")).select("o_orderkey")


@query(
    "f9_count_exists_distinct",
    "SELECT count(*) AS n, count(*) > 0 AS found, count(DISTINCT p_brand) AS brands FROM part WHERE p_size > 25",
)
def count_exists_distinct(spark, folder):
    rows = table(spark, folder, "part").where(predicates.predicate("p_size", "gt", 25))
    n = F.count(F.lit(1))
    return rows.agg(n.alias("n"), (n > 0).alias("found"), F.countDistinct("p_brand").alias("brands"))


def nested_orders(spark, folder):
    """Orders with their lines as nested players, in pages of bounded size."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    player = F.struct(F.col("l_partkey").alias("player"), F.col("l_quantity").alias("runs"))
    order = ["l_partkey", "l_linenumber", "l_suppkey", "l_quantity"]
    return paged_lists(lines, ["l_orderkey"], order, player, name="players")


@query(
    "f10_nested_same_element",
    "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey % 7 = 0 AND l_quantity > 40",
)
def nested_same_element(spark, folder):
    """Both conditions on the same element; a document is a hit if any of its pages is."""
    hit = F.exists("players", lambda p: (p["player"] % 7 == 0) & (p["runs"] > 40))
    return nested_orders(spark, folder).where(hit).select("l_orderkey").distinct()


@query(
    "f11_quantifiers",
    """SELECT user_id, coalesce(bool_or(value > 100), false) AS any_match, coalesce(bool_and(value > 1), true) AS all_match,
    NOT coalesce(bool_or(value > 100), false) AS none_match_100 FROM events GROUP BY 1""",
)
def quantifiers(spark, folder):
    events = table(spark, folder, "events").select("user_id", "value")
    high = predicates.quantifiers(events, ["user_id"], F.col("value") > 100)
    low = predicates.quantifiers(events, ["user_id"], F.col("value") > 1)
    return high.select("user_id", "any_match", F.col("none_match").alias("none_match_100")).join(
        low.select("user_id", "all_match"), "user_id"
    )


@query("f11_quantifiers_empty", "SELECT c_custkey, false AS any_match, true AS all_match, true AS none_match FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def quantifiers_empty(spark, folder):
    """Keys without rows: nothing matches, and everything vacuously does."""
    big = table(spark, folder, "orders").where("o_totalprice > 400000").select("o_custkey", "o_totalprice")
    customers = table(spark, folder, "customer").select("c_custkey")
    joined = customers.join(big, F.col("c_custkey") == F.col("o_custkey"), "left")
    flags = predicates.quantifiers(joined, ["c_custkey"], F.col("o_totalprice") > 400000)
    return flags.where(~F.col("any_match"))


@query("f12_tenant_isolation", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 77")
def tenant_isolation(spark, folder):
    return predicates.tenant_view(table(spark, folder, "orders"), "o_custkey", 77).select("o_orderkey", "o_custkey")


@query("f13_sparse_predicate", SQL_ACCEPTED + "SELECT match_id, event_sequence, extras FROM accepted WHERE extras IS NOT NULL")
def sparse_predicate(spark, folder):
    return stored_table(spark, folder).where(F.col("extras").isNotNull()).select("match_id", "event_sequence", "extras")


@query(
    "f14_unexpired",
    SQL_ACCEPTED
    + f"""SELECT match_id, event_sequence, ttl FROM (SELECT match_id, event_sequence, {TTL_SQL} FROM accepted)
    WHERE ttl > CAST(epoch(TIMESTAMP '2024-04-15') AS BIGINT)""",
)
def not_expired(spark, folder):
    as_of = F.lit("2024-04-15").cast("timestamp_ntz")
    return unexpired(stored_table(spark, folder), as_of).select("match_id", "event_sequence", "ttl")


@query(
    "f15_retryable",
    """SELECT event_id, CASE WHEN event_id % 31 = 0 THEN 'dlt' WHEN event_id % 7 = 0 THEN 'dlt' WHEN event_id % 5 = 0 THEN 'retry'
    ELSE 'ok' END AS route FROM events""",
)
def retryable(spark, folder):
    n = F.col("event_id")
    error = (
        F.when(n % 31 == 0, retry.NOT_RETRIED[0])
        .when(n % 7 == 0, retry.NOT_RETRIED[1])
        .when(n % 5 == 0, "java.lang.RuntimeException")
    )
    return table(spark, folder, "events").select("event_id", retry.route(error).alias("route"))


LAT_SQL, LON_SQL = "(c_custkey % 181 - 90.0)", "(c_custkey * 7 % 361 - 180.0)"


def places(spark, folder):
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        "c_custkey", (key % 181 - 90).cast("double").alias("lat"), (key * 7 % 361 - 180).cast("double").alias("lon")
    )


@query(
    "f16_geo_radius",
    f"""WITH p AS (SELECT c_custkey, CAST({LAT_SQL} AS DOUBLE) AS lat, CAST({LON_SQL} AS DOUBLE) AS lon FROM customer),
    d AS (SELECT c_custkey, 12742.0 * asin(sqrt(pow(sin(radians(lat - 20) / 2), 2)
      + cos(radians(20)) * cos(radians(lat)) * pow(sin(radians(lon - 70) / 2), 2))) AS km FROM p)
    SELECT c_custkey, round(km, 4) AS km FROM d WHERE km <= 3000""",
)
def geo_radius(spark, folder):
    km = haversine_km(F.lit(20.0), F.lit(70.0), F.col("lat"), F.col("lon"))
    hits = places(spark, folder).withColumn("km", km).where("km <= 3000")
    return hits.select("c_custkey", F.round("km", 4).alias("km")).orderBy("km", "c_custkey")


@query(
    "f16_bounding_box",
    f"SELECT c_custkey FROM customer WHERE {LAT_SQL} BETWEEN 10 AND 40 AND {LON_SQL} BETWEEN 60 AND 100",
)
def bounding_box(spark, folder):
    box = F.col("lat").between(10, 40) & F.col("lon").between(60, 100)
    return places(spark, folder).where(box).select("c_custkey")


@query(
    "f16_geo_radius_cells",
    f"""WITH p AS (SELECT c_custkey, CAST({LAT_SQL} AS DOUBLE) AS lat, CAST({LON_SQL} AS DOUBLE) AS lon FROM customer),
    d AS (SELECT c_custkey, 12742.0 * asin(sqrt(pow(sin(radians(lat + 15) / 2), 2)
      + cos(radians(-15)) * cos(radians(lat)) * pow(sin(radians(lon - 175) / 2), 2))) AS km FROM p)
    SELECT c_custkey, round(km, 4) AS km FROM d WHERE km <= 2500""",
)
def geo_radius_cells(spark, folder):
    """A circle over the date line, read from ranges of cells."""
    laid = geo.lay_out(places(spark, folder), "lat", "lon")
    hits = geo.within(laid, "lat", "lon", (-15.0, 175.0), 2500)
    return hits.select("c_custkey", F.round("km", 4).alias("km")).orderBy("km", "c_custkey")


@query(
    "f16_bounding_box_cells",
    f"SELECT c_custkey FROM customer WHERE {LAT_SQL} BETWEEN -20 AND 35 AND ({LON_SQL} >= 150 OR {LON_SQL} <= -160)",
)
def bounding_box_cells(spark, folder):
    laid = geo.lay_out(places(spark, folder), "lat", "lon")
    return geo.in_box(laid, "lat", "lon", -20, 35, 150, -160).select("c_custkey")


@query("f17_subtype_filter", "SELECT event_id, value AS click_value FROM events WHERE event_type IN ('click', 'view') AND value > 20")
def subtype_filter(spark, folder):
    kinds = table(spark, folder, "events").where(F.col("event_type").isin("click", "view"))
    return kinds.where("value > 20").select("event_id", F.col("value").alias("click_value"))


@query("f18_soft_delete_view", "SELECT c_custkey, c_acctbal FROM customer WHERE NOT c_acctbal < 0")
def soft_delete_view(spark, folder):
    rows = table(spark, folder, "customer").withColumn("deleted", F.col("c_acctbal") < 0)
    return predicates.visible(rows).select("c_custkey", "c_acctbal")


@query("f18_with_deleted", "SELECT c_custkey, c_acctbal < 0 AS deleted FROM customer")
def with_deleted(spark, folder):
    rows = table(spark, folder, "customer").withColumn("deleted", F.col("c_acctbal") < 0)
    return predicates.visible(rows, include_deleted=True).select("c_custkey", "deleted")
