"""O and U: sorts, limits, paging and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from creaseline.operators import paging
from creaseline.operators.replay import playing_order
from creaseline.plans import inputs
from creaseline.plans.inputs import SQL_ACCEPTED, SQL_FEED
from creaseline.plans.registry import query
from creaseline.sources.tables import table


@query("o1_replay_order", SQL_ACCEPTED + "SELECT match_id, event_sequence, runs FROM accepted ORDER BY match_id, inning, over_no, ball")
def replay_order(spark, folder):
    return playing_order(inputs.accepted(spark, folder)).select("match_id", "event_sequence", "runs")


@query("o2_sort_desc_limit", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def sort_desc_limit(spark, folder):
    rows = table(spark, folder, "supplier").select("s_suppkey", "s_acctbal")
    return paging.top_k(rows, [F.desc("s_acctbal"), F.col("s_suppkey")], 10)


@query("o2_sort_asc", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey")
def sort_asc(spark, folder):
    return table(spark, folder, "supplier").select("s_suppkey", "s_acctbal").orderBy("s_acctbal", "s_suppkey")


@query("o2_skip", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25 OFFSET 50")
def skip(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", "o_orderkey").offset(50).limit(25)


@query("o2_find_first", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 1")
def find_first(spark, folder):
    open_orders = table(spark, folder, "orders").where("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate")
    return paging.top_k(open_orders, [F.col("o_orderdate"), F.col("o_orderkey")], 1)


@query(
    "o3_offset_page",
    """WITH f AS (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F'), t AS (SELECT count(*) AS n FROM f)
    SELECT o_orderkey, o_orderdate, 3 AS page, 20 AS size, (SELECT n FROM t) AS total_elements,
    (SELECT CAST(ceil(n / 20.0) AS BIGINT) FROM t) AS total_pages, false AS is_first, (SELECT 4 >= ceil(n / 20.0) FROM t) AS is_last
    FROM f ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 60""",
)
def offset_page(spark, folder):
    rows = table(spark, folder, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    return paging.offset_page(rows, [F.desc("o_orderdate"), F.col("o_orderkey")], 3, 20)


@query("o4_keyset_next", "SELECT o_orderkey, o_custkey, true AS has_more FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 15")
def keyset_next(spark, folder):
    return paging.next_page(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 100, 15)


@query("o4_keyset_previous", "SELECT o_orderkey, o_custkey, false AS has_more FROM orders WHERE o_orderkey < 10 ORDER BY o_orderkey DESC LIMIT 15")
def keyset_previous(spark, folder):
    return paging.previous_page(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 10, 15)


@query(
    "o4_keyset_match_cursor",
    SQL_ACCEPTED
    + """SELECT event_sequence, runs, true AS has_more FROM accepted WHERE match_id = 'M-000007' AND event_sequence > '1#03#6'
    ORDER BY event_sequence LIMIT 10""",
)
def keyset_match_cursor(spark, folder):
    balls = inputs.accepted(spark, folder).where("match_id = 'M-000007'").select("event_sequence", "runs")
    return paging.next_page(balls, "event_sequence", "1#03#6", 10)


@query(
    "o5_top_k_by_metric",
    "SELECT l_partkey, CAST(sum(l_quantity) AS BIGINT) AS runs FROM lineitem GROUP BY 1 ORDER BY runs DESC, l_partkey LIMIT 10",
)
def top_k_by_metric(spark, folder):
    totals = table(spark, folder, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("runs"))
    return paging.top_k(totals, [F.desc("runs"), F.col("l_partkey")], 10)


@query(
    "u1_union_main_and_retries",
    SQL_FEED
    + """SELECT 'main' AS feed_name, event_id, match_id, arrival FROM feed WHERE kind = 0
    UNION ALL SELECT 'retry', event_id, match_id, arrival FROM feed WHERE kind IN (1, 2)""",
)
def union_main_and_retries(spark, folder):
    rows = inputs.feed(spark, folder)
    columns = ["event_id", "match_id", "arrival"]
    main = rows.where("kind = 0").select(F.lit("main").alias("feed_name"), *columns)
    retries = rows.where("kind IN (1, 2)").select(F.lit("retry").alias("feed_name"), *columns)
    return reduce(DataFrame.unionByName, [main, retries])


@query("u2_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey FROM lineitem")
def distinct(spark, folder):
    return table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", "l_suppkey").distinct()


@query(
    "u3_polymorphic_union",
    """SELECT 'customer' AS kind, c_custkey AS party_id, c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance FROM customer
    UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL, s_acctbal FROM supplier""",
)
def polymorphic_union(spark, folder):
    customers = table(spark, folder, "customer").select(
        F.lit("customer").alias("kind"), F.col("c_custkey").alias("party_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    suppliers = table(spark, folder, "supplier").select(
        F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("party_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    return customers.unionByName(suppliers, allowMissingColumns=True)
