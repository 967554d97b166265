"""J: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from creaseline.operators import joins
from creaseline.operators.digests import compare_laid_out, lay_out
from creaseline.operators.view import reconcile
from creaseline.plans import inputs
from creaseline.plans.inputs import SQL_FEED, SQL_VIEW
from creaseline.plans.registry import query
from creaseline.plans import writes as writes_plan
from creaseline.schemas import BALL_KEY
from creaseline.sources.tables import table


@query(
    "j1_anti_join_store",
    SQL_FEED
    + f""", stored AS (SELECT DISTINCT match_id, event_sequence FROM sequenced WHERE arrival < TIMESTAMP '{writes_plan.CUTOFF}')
    SELECT match_id, event_sequence, event_id, kind FROM sequenced s WHERE arrival >= TIMESTAMP '{writes_plan.CUTOFF}'
    AND NOT EXISTS (SELECT 1 FROM stored t WHERE t.match_id = s.match_id AND t.event_sequence = s.event_sequence)""",
)
def anti_join_store(spark, folder):
    """Every later delivery whose ball is not stored, repeats among them included."""
    stored, batch = writes_plan.halves(spark, folder)
    fresh = batch.join(stored.select(*BALL_KEY), BALL_KEY, "left_anti")
    return fresh.select("match_id", "event_sequence", "event_id", "kind")


@query(
    "j2_inner_join",
    "SELECT DISTINCT c_custkey, c_name, o_orderpriority FROM customer JOIN orders ON c_custkey = o_custkey",
)
def inner_join(spark, folder):
    # the pairs are made distinct before the join, so a heavy customer folds map-side
    pairs = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority").distinct()
    return table(spark, folder, "customer").select("c_custkey", "c_name").join(pairs, "c_custkey")


@query(
    "j3_left_join_aggregate",
    """SELECT c_custkey, c_name, count(o_orderkey) AS n,
    CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DECIMAL(28,2)) AS total
    FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) o ON c_custkey = o_custkey GROUP BY 1, 2""",
)
def left_join_aggregate(spark, folder):
    big = table(spark, folder, "orders").where("o_totalprice > 400000").withColumnRenamed("o_custkey", "c_custkey")
    parents = table(spark, folder, "customer").select("c_custkey", "c_name")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    counted = joins.count_and_sum(parents, big, "c_custkey", price)
    return counted.withColumn("total", F.col("total").cast("decimal(28,2)"))


@query(
    "j4_semi_join_in",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
)
def semi_join_in(spark, folder):
    big = table(spark, folder, "orders").where("o_totalprice > 400000").withColumnRenamed("o_custkey", "c_custkey")
    return joins.having_any(table(spark, folder, "customer"), big, "c_custkey").select("c_custkey", "c_name")


@query(
    "j5_correlated_exists",
    """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey
    AND o_totalprice > c_acctbal * 50)""",
)
def correlated_exists(spark, folder):
    customers = table(spark, folder, "customer")
    orders = table(spark, folder, "orders")
    # the largest order decides the comparison, so orders fold to one row per customer first
    largest = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("largest"))
    condition = (customers["c_custkey"] == largest["c_custkey"]) & (largest["largest"] > customers["c_acctbal"] * 50)
    return customers.join(largest, condition, "left_semi").select("c_custkey")


@query(
    "j6_has_child",
    "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R')",
)
def has_child(spark, folder):
    lines = table(spark, folder, "lineitem").where("l_quantity >= 49 AND l_returnflag = 'R'")
    children = lines.withColumnRenamed("l_orderkey", "o_orderkey")
    return joins.having_any(table(spark, folder, "orders"), children, "o_orderkey").select("o_orderkey")


@query(
    "j6_has_parent",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
    WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 490000)""",
)
def has_parent(spark, folder):
    parents = table(spark, folder, "orders").where("o_totalprice > 490000").withColumnRenamed("o_orderkey", "l_orderkey")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return joins.having_any(lines, parents, "l_orderkey")


@query(
    "j7_reference_join",
    """SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
)
def reference_join(spark, folder):
    # no hint: the reference tables are broadcast when their size is below the session's threshold
    nations = table(spark, folder, "nation").join(table(spark, folder, "region"), F.expr("n_regionkey = r_regionkey"))
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return customers.join(nations, F.expr("c_nationkey = n_nationkey")).select("c_custkey", "n_name", "r_name")


@query(
    "j8_colocated_join",
    "SELECT o_orderkey, l_linenumber, l_partkey, o_orderstatus FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
)
def colocated_join(spark, folder):
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return joins.colocated_join(lines, orders, "o_orderkey", F.col("l_partkey"))


@query(
    "j9_fetch_join",
    """WITH numbered AS (SELECT o_custkey, o_orderkey, o_orderstatus, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 1000 AS page FROM orders),
    pages AS (SELECT o_custkey, page, string_agg(o_orderkey || o_orderstatus, ',' ORDER BY o_orderkey) AS children FROM numbered GROUP BY 1, 2)
    SELECT c_custkey, c_name, CAST(coalesce(page, 0) AS INTEGER) AS page, coalesce(children, '') AS children
    FROM customer LEFT JOIN pages ON c_custkey = o_custkey""",
)
def fetch_join(spark, folder):
    parents = table(spark, folder, "customer").select("c_custkey", "c_name")
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    child = F.concat(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"))
    fetched = joins.fetch_children(parents, orders, "c_custkey", ["o_orderkey"], child)
    return fetched.withColumn("children", F.array_join("children", ","))


@query(
    "j10_reconciliation",
    SQL_VIEW
    + """, totals AS (SELECT match_id, inning, sum(runs) AS event_total, count(*) FILTER (wicket) AS event_wickets FROM accepted GROUP BY 1, 2),
    stored AS (SELECT match_id, count(*) AS n_balls FROM accepted GROUP BY 1),
    views AS (SELECT * FROM live WHERE match_id <> 'M-000003'),
    kept AS (SELECT * FROM stored WHERE match_id <> 'M-000004')
    SELECT coalesce(v.match_id, k.match_id) AS match_id, v.total_runs, CAST(t.event_total AS BIGINT) AS event_total,
    v.wickets, t.event_wickets, k.n_balls,
    CASE WHEN v.match_id IS NULL THEN 'missing_view' WHEN k.match_id IS NULL THEN 'missing_events'
         WHEN v.total_runs IS DISTINCT FROM t.event_total THEN 'total_mismatch' ELSE 'ok' END AS status
    FROM views v LEFT JOIN totals t ON t.match_id = v.match_id AND t.inning = v.current_inning AND t.match_id <> 'M-000004'
    FULL OUTER JOIN kept k ON k.match_id = v.match_id""",
)
def reconciliation(spark, folder):
    """A view that lost one match against a store that lost another."""
    view = inputs.view(spark, folder).where("match_id <> 'M-000003'")
    accepted = inputs.accepted(spark, folder).where("match_id <> 'M-000004'")
    return reconcile(view, accepted)


@query(
    "j11_restore_check",
    """SELECT o_orderkey, o_orderstatus, o_totalprice, 1::BIGINT AS n_left, 0::BIGINT AS n_right FROM orders
    WHERE o_totalprice > 495000 OR o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'
    UNION ALL SELECT o_orderkey, 'X', o_totalprice, 0, 1 FROM orders
    WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' AND o_totalprice <= 495000""",
)
def restore_check(spark, folder):
    """A copy that lost the largest orders and changed some statuses."""
    orders = table(spark, folder, "orders")
    damaged = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")
    copy = orders.where("o_totalprice <= 495000").withColumn(
        "o_orderstatus", F.when(damaged, "X").otherwise(F.col("o_orderstatus"))
    )
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice"]
    return joins.compare_copies(orders.select(*columns), copy.select(*columns))


@query(
    "j11_restore_counts",
    "SELECT (SELECT count(*) FROM orders) AS n_left, (SELECT count(*) FROM orders WHERE o_totalprice <= 495000) AS n_right",
)
def restore_counts(spark, folder):
    orders = table(spark, folder, "orders").select("o_totalprice")
    copy = orders.where("o_totalprice <= 495000")
    tagged = orders.select(F.lit(0).alias("side")).unionAll(copy.select(F.lit(1).alias("side")))
    return tagged.agg(F.count_if(F.col("side") == 0).alias("n_left"), F.count_if(F.col("side") == 1).alias("n_right"))


@query(
    "j11_restore_digest_tree",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 1::BIGINT AS n_left, 0::BIGINT AS n_right FROM orders
    WHERE o_orderkey % 499 = 0 OR o_custkey = 7 AND o_orderstatus <> 'X'
    UNION ALL SELECT o_orderkey, o_custkey, 'X', o_totalprice, 0, 1 FROM orders
    WHERE o_orderkey % 499 <> 0 AND o_custkey = 7 AND o_orderstatus <> 'X'""",
)
def restore_digest_tree(spark, folder):
    """A copy that lost an order in some five hundred and changed those of one customer; rows are read below differing
    digests only."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    status = F.when(F.col("o_custkey") == 7, "X").otherwise(F.col("o_orderstatus"))
    copy = orders.where("o_orderkey % 499 <> 0").withColumn("o_orderstatus", status)
    return compare_laid_out(lay_out(orders, ["o_orderkey"]), lay_out(copy, ["o_orderkey"]))
