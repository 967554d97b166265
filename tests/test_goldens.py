"""Known values of the scoring domain."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from creaseline.functions import scalars
from creaseline.operators import aggregates, retry, sharding, view, windows
from creaseline.operators.store import from_items, stored_rows, to_items

TS = dt.datetime(2025, 4, 15, 14, 32, 1)
BALL = "event_id string, match_id string, inning int, over_no int, ball int, team string, runs int, extras int, wicket boolean, total_runs int, wickets int, ts timestamp_ntz"


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize(
    ("inning", "over", "ball", "text"), [(1, 0, 1, "1#00#1"), (1, 19, 6, "1#19#6"), (2, 0, 1, "2#00#1"), (1, 4, 3, "1#04#3")]
)
def test_event_sequence(spark, inning, over, ball, text):
    df = spark.createDataFrame([(inning, over, ball)], "inning int, over_no int, ball int")
    assert one(df.select(scalars.event_sequence().alias("s"))).s == text


def test_sequence_order():
    assert "1#03#2" < "1#10#1" and "2#00#1" > "1#19#6"
    assert "1#03#4" > "1#03#06"


def test_running_total_and_wickets(spark):
    runs = [4, 0, 1, 6, 2, 0, 3, 1, 4, 0]
    wickets = [False, True, False] + [False] * 7
    rows = [("m", 1, i // 6, i % 6 + 1, r, None, w) for i, (r, w) in enumerate(zip(runs, wickets))]
    df = spark.createDataFrame(rows, "match_id string, inning int, over_no int, ball int, runs int, extras int, wicket boolean")
    got = windows.running_score(df).orderBy("over_no", "ball").collect()
    assert [r.running_total for r in got] == [4, 4, 5, 11, 13, 13, 16, 17, 21, 21]
    assert [r.running_wickets for r in got][:3] == [0, 1, 1]


def test_stored_row(spark):
    row = ("e1", "IPL-2025-MI-CSK-001", 1, 4, 3, "MI", 4, None, False, 87, 2, TS)
    df = spark.createDataFrame([row], BALL).withColumn("event_sequence", scalars.event_sequence())
    stored = one(stored_rows(df))
    assert stored.event_sequence == "1#04#3" and stored.extras is None
    assert stored.ttl == int(TS.replace(tzinfo=dt.timezone.utc).timestamp()) + 90 * 86400
    items = to_items(stored_rows(df))
    text = one(items.select(F.to_json("Item").alias("j"))).j
    assert '"runs":{"N":"4"}' in text and '"wicket":{"BOOL":false}' in text and "extras" not in text
    back = one(from_items(items))
    assert back.match_id == "IPL-2025-MI-CSK-001" and back.runs == 4 and back.ttl == stored.ttl


def test_score_line(spark):
    df = spark.range(1).select(
        scalars.score_line(F.lit("IND"), F.lit(150), F.lit(2), F.lit(15), F.lit(0)).alias("line")
    )
    assert one(df).line == "IND 150/2 (15.0)"


@pytest.mark.parametrize(
    ("text", "value"), [("", 0), ("a", 97), ("hello", 99162322), ("polygenelubricants", -2147483648), ("😀", 1772899)]
)
def test_string_hash(spark, text, value):
    df = spark.createDataFrame([(text,)], "t string")
    assert one(df.select(scalars.java_hash(F.col("t")).alias("h"))).h == value


def test_smallest_hash_stays_negative(spark):
    df = spark.createDataFrame([("polygenelubricants",)], "t string")
    assert one(df.select(scalars.string_shard(F.col("t"), 3).alias("s"))).s == -2


def test_ring_matches_plain_lookup(spark):
    import bisect
    import hashlib

    shards = ["shard0", "shard1", "shard2"]
    points = sharding.ring_points(shards)
    positions = [p for p, _ in points]
    assert len(points) == 450
    keys = [f"user-{i}" for i in range(500)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r.k: r.shard for r in sharding.ring_lookup(df, F.col("k"), shards).collect()}
    for k in keys:
        at = int.from_bytes(hashlib.md5(k.encode()).digest()[:8], "big", signed=True)
        assert got[k] == points[bisect.bisect_left(positions, at) % len(points)][1]


def test_delays(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 3)], "n int")
    assert [r.d for r in df.select(retry.delay_ms(F.col("n")).alias("d")).collect()] == [1000, 5000, 15000]


@pytest.mark.parametrize(
    ("failures", "error", "statuses", "seconds"),
    [
        (0, None, ["ok"], [0]),
        (2, "java.lang.RuntimeException", ["retry", "retry", "ok"], [0, 1, 6]),
        (9, "java.lang.RuntimeException", ["retry", "retry", "retry", "dlt"], [0, 1, 6, 21]),
        (1, retry.NOT_RETRIED[1], ["dlt"], [0]),
    ],
)
def test_attempts(spark, failures, error, statuses, seconds):
    df = spark.createDataFrame([("e", TS)], "event_id string, arrival timestamp_ntz")
    rows = retry.attempts(df, F.lit(failures), F.lit(error).cast("string")).orderBy("attempt").collect()
    assert [r.status for r in rows] == statuses
    assert [(r.due_at - TS).total_seconds() for r in rows] == seconds


EMPLOYEES = [
    ("Alice", "Engineering", 95000.0),
    ("Bob", "Engineering", 72000.0),
    ("Charlie", "HR", 60000.0),
    ("Diana", "HR", 55000.0),
    ("Eve", "Sales", 80000.0),
]


def test_grouped_employees(spark):
    df = spark.createDataFrame(EMPLOYEES, "name string, department string, salary double")
    got = {
        r.department: (r.n, r.total, r.average, r.above, r.top)
        for r in df.groupBy("department")
        .agg(
            F.count("name").alias("n"),
            F.sum("salary").alias("total"),
            aggregates.mean(F.col("salary")).alias("average"),
            F.count_if(F.col("salary") > 70000).alias("above"),
            F.max_by("name", "salary").alias("top"),
        )
        .collect()
    }
    assert got == {
        "Engineering": (2, 167000, 83500, 2, "Alice"),
        "HR": (2, 115000, 57500, 0, "Charlie"),
        "Sales": (1, 80000, 80000, 1, "Eve"),
    }


@pytest.mark.parametrize(
    ("names", "text"),
    [([], ""), (["Alice"], "Alice"), (["Alice", "Bob"], "Alice, and Bob"), (["Alice", "Bob", "Charlie"], "Alice, Bob, and Charlie")],
)
def test_oxford_join(spark, names, text):
    df = spark.createDataFrame([(names,)], "v array<string>")
    assert one(df.select(aggregates.oxford_join(F.col("v")).alias("t"))).t == text


def test_partitioned_by_empty_input(spark):
    df = spark.createDataFrame([], "v double")
    got = {r.side: r.n for r in aggregates.partitioned_by(df, F.col("v") > 1, F.col("v")).collect()}
    assert got == {True: 0, False: 0}


def test_to_map_rejects_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="Duplicate key 1"):
        aggregates.to_map(df, "k", "v").collect()


def test_finished_matches(spark):
    rows = [("a", 2, 20, 3), ("b", 2, 5, 10), ("c", 1, 20, 10), ("d", 2, 19, 9)]
    df = spark.createDataFrame(rows, "match_id string, current_inning int, current_over int, wickets int")
    assert {r.match_id for r in view.active_matches(df).collect()} == {"c", "d"}


def test_p_value(spark):
    df = spark.createDataFrame([(0.0,), (1.959964,), (-2.575829,)], "z double")
    got = [r.p for r in df.select(aggregates.normal_two_sided(F.col("z")).alias("p")).collect()]
    assert got == pytest.approx([1.0, 0.05, 0.01], abs=1e-6)
