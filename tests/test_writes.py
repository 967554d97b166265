"""Table rewrites."""

from pyspark.sql import functions as F

from creaseline.operators.writes import apply_changes, delete_where, start_replays, versioned_update


def test_delete_keeps_rows_whose_condition_is_null(spark):
    df = spark.createDataFrame([(1, 1), (2, None)], "k int, v int")
    assert [r.k for r in delete_where(df, F.col("v") == 1).collect()] == [2]


def test_versioned_update(spark):
    df = spark.createDataFrame([(1, 3, "a"), (2, 5, "b")], "k int, version int, value string")
    updates = spark.createDataFrame([(1, 3, "x"), (2, 4, "y"), (9, 1, "z")], "k int, expected int, value string")
    table, outcomes = versioned_update(df, updates, "k", "version")
    assert sorted(map(tuple, table.collect())) == [(1, 4, "x"), (2, 5, "b")]
    assert {r.k: r.outcome for r in outcomes.collect()} == {1: "applied", 2: "rejected", 9: "rejected"}


def test_last_change_wins(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    feed = [(1, 1, "u", "x"), (1, 2, "d", None), (2, 1, "d", None), (2, 2, "c", "again"), (3, 1, "c", "new")]
    changes = spark.createDataFrame(feed, "k int, n int, op string, v string")
    assert sorted(map(tuple, apply_changes(df, changes, "k", "n", ["v"]).collect())) == [(2, "again"), (3, "new")]


def test_one_active_replay_per_match(spark):
    requests = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "match_id string, request_id long")
    state = spark.createDataFrame([("a", "COMPLETED"), ("b", "IN_PROGRESS")], "match_id string, status string")
    totals = spark.createDataFrame([("a", 7)], "match_id string, total long")
    got = {r.request_id: (r.http_status, r.total) for r in start_replays(requests, state, totals).collect()}
    assert got == {1: (202, 7), 2: (409, None), 3: (409, None)}
