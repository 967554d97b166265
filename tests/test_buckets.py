"""Stored tables in buckets: what a change touches and what it leaves alone."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from creaseline.operators.buckets import BucketTable


def files(table):
    """Files of each bucket."""
    out = {}
    for path in Path(f"{table.root}/data").rglob("*.parquet"):
        out.setdefault(int(path.parent.name.split("=")[1]), set()).add((path.name, path.stat().st_mtime_ns))
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def table(spark):
    return BucketTable.create(spark.range(400).select("id", (F.col("id") % 7).alias("v")), ["id"], buckets=20)


def changed(table, act):
    before = files(table)
    touched = act()
    after = files(table)
    assert set(after) == set(before)
    assert {b for b in after if after[b] != before[b]} == set(touched)
    return touched


def test_only_touched_buckets_are_written(spark, table):
    assert rows(table.read()) == sorted([(i, i % 7) for i in range(400)], key=repr) and len(files(table)) == 20
    changes = spark.createDataFrame([(3, 1, "u", 50), (3, 2, "u", 51), (8, 1, "d", None), (1000, 1, "c", 9), (1001, 1, "d", None)], "id int, n int, op string, v long")
    touched = changed(table, lambda: table.apply_changes(changes, "n", ["v"]))
    assert 1 <= len(touched) <= 4
    want = {i: i % 7 for i in range(400)} | {3: 51, 1000: 9}
    del want[8]
    assert rows(table.read()) == sorted(want.items(), key=repr)
    # the scan of the touched buckets is pruned to their folders
    plan = table.rows_of(touched)._jdf.queryExecution().executedPlan().toString()
    assert "__bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]

    two = spark.createDataFrame([(20,), (21,)], "id long")
    assert changed(table, lambda: table.delete_where(F.col("id").isin(20, 21))) == table.buckets_of(two)
    assert changed(table, lambda: table.update_where(F.col("v") > 100, {"v": F.lit(0)})) == []
    changed(table, lambda: table.update_keys(spark.createDataFrame([(30,), (-1,)], "id short"), {"v": F.lit(77)}))
    changed(table, lambda: table.upsert(spark.createDataFrame([(31, 78), (2000, 79)], "id long, v long")))
    got = dict(rows(table.read()))
    assert got[30] == 77 and got[31] == 78 and got[2000] == 79 and 20 not in got and len(got) == 399


def test_a_bucket_may_lose_all_its_rows_and_fill_again(spark, table):
    touched = table.buckets_of(spark.range(1))
    ids = [r.id for r in table.rows_of(touched).collect()]
    assert changed(table, lambda: table.delete_keys(spark.createDataFrame([(i,) for i in ids], "id long"))) == touched
    assert table.rows_of(touched).count() == 0 and table.read().count() == 400 - len(ids)
    table.upsert(spark.createDataFrame([(0, 5)], "id long, v long"))
    assert rows(table.rows_of(touched)) == [(0, 5)]


def test_outcomes_of_versioned_updates(spark):
    table = BucketTable.create(spark.createDataFrame([(1, 3, "a"), (2, 5, "b")], "k int, version int, value string"), ["k"])
    updates = spark.createDataFrame([(1, 3, "x"), (2, 4, "y"), (9, 1, "z")], "k int, expected int, value string")
    outcomes = table.versioned_update(updates, "version")
    assert {r.k: r.outcome for r in outcomes.collect()} == {1: "applied", 2: "rejected", 9: "rejected"}
    assert rows(table.read()) == [(1, 4, "x"), (2, 5, "b")]


def test_a_lost_driver_leaves_a_redo(spark, table, monkeypatch):
    """The new contents are complete and noted, then the driver goes: another one puts them in place."""
    monkeypatch.setattr(table, "_redo", lambda folder: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.delete_where(F.col("id") < 10)
    again = BucketTable(spark, table.read().schema, ["id"], table.root, 20)
    assert again.read().count() == 400
    assert again.recover().read().count() == 390
    before = files(again)
    assert files(again.recover()) == before


def test_keys_that_leave_their_bucket_are_refused(spark, table):
    with pytest.raises(Exception, match="not rewritten"):
        table.update_where(F.col("id") == 5, {"id": F.col("id") + 12345})
    assert table.read().count() == 400


def test_null_keys_and_empty_tables(spark):
    table = BucketTable.create(spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int"), ["k"])
    table.delete_where(F.col("v") == 2)
    assert rows(table.read()) == [(None, 1)]
    empty = BucketTable.create(spark.createDataFrame([], "k string, v int"), ["k"])
    assert empty.read().count() == 0
    empty.upsert(spark.createDataFrame([("b", 1)], "k string, v int"))
    assert rows(empty.read()) == [("b", 1)]
