"""Copies compared by digests: what is found, and how little is read for it."""

import pytest
from pyspark.sql import functions as F

from creaseline.operators.digests import LEAF, compare_laid_out, differing, lay_out, rows_of
from creaseline.operators.joins import compare_copies


@pytest.fixture(scope="module")
def orders(spark):
    return spark.range(20_000).select("id", (F.col("id") % 9).alias("status"), F.concat(F.lit("t"), F.col("id")).alias("note"))


@pytest.fixture(scope="module")
def laid(orders):
    return lay_out(orders, ["id"])


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_equal_copies_read_no_rows(spark, orders, laid):
    other = lay_out(orders.repartition(7).select("note", "id", "status"), ["id"])
    assert differing(laid, other) == [[]]
    assert compare_laid_out(laid, other).count() == 0


def test_one_changed_row_reads_one_leaf(spark, orders, laid):
    changed = orders.withColumn("status", F.when(F.col("id") == 777, 100).otherwise(F.col("status")).cast("long"))
    other = lay_out(changed, ["id"])
    assert [len(level) for level in differing(laid, other)] == [1, 1, 1, 1]
    found = compare_laid_out(laid, other)
    scans = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x]
    assert rows(found) == [(777, 100, "t777", 0, 1), (777, 3, "t777", 1, 0)]
    leaf = differing(laid, other)[-1]
    assert rows_of(laid, leaf).count() < 30
    assert len(scans) == 2
    assert all(f"GreaterThanOrEqual({LEAF},{leaf[0]})" in x.partition("PushedFilters:")[2] for x in scans)


def test_any_damage_is_found_as_by_a_whole_comparison(spark, orders, laid):
    damaged = (
        orders.where("id % 611 <> 0")
        .withColumn("note", F.when(F.col("id") % 977 == 0, None).otherwise(F.col("note")))
        .unionByName(orders.where("id % 1999 = 5"))  # repeated rows
        .unionByName(spark.createDataFrame([(None, 1, "x"), (None, 1, "x"), (90_000, None, None)], "id long, status long, note string"))
    )
    assert rows(compare_laid_out(laid, lay_out(damaged, ["id"]))) == rows(compare_copies(orders, damaged))


def test_more_leaves_than_ranges(spark, orders, laid):
    half = orders.where("id % 20 <> 0")
    other = lay_out(half, ["id"])
    assert len(differing(laid, other)[-1]) > 800
    assert rows(compare_laid_out(laid, other)) == rows(compare_copies(orders, half))


def test_neighbouring_nulls_and_empty_copies_are_told_apart(spark):
    schema = "id long, a string, b string"
    one = lay_out(spark.createDataFrame([(1, None, "x")], schema), ["id"], depth=1)
    two = lay_out(spark.createDataFrame([(1, "x", None)], schema), ["id"], depth=1)
    none = lay_out(spark.createDataFrame([], schema), ["id"], depth=1)
    assert compare_laid_out(one, two).count() == 2
    assert compare_laid_out(one, none).count() == 1 and compare_laid_out(none, none).count() == 0


def test_a_key_with_a_third_of_all_rows_spreads_over_files(spark, many_slots):
    skewed = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("key"), "id")
    copy = lay_out(skewed, ["key"], depth=1)
    heavy = copy.rows.where("key = 1").groupBy(F.input_file_name()).count()
    assert heavy.count() > 1
    other = lay_out(skewed.where("id <> 3"), ["key"], depth=1)
    assert rows(compare_laid_out(copy, other)) == [(1, 3, 1, 0)]


def test_copies_laid_out_differently_are_refused(spark, orders, laid):
    with pytest.raises(ValueError):
        differing(laid, lay_out(orders, ["id"], depth=2))
    with pytest.raises(ValueError):
        lay_out(orders.withColumnRenamed("note", LEAF), ["id"])
