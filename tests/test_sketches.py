"""Sketch tables: spans from stored sketches, refreshes in order, late, repeated and cut short."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from creaseline.operators.sketches import SketchTable, distinct_close, distinct_count, quantile

DAYS = 12


@pytest.fixture
def visits(spark):
    day = F.date_add(F.lit("2024-03-01").cast("date"), (F.col("id") % DAYS).cast("int"))
    return spark.range(30_000).select(
        day.alias("day"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"), (F.col("id") * 7919 % 9000).alias("who"),
        (F.col("id") * 31 % 1000).cast("int").alias("ms"), "id",
    )


def table(spark, rows, **more):
    return SketchTable(spark, rows.schema, "day", ["kind"], ["who"], ["ms"], buckets=6, **more)


def day(n):
    return F.lit(date(2024, 3, n))


def test_spans_come_from_the_stored_sketches_alone(spark, visits):
    kept = table(spark, visits)
    kept.refresh(visits.where("id % 5 <> 0"), 1)
    kept.refresh(visits.where("id % 5 = 0"), 2)
    span = kept.rollup(day(3), day(9))
    plan = span._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "GreaterThanOrEqual(day,2024-03-03)" in plan.partition("PushedFilters:")[2]
    assert all(f"{kept.stored.root}/data" in f for f in span.inputFiles())
    got = span.select("kind", "n", distinct_count("who").alias("users"), quantile("ms", 0.5).alias("p50"))
    exact = visits.where(F.col("day").between(day(3), day(9))).groupBy("kind").agg(
        F.count(F.lit(1)).alias("total"), F.countDistinct("who").alias("exact")
    )
    rows = got.join(exact, "kind").withColumn("close", distinct_close(F.col("users"), F.col("exact"))).collect()
    assert len(rows) == 2 and all(r.n == r.total and r.close and abs(r.p50 - 500) <= 15 for r in rows)
    whole = kept.rollup(by=[]).select("n", distinct_count("who").alias("users")).first()
    assert whole.n == 30_000 and abs(whole.users - 9000) <= 9000 * 0.065


def test_a_batch_that_runs_again_adds_nothing(spark, visits):
    kept = table(spark, visits)
    kept.refresh(visits.where("id < 20000"), 1)
    kept.refresh(visits.where("id >= 20000"), 2)
    once = {tuple(r) for r in kept.rollup(by=["day", "kind"]).select("day", "kind", "n", distinct_count("who")).collect()}
    kept.refresh(visits.where("id >= 20000"), 2)
    again = {tuple(r) for r in kept.rollup(by=["day", "kind"]).select("day", "kind", "n", distinct_count("who")).collect()}
    assert once == again and sum(r[2] for r in again) == 30_000


def test_a_refresh_that_was_cut_short_is_completed(spark, visits, monkeypatch):
    kept = table(spark, visits)
    kept.refresh(visits.where("id < 20000"), 1)
    with monkeypatch.context() as broken:
        broken.setattr(kept.stored, "_redo", lambda folder: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            kept.refresh(visits.where("id >= 20000"), 2)
    assert kept.rollup(by=[]).first().n == 20_000
    kept.recover().refresh(visits.where("id >= 20000"), 2)
    assert kept.rollup(by=[]).first().n == 30_000


def test_only_buckets_of_touched_days_are_rewritten(spark, visits):
    kept = table(spark, visits)
    everything = kept.refresh(visits, 1)
    one = kept.refresh(visits.where(F.col("day") == day(4)), 2)
    assert len(one) == 1 < len(everything)


def test_nulls_and_nothing(spark, visits):
    kept = table(spark, visits)
    assert kept.refresh(visits.where("false"), 1) == []
    assert kept.rollup().count() == 0
    odd = spark.createDataFrame([(None, "a", 1, 5, 1), (date(2024, 3, 1), None, None, None, 2)], "day date, kind string, who long, ms int, id long")
    kept.refresh(odd, 2)
    kept.refresh(odd, 2)
    assert kept.stored.read().count() == 2
    rows = kept.rollup().select("kind", "n", distinct_count("who").alias("users"), quantile("ms", 0.5).alias("p50")).collect()
    assert [tuple(r) for r in rows] == [(None, 1, 0, None)]
