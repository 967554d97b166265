"""Aggregations. Everything folds map-side; lists are paged so that no row grows with the data."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from creaseline.functions.scalars import ratio_percent
from creaseline.operators.hotkeys import SLOT, paged_lists, running, spread


def mean(value: Column, digits: int = 6) -> Column:
    """Average of a two-decimal amount, summed exactly."""
    exact = F.sum(value.cast("decimal(18,2)")).cast("double")
    return F.round(exact / F.count(value), digits)


def money(value: Column) -> Column:
    return F.sum(value.cast("decimal(18,2)")).cast("decimal(28,2)")


def latency_buckets(df: DataFrame, keys: list[str], latency: Column, bounds: list[int]) -> DataFrame:
    """Cumulative counts per upper bound, as an SLO histogram reports them."""
    counts = [F.count_if(latency <= b).alias(f"le_{b}") for b in bounds]
    return df.groupBy(*keys).agg(F.count(latency).alias("n"), *counts, F.max(latency).alias("max"))


def exact_percentiles(df: DataFrame, key: str, value: str, points: list[float]) -> DataFrame:
    """Smallest value whose cumulative share reaches each point.

    Values are counted first, so what is ordered is one row per distinct value of a key.
    """
    counted = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    tagged = spread(counted, [key], [value])
    ranked = running(tagged, [key], [value], {"_cum": F.col("_n")}).drop(SLOT)
    totals = counted.groupBy(key).agg(F.sum("_n").alias("_total"))
    reached = ranked.join(totals, key)
    at = [
        F.min(F.when(F.col("_cum") >= F.lit(p) * F.col("_total"), F.col(value))).alias(f"p{round(p * 100)}")
        for p in points
    ]
    return reached.groupBy(key).agg(*at)


def facets(df: DataFrame, fields: dict[str, Column], size: int = 10) -> DataFrame:
    """Top terms of several fields in one scan and one shuffle: count descending, then term."""
    terms = F.array(*[F.struct(F.lit(n).alias("facet"), c.cast("string").alias("term")) for n, c in fields.items()])
    counted = (
        df.select(F.explode(terms).alias("t"))
        .where("t.term IS NOT NULL")
        .groupBy("t.facet", "t.term")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rank = F.row_number().over(W.partitionBy("facet").orderBy(F.desc("n"), "term"))
    return counted.withColumn("_rn", rank).where(F.col("_rn") <= size).drop("_rn")


def month_histogram(df: DataFrame, ts: str) -> DataFrame:
    """Counts per month, months without rows between the first and the last included."""
    month = F.date_trunc("month", F.col(ts)).cast("date")
    counts = df.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n"))
    span = counts.agg(F.min("month").alias("first"), F.max("month").alias("last"))
    grid = span.select(F.explode(F.sequence("first", "last", F.expr("INTERVAL 1 MONTH"))).alias("month"))
    return grid.join(counts, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


def empty_hours_too(counts: DataFrame, hour: str, key: str) -> DataFrame:
    """Add a zero row for each hour of the whole span in which a key has none.

    The span is one row and a key's row repeats it, so the grid grows with time and keys only.
    """
    span = counts.agg(F.min(hour).alias("first"), F.max(hour).alias("last"))
    first, last = span.select("first").scalar(), span.select("last").scalar()
    grid = counts.select(key).distinct().withColumn(hour, F.explode(F.sequence(first, last, F.expr("INTERVAL 1 HOUR"))))
    return grid.join(counts, [hour, key], "left").select(hour, key, F.coalesce("n", F.lit(0)).alias("n"))


def range_buckets(df: DataFrame, value: Column, bounds: list[float], name: str = "bucket") -> DataFrame:
    """Counts per half-open range between the bounds; the last range is open above."""
    label = F
    for low, high in zip(bounds, [*bounds[1:], None], strict=True):
        condition = value >= low if high is None else (value >= low) & (value < high)
        label = label.when(condition, f"{low}-{'*' if high is None else high}")
    return df.groupBy(label.alias(name)).agg(F.count(F.lit(1)).alias("n")).where(F.col(name).isNotNull())


def player_stats(appearances: DataFrame, digits: int = 6) -> DataFrame:
    """Per player: sums, matches and strike rate. One row per appearance goes in."""
    return appearances.groupBy("player_id").agg(
        F.sum("runs").alias("total_runs"),
        F.sum("balls_faced").alias("total_balls"),
        F.sum("wickets").alias("total_wickets"),
        F.sum("catches").alias("total_catches"),
        F.count(F.lit(1)).alias("matches_played"),
        F.round(ratio_percent(F.sum("runs"), F.sum("balls_faced")), digits).alias("strike_rate"),
    )


def partitioned_by(df: DataFrame, condition: Column, value: Column) -> DataFrame:
    """Count and sum of both sides of a condition; both rows exist even when a side is empty."""
    yes = F.coalesce(condition, F.lit(False))

    def side(flag: bool) -> Column:
        keep = yes if flag else ~yes
        total = F.sum(F.when(keep, value.cast("decimal(18,2)"))).cast("decimal(28,2)")
        return F.struct(F.lit(flag).alias("side"), F.count_if(keep).alias("n"), F.coalesce(total, F.lit(0)).alias("total"))

    return df.agg(F.array(side(True), side(False)).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def distinct_lists(df: DataFrame, keys: list[str], value: str, size: int = 1000) -> DataFrame:
    """Distinct texts per key as ordered pages; duplicates vanish before the shuffle."""
    unique = df.select(*keys, value).distinct()
    return paged_lists(unique, keys, [value], F.col(value), size)


def to_map(df: DataFrame, key: str, value: str, merge: str = "error", order: str | None = None, size: int = 1000) -> DataFrame:
    """Key-value maps in pages of ``size`` consecutive integer keys.

    ``merge="error"`` fails on a duplicate key, ``"first"`` keeps the value with the lowest ``order``.
    """
    if merge == "error":
        message = F.concat(F.lit("Duplicate key "), F.col(key).cast("string"))
        one = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias(value))
        one = one.withColumn(value, F.when(F.col("_n") > 1, F.raise_error(message)).otherwise(F.col(value)))
    else:
        one = df.groupBy(key).agg(F.min_by(value, order).alias(value))
    entries = F.array_sort(F.collect_list(F.struct(key, value)))
    return one.groupBy(F.expr(f"{key} div {size}").alias("page")).agg(F.map_from_entries(entries).alias("entries"))


def normal_two_sided(z: Column) -> Column:
    """Two-sided p-value of a standard normal score (Abramowitz and Stegun 7.1.26, error below 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = F.lit(1.0) / (F.lit(1.0) + x * 0.3275911)
    # The polynomial coefficients, highest power first.
    poly = F.lit(0.0)
    for c in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = (poly + c) * t
    return poly * F.exp(-x * x)


def experiment_result(df: DataFrame, variant: Column, converted: Column, alpha: float = 0.05) -> DataFrame:
    """Two-proportion z-test between variants A and B, in one aggregate."""
    rows = df.agg(
        F.count_if(variant == "A").alias("n_a"),
        F.count_if(variant == "B").alias("n_b"),
        F.count_if((variant == "A") & converted).alias("hits_a"),
        F.count_if((variant == "B") & converted).alias("hits_b"),
    )
    rate_a, rate_b = F.col("hits_a") / F.col("n_a"), F.col("hits_b") / F.col("n_b")
    pooled = (F.col("hits_a") + F.col("hits_b")) / (F.col("n_a") + F.col("n_b"))
    error = F.sqrt(pooled * (1 - pooled) * (F.lit(1.0) / F.col("n_a") + F.lit(1.0) / F.col("n_b")))
    z = F.when(error > 0, (rate_a - rate_b) / error).otherwise(F.lit(0.0))
    tested = rows.select("*", rate_a.alias("rate_a"), rate_b.alias("rate_b"), z.alias("z"), normal_two_sided(z).alias("p"))
    significant = F.col("p") < alpha
    winner = F.when(~significant, "none").when(F.col("rate_a") > F.col("rate_b"), "A").otherwise("B")
    return tested.select(
        "n_a",
        "n_b",
        "hits_a",
        "hits_b",
        F.round("rate_a", 6).alias("rate_a"),
        F.round("rate_b", 6).alias("rate_b"),
        F.round("p", 5).alias("p_value"),
        significant.alias("significant"),
        winner.alias("winner"),
    )


def key_distribution(df: DataFrame, key: str, top: int = 20, factor: int = 10) -> DataFrame:
    """Heaviest keys and whether they exceed ``factor`` times the mean key."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    average = counts.agg(F.avg("n")).scalar()
    heaviest = counts.orderBy(F.desc("n"), key).limit(top)
    return heaviest.withColumn("hot", F.col("n") > F.lit(factor) * average)


def oxford_join(values: Column) -> Column:
    """``a, b, and c`` from an ordered array; one value stands alone, none is empty."""
    head = F.array_join(F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(1))), ", ")
    return (
        F.when(F.size(values) == 0, "")
        .when(F.size(values) == 1, F.get(values, F.lit(0)))
        .otherwise(F.concat(head, F.lit(", and "), F.try_element_at(values, F.lit(-1))))
    )
