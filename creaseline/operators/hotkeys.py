"""Ordered per-key computations that survive a key holding a large share of all rows.

A plain window puts a whole key into one task. Here the rows are range-partitioned by key and order and
written once with the number of their partition as a slot, so a key of any size is cut into as many slots
as it fills partitions. Each (key, slot) is a window partition of its own; what earlier slots of a key
leave to a later one comes from a table with a row per key and slot, of which only the later slots
are joined: fewer rows than there are partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from creaseline.session import materialize

SLOT = "_slot"


def spread(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add a slot that does not decrease along ``order`` within a key. ``order`` should be unique per key."""
    ranged = df.repartitionByRange(*[F.col(c) for c in [*keys, *order]])
    return materialize(ranged.withColumn(SLOT, F.spark_partition_id()))


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums per key, for rows from :func:`spread`."""
    part = [*keys, SLOT]
    local = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = df.select("*", *[F.sum(e).over(local).alias(n) for n, e in sums.items()])
    totals = df.groupBy(*part).agg(*[F.sum(e).alias(f"_c_{n}") for n, e in sums.items()])
    earlier = W.partitionBy(*keys).orderBy(SLOT).rowsBetween(W.unboundedPreceding, -1)
    place = F.row_number().over(W.partitionBy(*keys).orderBy(SLOT)).alias("_place")
    carry = totals.select(*part, place, *[F.sum(f"_c_{n}").over(earlier).alias(f"_c_{n}") for n in sums])
    joined = out.join(carry.where("_place > 1").drop("_place"), part, "left")
    return joined.select(
        *df.columns,
        *[(F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0))).alias(n) for n in sums],
    )


def previous(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """Value of the row before, per key: ``values`` maps new column -> source column."""
    part = [*keys, SLOT]
    local = W.partitionBy(*part).orderBy(*order)
    lagged = [F.lag(src).over(local).alias(n) for n, src in values.items()]
    out = df.select("*", F.row_number().over(local).alias("_rn"), *lagged)
    last = F.max_by(F.struct(*[F.col(s).alias(n) for n, s in values.items()]), F.struct(*order)).alias("_last")
    carry = df.groupBy(*part).agg(last).select(*part, F.lag("_last").over(W.partitionBy(*keys).orderBy(SLOT)).alias("_carry"))
    joined = out.join(carry.where("_carry IS NOT NULL"), part, "left")
    return joined.select(
        *df.columns,
        *[F.when(F.col("_rn") == 1, F.col(f"_carry.{n}")).otherwise(F.col(n)).alias(n) for n in values],
    )


def paged_lists(
    df: DataFrame, keys: list[str], order: list[str], value: Column, size: int = 1000, name: str = "items"
) -> DataFrame:
    """Ordered lists per key, in pages of ``size`` values: whole results, bounded rows."""
    ranked = running(spread(df, keys, order), keys, order, {"_rank": F.lit(1)})
    return (
        ranked.withColumn("page", F.expr(f"(_rank - 1) div {size}").cast("int"))
        .groupBy(*keys, "page")
        .agg(F.array_sort(F.collect_list(F.struct("_rank", value.alias("v")))).alias("_items"))
        .select(*keys, "page", F.transform("_items", lambda s: s["v"]).alias(name))
    )
