"""Joins. The physical choice is left to Catalyst and AQE wherever no layout is at stake."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from creaseline.operators.hotkeys import paged_lists
from creaseline.session import materialize

ROWS_PER_SALT = 1_000_000


def count_and_sum(parents: DataFrame, children: DataFrame, key: str, value: Column) -> DataFrame:
    """Left join with aggregates, parents without children kept with zeros.

    The children are folded first, so the join sees one row per key and cannot skew.
    """
    folded = children.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    joined = parents.join(folded, key, "left")
    return joined.withColumns({"n": F.coalesce("n", F.lit(0)), "total": F.coalesce("total", F.lit(0))})


def having_any(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Semi-join: IN, EXISTS, has-child and has-parent."""
    return df.join(other.select(key), key, "left_semi")


def salted(left: DataFrame, right: DataFrame, key: str, spread: Column, rows: int = ROWS_PER_SALT):
    """(left, right) with a salt: a key gets one for every ``rows`` left rows that it has, and a right row
    is repeated once for each salt of its key."""
    counts = left.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_salts"))
    spreading = left.join(counts, key).withColumn("_salt", F.pmod(spread, F.col("_salts")).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))
    return spreading.drop("_salts"), right.join(counts, key).withColumn("_salt", salts).drop("_salts")


def colocate(df: DataFrame, keys: list[str], buckets: int) -> str:
    """Write the rows bucketed and sorted by ``keys``, one file per bucket; joins on them need no
    shuffle later. Returns the table's name."""
    name = f"colocated_{uuid.uuid4().hex}"
    (df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(name))
    return name


def colocated_join(left: DataFrame, right: DataFrame, key: str, spread: Column, buckets: int | None = None) -> DataFrame:
    """Join of two tables that are laid out on the same buckets, heavy keys spread over salts.

    Without a number there are as many buckets as the session has shuffle partitions. The result is
    written and the two tables are dropped.
    """
    spark = left.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    on = [key, "_salt"]
    names = [colocate(df, on, buckets) for df in salted(left, right, key, spread)]
    try:
        one, other = (spark.table(n) for n in names)
        return materialize(one.hint("merge").join(other, on).drop("_salt"))
    finally:
        for name in names:
            spark.sql(f"DROP TABLE {name}")


def fetch_children(
    parents: DataFrame, children: DataFrame, key: str, order: list[str], value: Column, size: int = 1000
) -> DataFrame:
    """Parents with their children nested, in pages of bounded size; childless parents have one empty page."""
    pages = paged_lists(children, [key], order, value, size, "children")
    joined = parents.join(pages, key, "left")
    empty = F.array().cast(pages.schema["children"].dataType)
    return joined.withColumns({"page": F.coalesce("page", F.lit(0)), "children": F.coalesce("children", empty)})


def compare_copies(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose number of occurrences differs between two copies: ``n_left`` and ``n_right``.

    One shuffle with map-side combine, instead of an EXCEPT ALL in each direction.
    """
    both = left.withColumn("_side", F.lit(0)).unionByName(right.withColumn("_side", F.lit(1)))
    counted = both.groupBy(*left.columns).agg(
        F.count_if(F.col("_side") == 0).alias("n_left"), F.count_if(F.col("_side") == 1).alias("n_right")
    )
    return counted.where("n_left <> n_right")
