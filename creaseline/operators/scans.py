"""Reads over the stored tables. Predicates stay plain, so they reach the Parquet scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from creaseline.session import materialize


def laid_out(df: DataFrame, *by: str) -> DataFrame:
    """Write a table in the order of its reads and return it: a file holds a narrow range of ``by``, so a
    filter on it skips files and row groups by their bounds."""
    return materialize(df.repartitionByRange(*[F.col(c) for c in by]).sortWithinPartitions(*by))


def match_events(store: DataFrame, match_id: str) -> DataFrame:
    return store.where(F.col("match_id") == match_id).orderBy("event_sequence")


def point_get(view: DataFrame, match_id: str) -> DataFrame:
    return view.where(F.col("match_id") == match_id)


def batch_get(view: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the view for a key list of any size; AQE broadcasts the list when it is small."""
    return view.join(keys.select("match_id"), "match_id", "left_semi")


def by_match_and_time(store: DataFrame, match_id: str, start: Column, end: Column) -> DataFrame:
    return store.where((F.col("match_id") == match_id) & F.col("event_ts").between(start, end))


def by_event_id(store: DataFrame, event_id: str) -> DataFrame:
    return store.where(F.col("event_id") == event_id)


def gather(spark: SparkSession, paths: list[str], schema) -> DataFrame:
    """Concatenate shards; each shard is scanned in parallel and keeps its own filters."""
    shards = [spark.read.schema(schema).parquet(p).withColumn("shard", F.lit(i)) for i, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, shards)
