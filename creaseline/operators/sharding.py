"""Shard placement: modulus, string hash, and a consistent-hash ring."""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from creaseline.functions.scalars import java_abs, java_hash, md5_position

VIRTUAL_NODES = 150


def ring_points(shards: list[str], virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, str]]:
    """Sorted (position, shard): the first eight MD5 bytes of ``shard#i``, signed."""
    points = {}
    for shard in shards:
        for i in range(virtual_nodes):
            digest = hashlib.md5(f"{shard}#{i}".encode()).digest()
            points[int.from_bytes(digest[:8], "big", signed=True)] = shard
    return sorted(points.items())


RING_BITS = 10


def ring_table(spark: SparkSession, shards: list[str]) -> DataFrame:
    """The ring cut into 1024 arcs: the points of each arc, their owners, and the next owner after it.

    Its size is fixed by the number of arcs, whatever the data.
    """
    points = ring_points(shards)
    positions = [p for p, _ in points]
    arc = 1 << (64 - RING_BITS)
    rows = []
    for number in range(-(1 << RING_BITS) // 2, (1 << RING_BITS) // 2):
        first = bisect_left(positions, number * arc)
        last = bisect_left(positions, (number + 1) * arc)
        following = points[last % len(points)][1]
        rows.append((number, positions[first:last], [s for _, s in points[first:last]] + [following]))
    return spark.createDataFrame(rows, "arc bigint, positions array<bigint>, owners array<string>")


def ring_lookup(df: DataFrame, key: Column, shards: list[str], name: str = "shard") -> DataFrame:
    """Owner of each key: the first point at or after it, or the first point of the ring.

    An equi-join on the arc leaves a handful of points to compare with, and the data stays in place.
    """
    ring = ring_table(df.sparkSession, shards)
    placed = df.withColumn("_position", md5_position(key)).withColumn(
        "arc", F.shiftright("_position", 64 - RING_BITS)
    )
    below = F.size(F.filter("positions", lambda p: p < F.col("_position")))
    found = placed.join(F.broadcast(ring), "arc").withColumn(name, F.get("owners", below))
    return found.drop("arc", "positions", "owners", "_position")


def variant(user: Column, experiment: str, split: float) -> tuple[Column, Column]:
    """(included in the experiment, variant A or B) from the 32-bit string hash."""
    included = java_abs(java_hash(user)) % 100 < F.lit(split * 100)
    parity = java_abs(java_hash(F.concat(user, F.lit(experiment)))) % 2
    return included, F.when(parity == 0, "A").otherwise("B")


def salted_totals(df: DataFrame, key: str, spread: Column, measures: dict[str, Column], salts: int = 10) -> DataFrame:
    """Two-phase sums: first per ``key#salt``, then per key."""
    salt = F.pmod(spread, F.lit(salts)).cast("string")
    partial = df.groupBy(key, F.concat(F.col(key), F.lit("#"), salt).alias("salted_key")).agg(
        *[F.sum(e).alias(n) for n, e in measures.items()]
    )
    return partial.groupBy(key).agg(F.count(F.lit(1)).alias("salts"), *[F.sum(n).alias(n) for n in measures])
