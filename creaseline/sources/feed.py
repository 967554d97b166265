"""A ball feed derived from the ``events`` table: one user is one match.

The feed carries originals plus redeliveries, corrections and unreadable records, as a log would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from creaseline.functions.scalars import event_sequence
from creaseline.operators.hotkeys import SLOT, running, spread
from creaseline.schemas import BALL_COLUMNS

BALLS_PER_INNING = 36
LOG_PARTITIONS = 192
ORIGINAL, REDELIVERY, CORRECTION, POISON = 0, 1, 2, 3
ARRIVAL_ORDER = ["arrival", "kind", "src_id"]


def balls(events: DataFrame) -> DataFrame:
    """Balls with carried totals, plus ``src_id``, ``user_id`` and ``arrival``."""
    tagged = spread(events.select("event_id", "ts", "user_id", "event_type", "value"), ["user_id"], ["ts", "event_id"])
    numbered = running(tagged, ["user_id"], ["ts", "event_id"], {"rn": F.lit(1)})
    k = F.when(F.col("rn") <= BALLS_PER_INNING, F.col("rn") - 1).otherwise(F.col("rn") - 1 - BALLS_PER_INNING)
    v = F.floor("value")
    placed = numbered.select(
        F.col("event_id").alias("src_id"),
        "user_id",
        "ts",
        SLOT,
        F.when(F.col("rn") <= BALLS_PER_INNING, 1).otherwise(2).alias("inning"),
        k.alias("k"),
        F.when(v % 6 == 5, 6).otherwise(v % 6).cast("int").alias("runs"),
        F.when(F.col("event_type") == "view", (v % 3).cast("int")).alias("extras"),
        (F.col("event_type") == "error").alias("wicket"),
    )
    scored = running(
        placed,
        ["user_id", "inning"],
        ["k"],
        {"total_runs": F.col("runs"), "wickets": F.col("wicket").cast("int")},
    )
    late = F.when(F.col("src_id") % 7 == 0, F.expr("INTERVAL 2 HOURS")).otherwise(F.expr("INTERVAL 0 HOURS"))
    # clocks of whole seconds, of milliseconds and of microseconds
    clock = (
        F.when(F.col("src_id") % 3 == 0, F.date_trunc("second", "ts"))
        .when(F.col("src_id") % 3 == 1, F.date_trunc("millisecond", "ts"))
        .otherwise(F.col("ts"))
        .cast("timestamp_ntz")
    )
    return scored.select(
        F.col("src_id").cast("string").alias("event_id"),
        F.concat(F.lit("M-"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("match_id"),
        "inning",
        F.expr("k div 6").cast("int").alias("over_no"),
        (F.col("k") % 6 + 1).cast("int").alias("ball"),
        F.when(F.col("inning") == 1, "A").otherwise("B").alias("team"),
        "runs",
        "extras",
        "wicket",
        F.col("total_runs").cast("int").alias("total_runs"),
        F.col("wickets").cast("int").alias("wickets"),
        clock.alias("ts"),
        (F.col("ts") + late).alias("arrival"),
        "src_id",
        "user_id",
    )


def _kinds() -> Column:
    def when(divisor: int, kind: int) -> Column:
        return F.when(F.col("src_id") % divisor == 0, F.lit(kind))

    kinds = F.array(F.lit(ORIGINAL), when(10, REDELIVERY), when(25, CORRECTION), when(40, POISON))
    return F.explode(F.array_compact(kinds))


def feed(balls_df: DataFrame) -> DataFrame:
    """One row per delivery. Narrow: every ball becomes one to four rows in place."""
    kind = F.col("kind")
    out = balls_df.withColumn("kind", _kinds())
    delay = (
        F.when(kind == REDELIVERY, F.expr("INTERVAL 1 MINUTE"))
        .when(kind == CORRECTION, F.expr("INTERVAL 5 MINUTES"))
        .when(kind == POISON, F.expr("INTERVAL 10 MINUTES"))
        .otherwise(F.expr("INTERVAL 0 MINUTES"))
    )
    return out.select(
        F.when(kind == CORRECTION, F.concat("event_id", F.lit("-c"))).otherwise(F.col("event_id")).alias("event_id"),
        *[c for c in BALL_COLUMNS if c not in ("event_id", "runs")],
        F.when(kind == CORRECTION, (F.col("runs") + 1) % 7).otherwise(F.col("runs")).alias("runs"),
        (F.col("arrival") + delay).alias("arrival"),
        "kind",
        "src_id",
        (F.col("user_id") % LOG_PARTITIONS).cast("int").alias("partition"),
    )


def with_offsets(feed_df: DataFrame) -> DataFrame:
    """Number the deliveries of each log partition by arrival."""
    tagged = spread(feed_df, ["partition"], ARRIVAL_ORDER)
    ranked = running(tagged, ["partition"], ARRIVAL_ORDER, {"offset": F.lit(1)})
    return ranked.withColumn("offset", F.col("offset") - 1).drop(SLOT)


def sequenced(feed_df: DataFrame) -> DataFrame:
    """Deliveries with their ball key; unreadable ones are left out."""
    return feed_df.where(F.col("kind") != POISON).withColumn("event_sequence", event_sequence())
