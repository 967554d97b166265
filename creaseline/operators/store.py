"""Event store: first write wins per ball, rows never change afterwards."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from creaseline.functions.scalars import epoch_seconds, ttl
from creaseline.schemas import BALL_COLUMNS, BALL_KEY, LOG_ORDER


def first_arrivals(df: DataFrame, key: Sequence[str] = BALL_KEY, order: Sequence[str] = LOG_ORDER) -> DataFrame:
    """First row per key by arrival.

    ``row_number() = 1`` lets Catalyst keep one row per key in every map task before the shuffle
    (WindowGroupLimit), so a ball that was delivered a billion times costs one row per task.
    """
    rank = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def storable() -> Column:
    """Whether a decoded ball can become a store row: everything but the extras is there."""
    present = [F.col(c).isNotNull() for c in BALL_COLUMNS if c != "extras"]
    return reduce(and_, present) & (F.col("match_id") != "")


def accept(
    batch: DataFrame,
    store: DataFrame | None = None,
    key: Sequence[str] = BALL_KEY,
    order: Sequence[str] = LOG_ORDER,
) -> tuple[DataFrame, DataFrame]:
    """Conditional put: (accepted, duplicates).

    The default key is the ball; ``key=["event_id"]`` de-duplicates by event instead. Duplicates are
    the later rows of a key, and with a store also the first where the store has it: the same window
    and the same partitioning decide both.
    """
    accepted = first_arrivals(batch, key, order)
    later = F.row_number().over(W.partitionBy(*key).orderBy(*order)) > 1
    ranked = batch.withColumn("_later", later)
    if store is not None:
        accepted = accepted.join(store.select(*key), list(key), "left_anti")
        known = store.select(*key).distinct().withColumn("_known", F.lit(True))
        ranked = ranked.join(known, list(key), "left").withColumn("_later", F.col("_later") | F.coalesce("_known", F.lit(False)))
    return accepted, ranked.where("_later").select(*batch.columns)


def stored_rows(df: DataFrame, *extra: str) -> DataFrame:
    """Columns of the stored event, with its expiry time."""
    return df.select(
        "match_id",
        "event_sequence",
        "event_id",
        "inning",
        "over_no",
        "ball",
        "team",
        "runs",
        "extras",
        "wicket",
        "total_runs",
        "wickets",
        F.col("ts").alias("event_ts"),
        ttl(F.col("ts")).alias("ttl"),
        *extra,
    )


def unexpired(store: DataFrame, as_of: Column) -> DataFrame:
    """Rows whose time to live has not run out at ``as_of``."""
    return store.where(F.col("ttl") > epoch_seconds(as_of))


def typed_attributes(name: str, column: Column, kind: str) -> Column:
    """One attribute in the typed envelope: ``{"S": text}``, ``{"N": number text}`` or ``{"BOOL": flag}``."""
    value = column if kind == "BOOL" else column.cast("string")
    return F.when(column.isNotNull(), F.struct(value.alias(kind))).alias(name)


ITEM = {
    "matchId": ("match_id", "S"),
    "eventSequence": ("event_sequence", "S"),
    "eventId": ("event_id", "S"),
    "inning": ("inning", "N"),
    "over": ("over_no", "N"),
    "ball": ("ball", "N"),
    "team": ("team", "S"),
    "runs": ("runs", "N"),
    "extras": ("extras", "N"),
    "wicket": ("wicket", "BOOL"),
    "totalRuns": ("total_runs", "N"),
    "wickets": ("wickets", "N"),
    "ttl": ("ttl", "N"),
}


def to_items(store: DataFrame) -> DataFrame:
    """Export form: one typed-attribute struct per stored event."""
    item = F.struct(*[typed_attributes(name, F.col(col), kind) for name, (col, kind) in ITEM.items()])
    return store.select(item.alias("Item"), "event_ts")


def from_items(items: DataFrame) -> DataFrame:
    """Import of exported items back into stored columns."""
    numbers = {"ttl": "long"}
    columns = []
    for name, (col, kind) in ITEM.items():
        value = F.col(f"Item.{name}.{kind}")
        columns.append((value.cast(numbers.get(name, "int")) if kind == "N" else value).alias(col))
    return items.select(*columns)
