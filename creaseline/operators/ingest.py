"""Ingest path: request validation, business rules, defaults, responses, pipeline counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from creaseline.functions.scalars import event_sequence
from creaseline.schemas import WIRE

# Column, lowest, highest, message for a value out of range.
RANGES = [
    ("inning", 1, 2, "inning must be 1 or 2", "inning must be 1 or 2"),
    ("over_no", 0, 19, "over must be between 0 and 19", "over must be between 0 and 19"),
    ("ball", 1, 9, "ball must be at least 1", "ball must be at most 9 (including extras)"),
    ("runs", 0, 6, "runs must be >= 0", "runs must be <= 6"),
    ("extras", 0, None, "extras must be >= 0", None),
    ("total_runs", 0, None, "totalRuns must be >= 0", None),
    ("wickets", 0, 10, "wickets must be >= 0", "wickets must be <= 10"),
]
OPTIONAL = {"extras"}
NOT_BLANK = ["match_id", "team"]
REQUIRED = ["wicket"]
WIRE_NAME = {col: wire for wire, col in WIRE.items()}
# Answers to a request.
ACCEPTED = "Score event accepted for publishing"
REFUSED = "Request body validation failed with %d error(s)"


def violation(condition: Column, field: str, message: str, rejected: Column | None = None) -> Column:
    value = F.lit(None).cast("string") if rejected is None else rejected.cast("string")
    return F.when(
        F.coalesce(condition, F.lit(False)),
        F.struct(F.lit(field).alias("field"), F.lit(message).alias("message"), value.alias("rejected_value")),
    )


def _errors() -> list[Column]:
    found = []
    for col in NOT_BLANK:
        blank = ~F.coalesce(F.col(col), F.lit("")).rlike(r"[^\x00-\x20]")
        found.append(violation(blank, WIRE_NAME[col], f"{WIRE_NAME[col]} must not be blank", F.col(col)))
    for col, low, high, too_low, too_high in RANGES:
        name = WIRE_NAME[col]
        if col not in OPTIONAL:
            found.append(violation(F.col(col).isNull(), name, f"{name} must not be null"))
        found.append(violation(F.col(col) < low, name, too_low, F.col(col)))
        if high is not None:
            found.append(violation(F.col(col) > high, name, too_high, F.col(col)))
    for col in REQUIRED:
        found.append(violation(F.col(col).isNull(), WIRE_NAME[col], f"{WIRE_NAME[col]} must not be null"))
    return found


def with_errors(df: DataFrame) -> DataFrame:
    """Add ``errors``: every broken rule of the row, in field order."""
    return df.withColumn("errors", F.array_compact(F.array(*_errors())))


def validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows with ``errors``). Narrow: both sides are filters over one scan."""
    checked = with_errors(df)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def with_rule_errors(df: DataFrame) -> DataFrame:
    """Add ``errors`` of the second rule set, which reads over and ball from the sequence text."""
    parts = F.split("event_sequence", "#")
    over, ball = F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(3))
    over, ball = over.try_cast("int"), ball.try_cast("int")
    rules = [
        violation(~F.col("event_sequence").rlike(r"^\d+#\d+#\d+$"), "eventSequence", "bad format"),
        violation((F.col("runs") < 0) | (F.col("runs") > 6), "runs", "Invalid runs", F.col("runs")),
        violation((over < 0) | (over > 20), "over", "Invalid over", over),
        violation((ball < 1) | (ball > 6), "ball", "Invalid ball", ball),
    ]
    return df.withColumn("errors", F.array_compact(F.array(*rules)))


def with_defaults(df: DataFrame) -> DataFrame:
    """Fill event id and timestamp, only where they are null."""
    now = F.current_timestamp().cast("timestamp_ntz")
    return df.withColumns({"event_id": F.coalesce("event_id", F.uuid()), "ts": F.coalesce("ts", now)})


def from_request(requests: DataFrame) -> DataFrame:
    """Request to event: whatever id and timestamp the caller sent is ignored."""
    cleared = requests.withColumns(
        {"event_id": F.lit(None).cast("string"), "ts": F.lit(None).cast("timestamp_ntz")}
    )
    return with_defaults(cleared).withColumn("event_sequence", event_sequence())


def responses(checked: DataFrame) -> DataFrame:
    """One answer per request, from rows that carry ``errors``."""
    ok = F.size("errors") == 0
    refused = F.format_string(REFUSED, F.size("errors"))
    return checked.select(
        F.when(ok, F.col("event_id")).alias("event_id"),
        "match_id",
        F.when(ok, 202).otherwise(400).alias("status"),
        F.when(ok, ACCEPTED).otherwise(refused).alias("message"),
    )


def counters(feed: DataFrame, poison: Column, dead: Column, key: list[str]) -> DataFrame:
    """Pipeline counters in one pass: received = poison + processed + duplicate + dlt.

    The first aggregate is per ball with map-side combine, so repeated deliveries fold early.
    """
    per_ball = feed.groupBy(*key).agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if(poison).alias("poison"),
        F.count_if(~poison & dead).alias("dlt"),
        F.count_if(~poison & ~dead).alias("usable"),
    )
    return per_ball.agg(
        F.sum("received").alias("received"),
        F.sum("poison").alias("poison"),
        F.count_if(F.col("usable") > 0).alias("processed"),
        F.sum(F.greatest(F.col("usable") - 1, F.lit(0))).alias("duplicate"),
        F.sum("dlt").alias("dlt"),
    )
