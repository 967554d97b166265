"""Retry tiers: classification, delays, outcome per attempt, dead letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MAX_ATTEMPTS = 4
FIRST_DELAY_MS, MULTIPLIER, MAX_DELAY_MS = 1000, 5, 15000
# Error classes that are never retried.
NOT_RETRIED = [
    "com.fasterxml.jackson.core.JsonProcessingException",
    "jakarta.validation.ConstraintViolationException",
]


def route(error_class: Column) -> Column:
    return F.when(error_class.isNull(), "ok").when(error_class.isin(NOT_RETRIED), "dlt").otherwise("retry")


def delay_ms(retry_number: Column) -> Column:
    """Pause before retry 1, 2, 3: 1 s, 5 s, 15 s (25 s capped)."""
    return F.least(F.lit(FIRST_DELAY_MS) * F.pow(F.lit(MULTIPLIER), retry_number - 1), F.lit(MAX_DELAY_MS)).cast("int")


def attempts(df: DataFrame, failures: Column, error_class: Column, arrival: str = "arrival") -> DataFrame:
    """One row per attempt with its due time and outcome (``ok``, ``retry`` or ``dlt``).

    ``failures`` is how many attempts of the row fail. At most four rows per input row, in place.
    """
    final = F.col("_class").isin(NOT_RETRIED)
    tries = F.when(final & (F.col("_failures") > 0), 1).otherwise(F.least(F.col("_failures") + 1, F.lit(MAX_ATTEMPTS)))
    spread = (
        df.withColumns({"_failures": failures, "_class": error_class})
        .withColumn("attempt", F.explode(F.sequence(F.lit(1), tries)))
    )
    waited = F.expr(
        f"aggregate(sequence(1, 4), 0, (s, n) -> s + IF(n < attempt, "
        f"CAST(least({FIRST_DELAY_MS} * power({MULTIPLIER}, n - 1), {MAX_DELAY_MS}) AS INT), 0))"
    )
    failed = F.col("attempt") <= F.col("_failures")
    outcome = (
        F.when(~failed, "ok").when(final | (F.col("attempt") == MAX_ATTEMPTS), "dlt").otherwise("retry")
    )
    due = F.col(arrival) + F.make_dt_interval(secs=(F.col("_waited") / 1000).cast("decimal(18,6)"))
    return (
        spread.withColumn("_waited", waited)
        .withColumns({"due_at": due, "status": outcome, "error_class": F.when(failed, F.col("_class"))})
        .drop("_failures", "_class", "_waited")
    )


def settled(attempt_rows: DataFrame) -> DataFrame:
    """Successful deliveries, placed at the time of the attempt that succeeded."""
    return attempt_rows.where("status = 'ok'").withColumn("effective_arrival", F.col("due_at"))


def exhausted(attempt_rows: DataFrame) -> DataFrame:
    return attempt_rows.where("status = 'dlt'")
