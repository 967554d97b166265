"""Table writes without MERGE: every change is a declarative rewrite of the kept and new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from creaseline.operators.hotkeys import SLOT, running, spread

ACTIVE = ["STARTED", "IN_PROGRESS"]


def delete_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return df.join(keys.select(*on), on, "left_anti")


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true stay, also where it is null."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def update_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def update_keys(df: DataFrame, keys: DataFrame, on: str, values: dict[str, Column]) -> DataFrame:
    """Bulk update for a key list of any size."""
    marked = df.join(keys.select(on).distinct().withColumn("_hit", F.lit(True)), on, "left")
    return update_where(marked, F.col("_hit"), values).drop("_hit")


def versioned_update(df: DataFrame, updates: DataFrame, key: str, version: str) -> tuple[DataFrame, DataFrame]:
    """(new table, outcomes). An update applies only if it names the stored version.

    ``updates`` holds one row per key: key, expected, value.
    """
    both = updates.join(df.select(key, F.col(version).alias("_now")), key, "left")
    applies = F.coalesce(F.col("expected") == F.col("_now"), F.lit(False))
    outcomes = both.select(key, "expected", "value", F.when(applies, "applied").otherwise("rejected").alias("outcome"))
    winners = outcomes.where("outcome = 'applied'").select(key, F.col("value").alias("_value"), F.lit(True).alias("_hit"))
    table = df.join(winners, key, "left")
    table = table.withColumns(
        {
            "value": F.when(F.col("_hit"), F.col("_value")).otherwise(F.col("value")),
            version: F.when(F.col("_hit"), F.col(version) + 1).otherwise(F.col(version)),
        }
    )
    return table.drop("_hit", "_value"), outcomes


def start_replays(requests: DataFrame, state: DataFrame, totals: DataFrame) -> DataFrame:
    """Replay requests: 202 for the first of a match without an active replay, 409 otherwise.

    ``requests``: match_id, request_id. ``state``: match_id, status. ``totals``: match_id, total.
    """
    active = state.where(F.col("status").isin(ACTIVE)).select("match_id", F.lit(True).alias("_active"))
    first = requests.groupBy("match_id").agg(F.min("request_id").alias("_first"))
    open_for = first.join(active, "match_id", "left").join(totals, "match_id", "left")
    judged = requests.join(open_for, "match_id", "left")
    granted = F.col("_active").isNull() & (F.col("request_id") == F.col("_first"))
    return judged.select(
        "match_id",
        "request_id",
        F.when(granted, 202).otherwise(409).alias("http_status"),
        F.when(granted, F.lit("STARTED")).alias("status"),
        F.when(granted, F.lit(0)).alias("processed"),
        F.when(granted, F.coalesce("total", F.lit(0))).cast("int").alias("total"),
    )


def replay_progress(granted: DataFrame, balls: DataFrame, path: str) -> DataFrame:
    """State of each replay as it moves on, one folder per status below ``path``; returns the whole history.

    ``granted``: match_id, total. ``balls``: match_id, place (from 1 in playing order), fails. A replay is
    STARTED with nothing processed, IN_PROGRESS once its first ball is through, and ends COMPLETED with all
    of them or FAILED before the first ball that cannot be published.
    """
    first_bad = F.min(F.when(F.col("fails"), F.col("place")))
    reached = granted.join(balls.groupBy("match_id").agg(first_bad.alias("_bad"), F.max("place").alias("_last")), "match_id", "left")
    through = F.coalesce(F.col("_bad") - 1, F.col("_last"), F.lit(0)).cast("int")
    states = {
        "STARTED": (F.lit(True), F.lit(0)),
        "IN_PROGRESS": (through > 0, F.lit(1)),
        "COMPLETED": (F.col("_bad").isNull(), through),
        "FAILED": (F.col("_bad").isNotNull(), through),
    }
    for status, (holds, processed) in states.items():
        rows = reached.where(holds).select("match_id", F.lit(status).alias("status"), processed.alias("processed"), "total")
        rows.write.mode("overwrite").parquet(f"{path}/state={status}")
    return granted.sparkSession.read.parquet(path).drop("state")


def write_layout(df: DataFrame, path: str, by: list[str], fmt: str = "parquet") -> None:
    """Partitioned write. The rebalance hint gathers each partition into few files and, with AQE,
    splits the ones that are too large, so one heavy partition value never lands in one task."""
    df.hint("rebalance", *[F.col(c) for c in by]).write.mode("overwrite").partitionBy(*by).format(fmt).save(path)


def apply_changes(df: DataFrame, changes: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """Change feed onto a table: last operation per key wins; c and u upsert, d deletes.

    ``changes``: key, order, op and the value columns of the after image. ``max_by`` folds map-side.
    """
    last = changes.groupBy(key).agg(F.max_by(F.struct("op", *values), F.col(order)).alias("_last"))
    kept = df.join(last.select(key), key, "left_anti").select(key, *values)
    upserts = last.where("_last.op <> 'd'").select(key, *[F.col(f"_last.{v}").alias(v) for v in values])
    return kept.unionByName(upserts)


def number_rows(df: DataFrame, keys: list[str], order: list[str], start: DataFrame | None = None, name: str = "seq") -> DataFrame:
    """Give each row the next number of its key: ``max + 1`` onwards, from 1 where nothing is stored."""
    ranked = running(spread(df, keys, order), keys, order, {name: F.lit(1)}).drop(SLOT)
    if start is None:
        return ranked
    return ranked.join(start, keys, "left").withColumn(name, F.col(name) + F.coalesce("last_seq", F.lit(0))).drop("last_seq")
