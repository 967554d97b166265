"""Ordered analytics per key: running totals, rankings, histories, rate checks, alarms."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window as W

from creaseline.operators.hotkeys import SLOT, previous, running, spread


def running_score(store: DataFrame, include_extras: bool = False) -> DataFrame:
    """Running runs and wickets of each inning, in playing order."""
    runs = F.col("runs") + (F.coalesce("extras", F.lit(0)) if include_extras else F.lit(0))
    tagged = spread(store, ["match_id", "inning"], ["over_no", "ball"])
    sums = {"running_total": runs, "running_wickets": F.col("wicket").cast("int")}
    return running(tagged, ["match_id", "inning"], ["over_no", "ball"], sums).drop(SLOT)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """First ``n`` rows per key. Catalyst cuts every map task to ``n`` rows per key before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def with_previous(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    return previous(spread(df, keys, order), keys, order, values).drop(SLOT)


def latest(df: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """Last row per key, folded map-side."""
    row = F.max_by(F.struct(*columns), order).alias("r")
    return df.groupBy(*keys).agg(row).select(*keys, "r.*")


def state_at(revisions: DataFrame, key: str, revision: str, at: int, columns: list[str]) -> DataFrame:
    """State of every entity as of a revision."""
    return latest(revisions.where(F.col(revision) <= at), [key], F.col(revision), [revision, *columns])


def fixed_window_check(df: DataFrame, client: str, ts: str, tie: str, seconds: int, limit: int) -> DataFrame:
    """n-th request of a client within its fixed window: allowed while n <= limit."""
    framed = df.withColumn("window_no", F.expr(f"unix_seconds(CAST({ts} AS TIMESTAMP)) div {seconds}"))
    tagged = spread(framed, [client, "window_no"], [ts, tie])
    ranked = running(tagged, [client, "window_no"], [ts, tie], {"n": F.lit(1)}).drop(SLOT)
    return ranked.withColumns(
        {"allowed": F.col("n") <= limit, "remaining": F.greatest(F.lit(limit) - F.col("n"), F.lit(0))}
    )


def sessions(df: DataFrame, client: str, ms: str, gap_ms: int) -> DataFrame:
    """Number the activity bursts of a client: a pause of ``gap_ms`` starts a new one."""
    tagged = spread(df, [client], [ms])
    gaps = previous(tagged, [client], [ms], {"_before": ms})
    starts = F.coalesce(F.col(ms) - F.col("_before") >= gap_ms, F.lit(True)).cast("int")
    numbered = running(gaps.withColumn("_start", starts), [client], [ms], {"session": F.col("_start")})
    return numbered.drop("_before", "_start", SLOT)


def _per_millisecond(df: DataFrame, client: str, ts: str) -> DataFrame:
    """Requests of one client in one millisecond are interchangeable, so they fold to a count."""
    ms = F.unix_millis(F.col(ts).cast("timestamp")).alias("ms")
    return df.groupBy(F.col(client).alias("client"), ms).agg(F.count(F.lit(1)).alias("requests"))


RATE_SCHEMA = "client string, session long, ms long, requests long, allowed long"


def _fold(df: DataFrame, step) -> DataFrame:
    """Run ``step(state, ms, requests) -> (state, allowed)`` along each session.

    Rows stream through in sorted Arrow batches and only the state of the current session is kept,
    so memory does not depend on the length of a session.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            allowed = []
            for key_client, key_session, ms, requests in zip(pdf.client, pdf.session, pdf.ms, pdf.requests):
                if (key_client, key_session) != current:
                    current, state = (key_client, key_session), None
                state, granted = step(state, int(ms), int(requests))
                allowed.append(granted)
            yield pdf.assign(allowed=allowed)[["client", "session", "ms", "requests", "allowed"]]

    keyed = df.select(F.col("client").cast("string").alias("client"), "session", "ms", "requests")
    ordered = keyed.repartition("client", "session").sortWithinPartitions("client", "session", "ms")
    return ordered.mapInPandas(fold, RATE_SCHEMA).withColumn("rejected", F.col("requests") - F.col("allowed"))


def sliding_log_check(df: DataFrame, client: str, ts: str, window_ms: int = 60_000, limit: int = 100) -> DataFrame:
    """Sliding log: a request passes if fewer than ``limit`` passed in the window before it.

    Rejected requests do not count, so the decision feeds back. After a pause of a whole window
    nothing is left of the past, which cuts a client into independent sessions.
    """

    def step(state, ms, requests):
        log, passed = state or (deque(), 0)
        while log and log[0][0] <= ms - window_ms:
            passed -= log.popleft()[1]
        granted = max(0, min(requests, limit - passed))
        if granted:
            log.append((ms, granted))
        return (log, passed + granted), granted

    return _fold(sessions(_per_millisecond(df, client, ts), "client", "ms", window_ms), step)


def token_bucket_check(
    df: DataFrame, client: str, ts: str, capacity: int = 100, rate: int = 10, period_ms: int = 1000
) -> DataFrame:
    """Token bucket refilled in whole periods since the last request that passed.

    A pause long enough to fill the bucket starts an independent session.
    """

    def step(bucket, ms, requests):
        tokens, refilled = bucket or (capacity, ms)
        available = min(capacity, tokens + (ms - refilled) // period_ms * rate)
        granted = min(requests, available)
        return ((available - granted, ms) if granted else (tokens, refilled)), granted

    full_ms = -(-capacity // rate) * period_ms
    return _fold(sessions(_per_millisecond(df, client, ts), "client", "ms", full_ms), step)


def consecutive_breaches(series: DataFrame, keys: list[str], step: str, breach: Column, k: int) -> DataFrame:
    """Alarm where the last ``k`` steps exist without a gap and all breach.

    ``series`` holds one row per key and step number, so a key is as long as the time covered.
    """
    order = W.partitionBy(*keys).orderBy(step)
    last = order.rowsBetween(-(k - 1), 0)
    flagged = series.withColumn("breach", breach)
    complete = F.col(step) - F.lag(step, k - 1).over(order) == k - 1
    alarm = F.coalesce(complete, F.lit(k == 1)) & (F.min(F.col("breach").cast("int")).over(last) == 1)
    return flagged.withColumn("alarm", alarm)
