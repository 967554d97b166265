"""Live view: one row per match, set from the ball that arrived last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from creaseline.functions.scalars import score_line
from creaseline.operators.hotkeys import SLOT, previous
from creaseline.schemas import LOG_ORDER

VIEW_COLUMNS = {
    "total_runs": "total_runs",
    "wickets": "wickets",
    "current_inning": "inning",
    "current_over": "over_no",
    "current_ball": "ball",
    "last_ball_runs": "runs",
    "is_wicket": "wicket",
    "last_updated": "ts",
}
OVERS_PER_INNING, ALL_OUT = 20, 10


def live_rows(accepted: DataFrame) -> DataFrame:
    """View columns of each ball, in arrival form (no fold)."""
    return accepted.select("*", *[F.col(src).alias(f"v_{dst}") for dst, src in VIEW_COLUMNS.items()])


def live_view(accepted: DataFrame, order: Sequence[str] = LOG_ORDER) -> DataFrame:
    """Values of the last arrival per match; a late ball moves the view back, by design.

    ``max_by`` is folded in every map task, so a match of any size sends one row per task.
    """
    row = F.struct(*[F.col(src).alias(dst) for dst, src in VIEW_COLUMNS.items()])
    last = accepted.groupBy("match_id").agg(F.max_by(row, F.struct(*order)).alias("r"))
    return last.select("match_id", "r.*")


def live_view_by_sequence(accepted: DataFrame) -> DataFrame:
    """The view an observer would expect: the furthest ball of the match."""
    return live_view(accepted, ["inning", "over_no", "ball"])


def upsert_view(view: DataFrame, updates: DataFrame) -> DataFrame:
    """Unconditional SET: rows of ``updates`` replace rows of ``view`` with the same match."""
    kept = view.join(updates.select("match_id"), "match_id", "left_anti")
    return kept.unionByName(updates)


def is_finished() -> Column:
    """Second inning over by overs or wickets, from the columns of the live view."""
    done = (F.col("current_over") >= OVERS_PER_INNING) | (F.col("wickets") >= ALL_OUT)
    return (F.col("current_inning") == 2) & done


def active_matches(view: DataFrame) -> DataFrame:
    return view.where(~is_finished())


def score_lines(view: DataFrame) -> DataFrame:
    team = F.when(F.col("current_inning") == 1, "A").otherwise("B")
    line = score_line(team, F.col("total_runs"), F.col("wickets"), F.col("current_over"), F.col("current_ball"))
    return view.select("match_id", line.alias("score_line"))


def view_history(tagged: DataFrame, order: list[str]) -> DataFrame:
    """The view after each accepted ball, flagged where it moved backwards.

    ``tagged`` comes from ``hotkeys.spread``.
    """
    place = F.struct("inning", "over_no", "ball")
    stepped = previous(tagged.withColumn("_place", place), ["match_id"], order, {"_before": "_place"})
    regressed = F.coalesce(F.col("_place") < F.col("_before"), F.lit(False))
    return stepped.withColumn("regressed", regressed).drop("_place", "_before", SLOT)


def reconcile(view: DataFrame, accepted: DataFrame, include_extras: bool = False) -> DataFrame:
    """Compare carried totals with the sum over the stored balls of the same inning."""
    runs = F.col("runs") + (F.coalesce("extras", F.lit(0)) if include_extras else F.lit(0))
    per_inning = accepted.groupBy("match_id", "inning").agg(
        F.sum(runs).alias("runs"), F.count_if("wicket").alias("wickets"), F.count(F.lit(1)).alias("balls")
    )
    # the store is folded once; a match has a handful of innings
    stored = per_inning.groupBy("match_id").agg(
        F.sum("balls").alias("n_balls"), F.map_from_entries(F.collect_list(F.struct("inning", F.struct("runs", F.col("wickets").alias("w"))))).alias("_innings")
    )
    both = view.select("match_id", "current_inning", "total_runs", "wickets").join(stored, "match_id", "full_outer")
    current = F.try_element_at("_innings", F.col("current_inning"))
    both = both.withColumns({"event_total": current["runs"], "event_wickets": current["w"]})
    status = (
        F.when(F.col("total_runs").isNull(), "missing_view")
        .when(F.col("n_balls").isNull(), "missing_events")
        .when(~F.col("total_runs").eqNullSafe(F.col("event_total")), "total_mismatch")
        .otherwise("ok")
    )
    return both.select(
        "match_id", "total_runs", "event_total", "wickets", "event_wickets", "n_balls", status.alias("status")
    )
