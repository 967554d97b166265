"""Replay: re-publish stored balls in playing order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from creaseline.operators.hotkeys import SLOT, running, spread
from creaseline.sources.log import to_log

PLAYING_ORDER = ["inning", "over_no", "ball"]


def playing_order(store: DataFrame) -> DataFrame:
    return store.orderBy("match_id", *PLAYING_ORDER)


def replay_log(store: DataFrame, topic: str = "ball-events-replay") -> DataFrame:
    """Log records of the stored balls; ``offset`` is the playing position within the match."""
    tagged = spread(store, ["match_id"], PLAYING_ORDER)
    ranked = running(tagged, ["match_id"], PLAYING_ORDER, {"offset": F.lit(1)}).drop(SLOT)
    rows = ranked.withColumn("offset", F.col("offset") - 1)
    return to_log(rows, F.lit(None).cast("string"), topic)
