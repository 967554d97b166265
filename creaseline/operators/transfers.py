"""Guarded transfers: debit if the balance covers the amount, credit the other account, both or neither."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from creaseline.operators.hotkeys import running, spread
from creaseline.session import materialize

OPENING = -1


def guarded_transfers(accounts: DataFrame, transfers: DataFrame) -> DataFrame:
    """Outcome of every transfer as if they ran one after the other.

    ``accounts``: account, balance. ``transfers``: seq (unique, from 0), src, dst, amount; src and
    dst differ. All amounts are integers.

    Whether a transfer passes depends on earlier ones, so it is decided by bounds: its balance is at
    least what is left if every open debit before it passes and no open credit does, and at most the
    opposite. Each round computes both bounds with running sums; a transfer whose bounds agree is
    settled. The earliest open transfer always has exact bounds, so every round settles some, and in
    practice nearly all. What is settled is folded into the known balance in front of each open
    transfer, on both of its accounts; a round works on what the one before left open or has just let
    pass, and only on accounts that still have an open debit. Rounds are cut by a table in the shared
    folder, and the outcome is all of these tables together.
    """
    opening = accounts.select(
        "account", F.lit(OPENING).cast("long").alias("seq"), F.col("balance").alias("low"), F.col("balance").alias("high")
    )
    numbered = transfers.select("seq", "src", "dst", "amount").withColumn("id", F.monotonically_increasing_id())
    blank = {"src_known": F.lit(0).cast("long"), "dst_known": F.lit(0).cast("long"), "passed": F.lit(None).cast("boolean")}
    state = materialize(numbered.withColumns(blank))
    if state.isEmpty():
        return state.select("seq", "src", "dst", "amount", "passed")
    state = materialize(_settle(_legs(state).unionByName(opening, allowMissingColumns=True)))
    settled = []
    while True:
        settled.append(state.where("passed IS NOT NULL"))
        still = state.where("passed IS NULL")
        if still.isEmpty():
            break
        # a credit counts only where a debit is open, and what failed nowhere
        paying = still.select(F.col("src").alias("_paying")).distinct()
        legs = _legs(state.where("passed IS NULL OR passed")).join(paying, F.col("account").eqNullSafe(F.col("_paying")), "left_semi")
        state = materialize(_settle(legs))
    return reduce(DataFrame.unionByName, settled).select("seq", "src", "dst", "amount", "passed")


def _legs(state: DataFrame) -> DataFrame:
    """Both sides of each transfer; ``low`` and ``high`` are the least and most that it may bring to the account."""
    amount, passed = F.col("amount"), F.col("passed")
    certain = F.coalesce(passed, F.lit(False))
    possible = F.coalesce(passed, F.lit(True))
    debit = F.struct(
        F.col("src").alias("account"),
        F.lit(True).alias("debit"),
        F.col("src_known").alias("known"),
        F.when(possible, -amount).otherwise(0).alias("low"),
        F.when(certain, -amount).otherwise(0).alias("high"),
        F.col("dst").alias("other"),
    )
    credit = F.struct(
        F.col("dst").alias("account"),
        F.lit(False).alias("debit"),
        F.col("dst_known").alias("known"),
        F.when(certain, amount).otherwise(0).alias("low"),
        F.when(possible, amount).otherwise(0).alias("high"),
        F.lit(None).cast(state.schema["dst"].dataType).alias("other"),
    )
    return state.select("seq", "id", "amount", "passed", F.explode(F.array(debit, credit)).alias("l")).select("l.*", "seq", "id", "amount", "passed")


def _settle(legs: DataFrame) -> DataFrame:
    """The transfers that were open, each with its verdict if there is one and what is known in front of its two sides."""
    amount = F.col("amount")
    low, high = F.col("low"), F.col("high")
    # what is settled brings the same in both cases
    sums = {"_low": low, "_high": high, "_sure": F.when(F.col("passed") | amount.isNull(), low).otherwise(0)}
    order = ["seq", "id"]
    summed = running(spread(legs, ["account"], order), ["account"], order, sums).where(F.col("passed").isNull() & amount.isNotNull())
    known = F.col("known")
    least, most = known + F.col("_low") - low, known + F.col("_high") - high
    verdict = F.when(F.col("debit"), F.when(least >= amount, True).when(most < amount, False))
    sides = summed.select("id", "seq", "account", "other", "amount", "debit", (known + F.col("_sure")).alias("known"), verdict.alias("passed"))
    side = F.struct("seq", F.col("account").alias("src"), F.col("other").alias("dst"), "amount", F.col("known").alias("src_known"), "passed")
    paired = sides.groupBy("id").agg(
        F.first(F.when(F.col("debit"), side), ignorenulls=True).alias("d"), F.max(F.when(~F.col("debit"), known)).alias("dst_known")
    )
    return paired.select("id", "d.*", "dst_known")
