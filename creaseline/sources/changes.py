"""Change feed over ``orders``: an envelope with operation, before and after images, as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

IMAGE = "struct<o_orderkey: bigint, o_orderstatus: string, o_totalprice: double>"
ENVELOPE = f"struct<op: string, before: {IMAGE}, after: {IMAGE}>"


def order_changes(orders: DataFrame) -> DataFrame:
    """Every order is created; key % 3 = 0 is updated, key % 10 = 0 deleted afterwards."""
    key, status, price = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_totalprice")
    first = F.struct(key, status, price)
    updated = key % 3 == 0
    second = F.struct(key, F.lit("U").alias("o_orderstatus"), (price + 10).alias("o_totalprice"))
    last = F.when(updated, second).otherwise(first)
    gone = F.lit(None).cast(IMAGE)

    def change(op: str, sequence: int, before: Column, after: Column) -> Column:
        body = F.struct(F.lit(op).alias("op"), before.alias("before"), after.alias("after"))
        return F.struct(F.lit(sequence).alias("sequence"), F.to_json(body).alias("value"))

    changes = F.array(
        change("c", 0, gone, first),
        F.when(updated, change("u", 1, first, second)),
        F.when(key % 10 == 0, change("d", 2, last, gone)),
    )
    return orders.select(key.alias("change_key"), F.explode(F.array_compact(changes)).alias("c")).select(
        "change_key", "c.sequence", "c.value"
    )


def read_changes(log: DataFrame) -> DataFrame:
    """Decode the envelope into ``op``, ``before`` and ``after``."""
    body = F.from_json("value", ENVELOPE)
    return log.select("change_key", "sequence", body.alias("b")).select("change_key", "sequence", "b.*")
