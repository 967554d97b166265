"""Large payloads in numbered chunks, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def split_payload(df: DataFrame, key: str, payload: str, size: int) -> DataFrame:
    """One row per chunk of the whole text; an empty text is one empty chunk."""
    count = F.greatest(F.ceil(F.length(payload) / size).cast("int"), F.lit(1))
    numbered = df.select(key, payload, F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk_no"))
    return numbered.select(
        key,
        "chunk_no",
        F.concat(F.col(key).cast("string"), F.lit("#"), F.col("chunk_no").cast("string")).alias("chunk_id"),
        F.substring(F.col(payload), F.col("chunk_no") * size + 1, F.lit(size)).alias("chunk"),
    )


def join_payload(chunks: DataFrame, key: str, payload: str) -> DataFrame:
    """One key is one payload that fitted a row before it was split, so the group is bounded."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_no", "chunk")))
    return chunks.groupBy(key).agg(F.array_join(F.transform(ordered, lambda c: c["chunk"]), "").alias(payload))
