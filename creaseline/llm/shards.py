"""Random shards by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters the records uniformly into buckets of bounded size by a seeded hash. Pass two permutes each
bucket in memory (``shuffle`` is Spark's Fisher-Yates) and writes it. A record's place in the whole permutation is
its bucket's offset plus its place in the bucket; shards are equal cuts of that permutation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

OVERHEAD = 16  # bytes a record counts beside its text


def size_of_text() -> F.Column:
    return F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long") + OVERHEAD


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 42, bucket_bytes: int = 32 << 20) -> DataFrame:
    """Write ``docs`` as ``path/shard=N/`` and return the written table: every column of ``docs`` in ``record``,
    with ``size``, ``shard`` and ``slot`` (the place in the shard, from 0 without gaps).

    Shards differ by one record at most, whatever the texts' lengths, sources or copies. A null text weighs only
    the overhead; an empty table gives an empty table. Rows that are equal in doc_id and text meet in one bucket;
    all others spread by the hash. Column names of ``docs`` cannot clash, as they stay inside ``record``.
    """
    spark = docs.sparkSession
    record = F.struct(*[docs[f"`{c.replace('`', '``')}`"] for c in docs.columns])
    keyed = docs.select(
        F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"]).alias("h"), size_of_text().alias("size"), record.alias("record")
    )
    rows, total = keyed.agg(F.count("*"), F.sum("size")).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    scattered = keyed.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "h"), F.lit(buckets)))
    # one short row for each bucket
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        scattered.groupBy("bucket")
        .count()
        .select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    )
    in_order = F.array_sort("entries", lambda a, b: F.when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0))
    permuted = (
        scattered.repartition(buckets, "bucket")  # so a task holds a few buckets, however large the table
        .groupBy("bucket")
        .agg(F.collect_list(F.struct("h", "size", "record")).alias("entries"))
        .join(offsets, "bucket")
        .select("offset", F.posexplode(F.shuffle(in_order, seed)).alias("place", "entry"))
    )
    count = F.lit(rows)
    placed = permuted.select(
        (F.col("offset") + F.col("place")).alias("position"), F.col("entry.size").alias("size"), F.col("entry.record").alias("record")
    ).withColumn("shard", F.expr(f"cast(position * {shards} div {max(1, rows)} as int)"))
    numbered = placed.select(
        "record", "size", (F.col("position") - F.ceil(F.col("shard") * count / shards)).cast("long").alias("slot"), "shard"
    )
    numbered.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
    return spark.read.schema(numbered.schema).parquet(path)
