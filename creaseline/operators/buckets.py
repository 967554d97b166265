"""A stored table in hash buckets of its key, changed by replacing only the buckets that a change touches.

The buckets of the changed keys (or of the rows that meet a condition) are found first; their list is bounded by the
number of buckets, so the scan is pruned to them and the write replaces their folders alone (dynamic overwrite). New
contents are written in full beside the table before a folder is replaced, so a driver that is lost in between leaves a
redo that ``recover`` puts in place; replacing a folder twice gives the same rows. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from creaseline.operators.writes import update_where
from creaseline.session import materialize, shared_folder
from creaseline.streaming.ledger import existing

BUCKET, EMPTY = "__bucket", "__empty"
BUCKETS = 64
REDO = T.StructType([T.StructField("folder", T.StringType()), T.StructField("done", T.BooleanType())])


class BucketTable:
    """Rows of ``schema`` under ``root``, one or more per ``key``; a key of nulls has a bucket like others."""

    def __init__(self, spark: SparkSession, schema: T.StructType, key: list[str], root: str | None = None, buckets: int = BUCKETS):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.root = (root or shared_folder(spark)).rstrip("/")
        self.columns = schema.fieldNames()
        # a folder whose rows have all gone keeps a row that says so, else it would not be replaced
        self.schema = T.StructType([*schema.fields, T.StructField(EMPTY, T.BooleanType()), T.StructField(BUCKET, T.IntegerType())])

    @classmethod
    def create(cls, df: DataFrame, key: list[str], root: str | None = None, buckets: int = BUCKETS) -> BucketTable:
        """A new table with the rows of ``df``; AQE splits a heavy bucket over several files."""
        table = cls(df.sparkSession, df.schema, key, root, buckets)
        table._write(table._placed(df).hint("rebalance", F.col(BUCKET)), f"{table.root}/data")
        return table

    def bucket(self) -> Column:
        # a hash depends on the type, and keys of changes may come in another one
        return F.pmod(F.hash(*[F.col(k).cast(self.schema[k].dataType) for k in self.key]), F.lit(self.buckets)).cast("int")

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.select(*self.columns, F.lit(None).cast("boolean").alias(EMPTY), self.bucket().alias(BUCKET))

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/data").where(F.col(EMPTY).isNull())

    def read(self) -> DataFrame:
        return self._stored().select(*self.columns)

    def _numbers(self, rows: DataFrame) -> list[int]:
        """Buckets of some rows, at most as many as there are buckets."""
        return sorted(r[0] for r in rows.select(F.col(BUCKET)).distinct().collect())

    def buckets_of(self, keys: DataFrame) -> list[int]:
        return self._numbers(keys.select(self.bucket().alias(BUCKET)))

    def buckets_where(self, condition: Column) -> list[int]:
        """Buckets with a row that meets the condition; reads the condition's columns alone."""
        return self._numbers(self._stored().where(condition))

    def rows_of(self, touched: list[int]) -> DataFrame:
        return self._stored().where(F.col(BUCKET).isin(touched)).select(*self.columns)

    def rewrite(self, touched: list[int], change: Callable[[DataFrame], DataFrame]) -> list[int]:
        """Replace the touched buckets by what ``change`` makes of their rows; returns them. A row whose key moves to a
        bucket that is not touched is refused."""
        if not touched:
            return touched
        rows = self._placed(change(self.rows_of(touched)))
        strays = F.when(~F.col(BUCKET).isin(touched), F.raise_error(F.lit("a changed row belongs to a bucket that is not rewritten")))
        rows = rows.withColumn(BUCKET, F.coalesce(strays.cast("int"), F.col(BUCKET)))
        folder = f"{self.root}/redo/{uuid.uuid4().hex}"
        self._write(rows.hint("rebalance", F.col(BUCKET)), folder)
        staged = self.spark.read.schema(self.schema).parquet(folder)
        left = set(touched) - set(self._numbers(staged))
        if left:
            gone = self.spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields[:-2]], F.lit(True).alias(EMPTY))
            numbers = F.explode(F.array(*[F.lit(b) for b in sorted(left)])).alias(BUCKET)
            gone.select("*", numbers).coalesce(1).write.mode("append").partitionBy(BUCKET).parquet(folder)
        self._note(folder, done=False)
        self._redo(folder)
        return touched

    def _note(self, folder: str, done: bool) -> None:
        self.spark.createDataFrame([(folder, done)], REDO).coalesce(1).write.mode("append").parquet(f"{self.root}/notes")

    def _redo(self, folder: str) -> None:
        self._write(self.spark.read.schema(self.schema).parquet(folder), f"{self.root}/data")
        self._note(folder, done=True)

    def recover(self) -> BucketTable:
        """Put in place what a lost driver had written and noted, but not finished."""
        notes = existing(self.spark, f"{self.root}/notes", REDO)
        if notes is not None:
            for row in notes.groupBy("folder").agg(F.bool_or("done").alias("done")).where("not done").collect():
                self._redo(row.folder)
        return self

    # changes

    def apply_changes(self, changes: DataFrame, order: str, values: list[str]) -> list[int]:
        """Last operation per key wins: c and u upsert, d deletes. ``changes`` has key, order, op and after image."""
        last = changes.groupBy(*self.key).agg(F.max_by(F.struct("op", *values), F.col(order)).alias("_last"))
        return self._replace(last, F.col("_last.op") != "d", {v: F.col(f"_last.{v}") for v in values})

    def upsert(self, rows: DataFrame) -> list[int]:
        """Rows, one per key, in place of those with their key."""
        return self._replace(rows, F.lit(True), {c: F.col(c) for c in self.columns if c not in self.key})

    def _replace(self, new: DataFrame, stays: Column, values: dict[str, Column]) -> list[int]:
        new = materialize(new)  # read for its buckets and for its rows

        def change(rows: DataFrame) -> DataFrame:
            kept = rows.join(new.select(*self.key), self.key, "left_anti")
            return kept.unionByName(new.where(stays).select(*self.key, *[v.alias(c) for c, v in values.items()]))

        return self.rewrite(self.buckets_of(new), change)

    def delete_keys(self, keys: DataFrame) -> list[int]:
        return self.rewrite(self.buckets_of(keys), lambda rows: rows.join(keys.select(*self.key), self.key, "left_anti"))

    def delete_where(self, condition: Column) -> list[int]:
        """Rows for which the condition is not true stay, also where it is null."""
        return self.rewrite(self.buckets_where(condition), lambda rows: rows.where(~F.coalesce(condition, F.lit(False))))

    def update_where(self, condition: Column, values: dict[str, Column]) -> list[int]:
        return self.rewrite(self.buckets_where(condition), lambda rows: update_where(rows, condition, values))

    def update_keys(self, keys: DataFrame, values: dict[str, Column]) -> list[int]:
        hit = F.col("_hit").isNotNull()

        def change(rows: DataFrame) -> DataFrame:
            marked = rows.join(keys.select(*self.key).distinct().withColumn("_hit", F.lit(True)), self.key, "left")
            return update_where(marked, hit, values)

        return self.rewrite(self.buckets_of(keys), change)

    def versioned_update(self, updates: DataFrame, version: str) -> DataFrame:
        """Outcome of each update, ``updates`` being key, expected and value, one per key. Outcome and table come from one
        evaluation: the outcomes are written first and decide what is changed."""
        stored = self.rows_of(self.buckets_of(updates)).select(*self.key, F.col(version).alias("_now"))
        applies = F.coalesce(F.col("expected") == F.col("_now"), F.lit(False))
        judged = updates.join(stored, self.key, "left").withColumn("outcome", F.when(applies, "applied").otherwise("rejected"))
        outcomes = materialize(judged.select(*self.key, "expected", "value", "outcome"))
        winners = outcomes.where("outcome = 'applied'").select(*self.key, F.col("value").alias("_value"))
        hit = F.col("_value").isNotNull()

        def change(rows: DataFrame) -> DataFrame:
            return update_where(rows.join(winners, self.key, "left"), hit, {"value": F.col("_value"), version: F.col(version) + 1})

        self.rewrite(self.buckets_of(winners), change)
        return outcomes
