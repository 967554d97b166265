"""Stored sketches per period: distinct counts and quantiles of any span of periods without a scan of the rows.

A row of the table stands for one (period, keys): the exact number of rows, a distinct-count sketch for each column of
``distinct`` and a quantile sketch for each whole number of ``quantiles``. A sketch is a few kilobytes whatever it has
seen, folds map-side, and merges with others, so new rows are folded by themselves and a span is a merge of its periods.

A refresh rewrites only the buckets of the periods it touches. Batches carry numbers that rise: a batch that runs again,
in part or whole, finds its number in the rows it reached and adds nothing to them. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from creaseline.operators.buckets import BUCKETS, BucketTable
from creaseline.session import materialize

#: Counters of a distinct sketch (2 ** LG_K) and size of a quantile sketch. ``distinct_close`` allows four standard errors of
#: the one, ``rank_close`` about twice the rank error that the other keeps with 99 per cent confidence.
LG_K, K = 12, 800
DISTINCT_ERROR, RANK_ERROR = 4 * 1.04 / 2 ** (LG_K / 2), 0.007


class SketchTable:
    """``period`` and ``keys`` name columns of the rows that are handed to ``refresh``; so do ``distinct`` and
    ``quantiles``. Rows without a period have a row of their own, which no span includes."""

    def __init__(
        self, spark: SparkSession, rows: T.StructType, period: str, keys: list[str], distinct: list[str], quantiles: list[str],
        root: str | None = None, buckets: int = BUCKETS,
    ):
        self.period, self.keys, self.distinct, self.quantiles = period, keys, distinct, quantiles
        sketches = [T.StructField(self._name(c), T.BinaryType()) for c in [*self.distinct, *self.quantiles]]
        fixed = [T.StructField("n", T.LongType()), *sketches, T.StructField("batch", T.LongType())]
        schema = T.StructType([rows[period], *[rows[k] for k in self.keys], *fixed])
        self.stored = BucketTable.create(spark.createDataFrame([], schema), [period], root, buckets)

    def _name(self, column: str) -> str:
        return f"{column}_distinct" if column in self.distinct else f"{column}_quantiles"

    def _fold(self, rows: DataFrame, batch: int) -> DataFrame:
        seen = [F.hll_sketch_agg(c, LG_K).alias(self._name(c)) for c in self.distinct]
        spread = [F.kll_sketch_agg_bigint(F.col(c).cast("long"), K).alias(self._name(c)) for c in self.quantiles]
        folded = rows.groupBy(self.period, *self.keys).agg(F.count(F.lit(1)).alias("n"), *seen, *spread)
        return folded.withColumn("batch", F.lit(batch).cast("long"))

    def _merged(self, rows: DataFrame, by: list[str], *more: Column) -> DataFrame:
        seen = [F.hll_union_agg(self._name(c)).alias(self._name(c)) for c in self.distinct]
        spread = [F.kll_merge_agg_bigint(self._name(c), K).alias(self._name(c)) for c in self.quantiles]
        return rows.groupBy(*by).agg(F.sum("n").alias("n"), *seen, *spread, *more)

    def refresh(self, rows: DataFrame, batch: int) -> list[int]:
        """Fold new rows in; returns the rewritten buckets. ``batch`` is above that of every earlier call, or equal to the
        last one if that failed."""
        new = materialize(self._fold(rows, batch))  # read for its buckets and for its rows
        group = [self.period, *self.keys]

        def change(stored: DataFrame) -> DataFrame:
            done = stored.where(F.col("batch") >= batch)
            reached = [new[c].eqNullSafe(done[c]) for c in group]
            both = stored.unionByName(new.join(done, reached, "left_anti"))
            return self._merged(both, group, F.max("batch").alias("batch"))

        return self.stored.rewrite(self.stored.buckets_of(new), change)

    def recover(self) -> SketchTable:
        """Finish what a lost driver had written, before the batch is run again."""
        self.stored.recover()
        return self

    def rollup(self, first: Column | None = None, last: Column | None = None, by: list[str] | None = None) -> DataFrame:
        """The periods from ``first`` to ``last``, both included, merged per ``by`` (default: the keys): ``n``, the sketches,
        and no scan of rows. Without rows in the span there is one row of no count if ``by`` is empty, else none."""
        period = F.col(self.period)
        spans = [period.isNotNull(), *([period >= first] if first is not None else []), *([period <= last] if last is not None else [])]
        rows = self.stored.read()
        for span in spans:
            rows = rows.where(span)
        return self._merged(rows, self.keys if by is None else by)


def distinct_count(column: str) -> Column:
    """Estimate from a roll-up; null where there is no sketch."""
    return F.hll_sketch_estimate(f"{column}_distinct")


def quantile(column: str, point: float) -> Column:
    """Value at a share of the rows; null where the sketch holds no value."""
    sketch = F.col(f"{column}_quantiles")
    return F.when(F.kll_sketch_get_n_bigint(sketch) > 0, F.kll_sketch_get_quantile_bigint(sketch, F.lit(point)))


def distinct_close(estimate: Column, exact: Column) -> Column:
    """Whether an estimate keeps its promise, one more or less for small sets."""
    return F.abs(estimate - exact) <= exact * DISTINCT_ERROR + 1


def rank_close(below: Column, up_to: Column, n: Column, point: float) -> Column:
    """Whether a quantile keeps its promise, given how many of ``n`` rows lie below and up to it."""
    slack = n * RANK_ERROR + 1
    return (below <= n * point + slack) & (up_to >= n * point - slack)
