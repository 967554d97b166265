"""Copies of a table laid out for comparison: rows in leaves of a key's hash, and digests level by level.

A laid-out copy has

``rows``     all columns and ``__leaf``, in the order of the leaf, so that a filter on leaves skips files and row groups
``digests``  one row per (level, node): the number of rows and a digest that does not depend on their order

Leaves are ``16 ** depth`` in number, whatever the table's size; node ``k`` of a level has the children ``16 k`` to
``16 k + 15`` below it. Two copies are compared from the root down, and only below nodes that differ; rows are read only
from leaves that differ. What reaches the driver is at most one number per leaf.

Digests of a leaf are sums of the halves of two 64-bit hashes of its rows, exact for any number of rows, so repeated rows
count; those of a node are hashes of its children's numbers and digests. Two different copies have equal digests with a
chance of about 2 to the power of -64.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from creaseline.operators.joins import compare_copies
from creaseline.session import materialize, shared_folder

LEAF = "__leaf"
FAN, DEPTH = 16, 3
#: Differing leaves are named to the scan as ranges of neighbours up to this many, beyond it as one span and a semi-join.
RANGES = 200


def row_hash(columns: list[str], seed: int) -> Column:
    """Hash of a row; a null is told from any value and from its neighbour's null."""
    parts = [p for c in columns for p in (F.col(c), F.col(c).isNull())]
    return F.xxhash64(F.lit(seed), *parts)


def _halves(hashed: Column) -> list[Column]:
    # decimals, as a sum of halves passes 64 bits after two thousand million rows
    return [hashed.bitwiseAND(F.lit(0xFFFFFFFF)).cast("decimal(10,0)"), F.shiftrightunsigned(hashed, 32).cast("decimal(10,0)")]


@dataclass(frozen=True)
class LaidOut:
    rows: DataFrame
    digests: DataFrame
    key: tuple[str, ...]
    depth: int

    @property
    def columns(self) -> list[str]:
        return [c for c in self.rows.columns if c != LEAF]


def lay_out(df: DataFrame, key: list[str], depth: int = DEPTH, root: str | None = None) -> LaidOut:
    """Write a copy with its digests. Rows of a heavy key or leaf spread over files by their own hash. Columns are of types
    that hash (no maps); both copies need the same key, depth, column names and types."""
    if LEAF in df.columns:
        raise ValueError(f"a copy may not have a column {LEAF}")
    root = (root or shared_folder(df.sparkSession)).rstrip("/")
    leaf = F.pmod(row_hash(list(key), 7), F.lit(FAN**depth)).cast("int")
    placed = df.withColumn(LEAF, leaf).repartitionByRange(F.col(LEAF), row_hash(df.columns, 1)).sortWithinPartitions(LEAF)
    rows = materialize(placed, f"{root}/rows")
    return LaidOut(rows, materialize(_digests(rows, depth), f"{root}/digests"), tuple(key), depth)


def _digests(rows: DataFrame, depth: int) -> DataFrame:
    columns = sorted(c for c in rows.columns if c != LEAF)  # the order of columns may differ between copies
    one, two = row_hash(columns, 1), row_hash(columns, 2)
    sums = [F.sum(h).alias(f"_s{i}") for i, h in enumerate([*_halves(one), *_halves(two)])]
    leaves = rows.groupBy(F.col(LEAF).alias("node")).agg(F.count(F.lit(1)).alias("n"), *sums)
    digest = F.xxhash64(*[F.col(f"_s{i}").cast("string") for i in range(4)])
    level = materialize(leaves.select(F.lit(depth).alias("level"), "node", "n", digest.alias("digest")))
    out = level
    for number in reversed(range(depth)):
        # a child's number is part of its hash, so that the order of folding does not matter and children cannot swap
        child = F.xxhash64("node", "n", "digest")
        up = (F.col("node") / FAN).cast("int")
        level = level.groupBy(up.alias("parent")).agg(F.sum("n").alias("n"), F.bit_xor(child).alias("digest"))
        level = level.select(F.lit(number).alias("level"), F.col("parent").alias("node"), "n", "digest")
        out = out.unionAll(level)
    return out


def differing(left: LaidOut, right: LaidOut) -> list[list[int]]:
    """Nodes that differ, level by level from the root; below a node that agrees nothing is compared."""
    if (left.key, left.depth, set(left.rows.dtypes)) != (right.key, right.depth, set(right.rows.dtypes)):
        raise ValueError("the copies are laid out differently")
    found: list[list[int]] = []
    for level in range(left.depth + 1):
        both = left.digests.where(F.col("level") == level).unionAll(right.digests.where(F.col("level") == level))
        if found:
            parents = left.digests.sparkSession.createDataFrame([(p,) for p in found[-1]], T.StructType([T.StructField("parent", T.IntegerType())]))
            both = both.join(parents, (F.col("node") / FAN).cast("int") == F.col("parent"), "left_semi")
        pairs = both.groupBy("node").agg(F.count(F.lit(1)).alias("sides"), F.min("digest").alias("low"), F.max("digest").alias("high"), F.min("n").alias("few"), F.max("n").alias("many"))
        differ = (F.col("sides") == 1) | (F.col("low") != F.col("high")) | (F.col("few") != F.col("many"))
        found.append(sorted(r.node for r in pairs.where(differ).select("node").collect()))
        if not found[-1]:
            break
    return found


def _runs(numbers: list[int]) -> list[tuple[int, int]]:
    runs: list[tuple[int, int]] = []
    for x in numbers:
        if runs and x == runs[-1][1] + 1:
            runs[-1] = (runs[-1][0], x)
        else:
            runs.append((x, x))
    return runs


def rows_of(copy: LaidOut, leaves: list[int]) -> DataFrame:
    """Rows of some leaves; the scan is handed their ranges."""
    runs = _runs(leaves)
    if not runs:
        return copy.rows.where(F.lit(False)).drop(LEAF)
    if len(runs) > RANGES:
        wanted = copy.rows.sparkSession.createDataFrame([(x,) for x in leaves], T.StructType([T.StructField(LEAF, T.IntegerType())]))
        span = copy.rows.where(F.col(LEAF).between(leaves[0], leaves[-1]))
        return span.join(wanted, LEAF, "left_semi").drop(LEAF)
    condition = F.lit(False)
    for first, last in runs:
        condition = condition | F.col(LEAF).between(first, last)
    return copy.rows.where(condition).drop(LEAF)


def compare_laid_out(left: LaidOut, right: LaidOut) -> DataFrame:
    """Rows whose number of occurrences differs, with ``n_left`` and ``n_right``, as ``compare_copies`` gives them."""
    levels = differing(left, right)
    leaves = levels[-1] if len(levels) == left.depth + 1 else []
    return compare_copies(rows_of(left, leaves), rows_of(right, leaves))
