"""Predicates: optional criteria, an operator vocabulary, quantifiers, guarded views."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

VOCABULARY: dict[str, Callable[..., Column]] = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v,
    "between": lambda c, lo, hi: c.between(lo, hi),
    "like": lambda c, v: c.like(v),
    "ilike": lambda c, v: c.ilike(v),
    "starts_with": lambda c, v: c.startswith(v),
    "ends_with": lambda c, v: c.endswith(v),
    "contains": lambda c, v: c.contains(v),
    "in": lambda c, *v: c.isin(*v),
    "not_in": lambda c, *v: ~c.isin(*v),
    "is_null": lambda c: c.isNull(),
    "is_not_null": lambda c: c.isNotNull(),
    "is_true": lambda c: c == F.lit(True),
    "is_false": lambda c: c == F.lit(False),
    "eq_ignore_case": lambda c, v: F.lower(c) == v.lower(),
}


def predicate(column: str, op: str, *args) -> Column:
    return VOCABULARY[op](F.col(column), *args)


def all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def where_given(df: DataFrame, criteria: list[tuple]) -> DataFrame:
    """Apply (column, op, *args) for the criteria whose arguments are all given."""
    used = [predicate(c, op, *args) for c, op, *args in criteria if all(a is not None for a in args)]
    return df.where(all_of(used))


def time_range(df: DataFrame, column: str, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Inclusive range; a missing end is open."""
    conditions = []
    if start is not None:
        conditions.append(F.col(column) >= start)
    if end is not None:
        conditions.append(F.col(column) <= end)
    return df.where(all_of(conditions))


def quantifiers(df: DataFrame, keys: list[str], condition: Column) -> DataFrame:
    """any / all / none per key, folded map-side. A key with no usable row is any=false, all=true."""
    flags = df.groupBy(*keys).agg(F.bool_or(condition).alias("_any"), F.bool_and(condition).alias("_all"))
    return flags.select(
        *keys,
        F.coalesce("_any", F.lit(False)).alias("any_match"),
        F.coalesce("_all", F.lit(True)).alias("all_match"),
        (~F.coalesce("_any", F.lit(False))).alias("none_match"),
    )


def tenant_view(df: DataFrame, column: str, tenant) -> DataFrame:
    """The only way a tenant reads a shared table: its own rows."""
    return df.where(F.col(column) == tenant)


def visible(df: DataFrame, include_deleted: bool = False) -> DataFrame:
    """Soft-deleted rows are hidden unless asked for."""
    return df if include_deleted else df.where(~F.col("deleted"))
