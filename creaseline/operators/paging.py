"""Sorting and paging. Every order ends in a unique column, so pages are reproducible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def offset_page(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page with the totals a page response carries."""
    total = df.agg(F.count(F.lit(1))).scalar()
    pages = F.ceil(total / F.lit(size)).cast("long")
    content = df.orderBy(*order).offset(page * size).limit(size)
    return content.select(
        "*",
        F.lit(page).alias("page"),
        F.lit(size).alias("size"),
        total.alias("total_elements"),
        pages.alias("total_pages"),
        F.lit(page == 0).alias("is_first"),
        (F.lit(page + 1) >= pages).alias("is_last"),
    )


def next_page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """Rows after the cursor, ascending. One row more is fetched to tell whether another page follows."""
    found = df if after is None else df.where(F.col(key) > after)
    return _with_more(found.orderBy(key).limit(size + 1), F.col(key).asc(), size)


def previous_page(df: DataFrame, key: str, before, size: int) -> DataFrame:
    """Rows before the cursor, nearest first."""
    found = df.where(F.col(key) < before)
    return _with_more(found.orderBy(F.desc(key)).limit(size + 1), F.col(key).desc(), size)


def _with_more(fetched: DataFrame, order: Column, size: int) -> DataFrame:
    """``fetched`` holds at most size + 1 rows."""
    count = fetched.agg(F.count(F.lit(1))).scalar()
    return fetched.orderBy(order).limit(size).withColumn("has_more", count > size)


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)
