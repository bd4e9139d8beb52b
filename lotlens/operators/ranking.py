"""Filters with sort, page and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.operators.windows import first_n


def search(df: DataFrame, equal: dict[str, object] | None = None, at_least: dict[str, float] | None = None, within: dict[str, Sequence] | None = None) -> DataFrame:
    """Optional filters; those that are None are left out."""
    for c, v in (equal or {}).items():
        df = df if v is None else df.filter(F.col(c) == v)
    for c, v in (at_least or {}).items():
        df = df if v is None else df.filter(F.col(c) >= v)
    for c, v in (within or {}).items():
        df = df if v is None else df.filter(F.col(c).isin(*v))
    return df


def page(df: DataFrame, sort: str, allowed: Sequence[str], key: str, descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page in a total order; a sort column that is not allowed is refused."""
    if sort not in allowed:
        raise ValueError(f"can't sort by {sort}")
    order = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_first()
    return df.orderBy(order, key).offset(offset).limit(limit)


def top(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def newest_per_key(df: DataFrame, key: str, date: str, tie: str, n: int) -> DataFrame:
    return first_n(df, [key], [F.col(date).desc_nulls_last(), F.col(tie)], n)


def largest_groups(df: DataFrame, by: str, k: int, least: int = 1) -> DataFrame:
    """The k largest groups of at least so many rows."""
    return df.groupBy(by).agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), by).limit(k)
