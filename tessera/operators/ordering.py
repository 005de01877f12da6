"""Sort, limit and top-n operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key(name: str, ascending: bool = True, nulls_first: bool = True) -> Column:
    """A sort key with its place of nulls said, as engines differ."""
    c = F.col(name)
    if ascending:
        return c.asc_nulls_first() if nulls_first else c.asc_nulls_last()
    return c.desc_nulls_first() if nulls_first else c.desc_nulls_last()


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """Skip ``offset`` rows, then take up to n; a negative n takes all."""
    df = df.offset(offset) if offset else df
    return df if n < 0 else df.limit(n)


def top_n(df: DataFrame, order: Sequence[Column], n: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to n of the order: n counts the skipped rows too.  Planned as a bounded heap a task."""
    return df.orderBy(*order).limit(n).offset(offset) if offset else df.orderBy(*order).limit(n)


def distinct_limit(df: DataFrame, columns: Sequence[str], n: int) -> DataFrame:
    """The first n distinct tuples in their own order, so that the result is defined."""
    return df.select(*columns).distinct().orderBy(*columns).limit(n)
