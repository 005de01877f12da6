"""Set operators, by position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_all(*sources: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, sources)


def union_distinct(*sources: DataFrame) -> DataFrame:
    return union_all(*sources).distinct()


def intersect(a: DataFrame, b: DataFrame, keep_repeats: bool = False) -> DataFrame:
    return a.intersectAll(b) if keep_repeats else a.intersect(b)


def except_(a: DataFrame, b: DataFrame, keep_repeats: bool = False) -> DataFrame:
    return a.exceptAll(b) if keep_repeats else a.subtract(b)
