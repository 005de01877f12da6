"""Join operators: equi joins of every type with an optional residual condition, theta joins, existence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ("inner", "left", "right", "full", "left_semi", "left_anti")
HINTS = {"hash": "shuffle_hash", "merge": "merge", "broadcast": "broadcast"}


def equi_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], how: str = "inner", residual: Column | None = None, strategy: str | None = None, build: str = "right") -> DataFrame:
    """Join on pairs of key columns.

    ``residual`` is part of the join condition, so in outer joins rows that fail it
    are unmatched rather than dropped.  ``strategy`` hints at hash, merge or broadcast
    with the given side built; without it the optimizer chooses by size."""
    if how not in TYPES:
        raise ValueError(f"unknown join type {how}")
    if strategy:
        left, right = (left, right.hint(HINTS[strategy])) if build == "right" else (left.hint(HINTS[strategy]), right)
    condition = F.lit(True)
    for a, b in keys:
        condition = condition & (left[a] == right[b])
    return left.join(right, condition if residual is None else condition & residual, how)


def theta_join(left: DataFrame, right: DataFrame, condition: Column | None, how: str = "inner") -> DataFrame:
    """Join on any condition; without one, the cross product of two small sides."""
    return left.crossJoin(right) if condition is None else left.join(right, condition, how)


def existence_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], name: str = "exists") -> DataFrame:
    """All rows of left and whether right has a match.

    The right side is reduced to its distinct keys first, so no row of left is
    repeated and only keys are shuffled."""
    marks = right.select(*(F.col(b).alias(f"_{b}") for _, b in keys)).distinct().withColumn("_there", F.lit(True))
    condition = F.lit(True)
    for a, b in keys:
        condition = condition & (left[a] == marks[f"_{b}"])
    return left.join(marks, condition, "left").select(*(left[c] for c in left.columns), F.coalesce("_there", F.lit(False)).alias(name))


def semi_join(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], anti: bool = False) -> DataFrame:
    """Rows of left with a match (without one, if anti); only the right side's distinct keys are shuffled."""
    return equi_join(left, right.select(*(b for _, b in keys)).distinct(), keys, "left_anti" if anti else "left_semi")
