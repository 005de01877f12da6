"""Aggregation operators: masks, filters, rollups and grouping sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def masked(aggregate, value: Column, mask: Column) -> Column:
    """An aggregate over the rows where the mask is true."""
    return aggregate(F.when(mask, value))


def group(df: DataFrame, keys: Sequence[str], *measures: Column) -> DataFrame:
    """Group by keys; without keys one row comes out."""
    return df.groupBy(*keys).agg(*measures) if keys else df.agg(*measures)


def rollup(df: DataFrame, keys: Sequence[str], *measures: Column) -> DataFrame:
    """All prefixes of the keys, with ``grouping_id``."""
    return df.rollup(*keys).agg(F.grouping_id().alias("grouping_id"), *measures)


def cube(df: DataFrame, keys: Sequence[str], *measures: Column) -> DataFrame:
    """All subsets of the keys, with ``grouping_id``."""
    return df.cube(*keys).agg(F.grouping_id().alias("grouping_id"), *measures)


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], keys: Sequence[str], *measures: Column) -> DataFrame:
    """The given subsets of the keys, with ``grouping_id``; each row is expanded once a set in one scan."""
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(F.grouping_id().alias("grouping_id"), *measures)


def rollup_refined(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Sum, count, average, least, largest and sample deviation rolled up from the finest level: rows are grouped
    once by all keys, and only those groups are expanded to the coarser levels."""
    finest = df.groupBy(*keys).agg(
        F.sum(value).alias("_sum"), F.count(value).alias("_n"), F.min(value).alias("_min"), F.max(value).alias("_max"), F.avg(value).alias("_mean"), (F.var_pop(value) * F.count(value)).alias("_squares")
    )
    coarser = finest.rollup(*keys).agg(
        F.grouping_id().alias("grouping_id"), F.sum("_sum").alias("total"), F.sum("_n").alias("rows"), F.min("_min").alias("least"), F.max("_max").alias("most"),
        F.sum("_squares").alias("_within"), F.sum(F.col("_n") * F.col("_mean") * F.col("_mean")).alias("_between"),
    )
    mean, n = F.col("total") / F.col("rows"), F.col("rows")
    squares = F.col("_within") + F.greatest(F.col("_between") - n * mean * mean, F.lit(0.0))
    return coarser.withColumns({"mean": F.when(n > 0, mean), "deviation": F.when(n > 1, F.sqrt(squares / (n - 1)))}).drop("_within", "_between")


def first_by(value: str, order: str) -> Column:
    """The first value in a total order, so that the result does not depend on the plan."""
    return F.min_by(value, order)


def expand(df: DataFrame, projections: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """Each row once for each list of expressions."""
    rows = F.array(*(F.struct(*(c.alias(n) for c, n in zip(p, names, strict=True))) for p in projections))
    return df.select(F.explode(rows).alias("r")).select("r.*")
