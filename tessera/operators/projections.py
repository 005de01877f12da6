"""Projection and predicate expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(df: DataFrame, condition: Column | None, **columns: Column) -> DataFrame:
    """Filter and project in one step; the optimizer fuses them and pushes both to the scan."""
    df = df if condition is None else df.filter(condition)
    return df.select(*(c.alias(name) for name, c in columns.items()))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(and_, conditions)


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions)


def switch(value: Column, cases: Sequence[tuple[object, object]], otherwise: object = None) -> Column:
    """Simple CASE: the result of the first case equal to the value."""
    return searched_switch([(value == F.lit(when), then) for when, then in cases], otherwise)


def searched_switch(cases: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """Searched CASE: the result of the first condition that holds."""
    out = reduce(lambda w, c: w.when(c[0], c[1]), cases[1:], F.when(*cases[0]))
    return out.otherwise(otherwise)


def decode(value: Column, *cases: object) -> Column:
    """Pairs of search and result, and a default if their number is odd; NULL equals NULL."""
    pairs = list(zip(cases[::2], cases[1::2], strict=False))
    default = cases[-1] if len(cases) % 2 else None
    return searched_switch([(value.eqNullSafe(F.lit(a)), b) for a, b in pairs], default)
