"""Number functions: integer division, decimals, hashing and casts with policy variants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.policy import SPARK, Policy


def int_divide(a: Column, b: Column) -> Column:
    """Integer division towards zero; NULL by zero."""
    return F.call_function("div", a, b)


def unscaled(d: Column, scale: int) -> Column:
    """The digits of a decimal as a long."""
    return (d * F.lit(10**scale).cast("decimal(19,0)")).cast("long")


def make_decimal(x: Column, precision: int, scale: int) -> Column:
    """A long's digits as a decimal of that precision and scale; NULL if they do not fit."""
    return (x.cast("decimal(20,0)") / F.lit(10**scale).cast("decimal(19,0)")).cast(f"decimal({precision},{scale})")


def average(d: Column, precision: int, scale: int, policy: Policy = SPARK) -> Column:
    """Average of decimals; the wide variant keeps as many digits as fit."""
    if policy.wide_decimal_average:
        return F.avg(d.cast(f"decimal({min(38, precision + 10)},{min(scale + 6, 18)})"))
    return F.avg(d)


def on_overflow(result: Column, *inputs: Column, policy: Policy = SPARK) -> Column:
    """A decimal result that is NULL though no input is: left so, or an error by policy."""
    if not policy.overflow_error:
        return result
    there = reduce(lambda a, b: a & b, (c.isNotNull() for c in inputs))
    return F.when(there & result.isNull(), F.raise_error(F.lit("decimal overflow"))).otherwise(result)


def combine_hash(first: Column, *rest: Column) -> Column:
    """Hash of several values as a polynomial of 31; NULL counts as 0."""
    return reduce(lambda h, x: h * F.lit(31).cast("long") + F.coalesce(x, F.lit(0)), rest, F.coalesce(first, F.lit(0)).cast("long"))


def partition_id(n: int, *keys: Column) -> Column:
    """The partition of a row in a hash exchange over n partitions."""
    return F.pmod(F.hash(*keys), F.lit(n))


def to_integer(x: Column, kind: str = "int", policy: Policy = SPARK) -> Column:
    """A fraction as an integer: towards zero, or half up."""
    return (F.round(x, 0) if policy.round_half_up else x).cast(kind)


def to_decimal(s: Column, precision: int, scale: int, policy: Policy = SPARK) -> Column:
    """Text as a decimal; NULL if it is no number or too large, and by policy if digits would be lost."""
    out = s.cast(f"decimal({precision},{scale})")
    if policy.decimal_text_rounds:
        return out
    return F.when(s.cast("decimal(38,18)") == out, out)


def positive_mod(x: Column, y: Column, policy: Policy = SPARK) -> Column:
    """The remainder with the sign of the divisor; by zero NULL, or 0 by policy."""
    return F.when(y == 0, F.when(x.isNotNull(), F.lit(0))).otherwise(F.pmod(x, y)) if policy.pmod_zero_is_zero else F.pmod(x, y)


def deviation(x: Column, policy: Policy = SPARK) -> Column:
    """Sample standard deviation; of one value NULL, or NaN by policy; of none NULL."""
    return F.when(F.count(x) == 1, F.lit(float("nan"))).otherwise(F.stddev_samp(x)) if policy.lone_deviation_is_nan else F.stddev_samp(x)
