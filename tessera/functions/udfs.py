"""User-defined functions: Python functions by batch, Java classes by a registration file."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def add_one(x: Column) -> Column:
    """The example functions that need no Python at all are plain expressions."""
    return (x + F.lit(1)).cast("int")


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def first_char(s: Column) -> Column:
    return F.substring(s, 1, 1)


def batch_udf(function: Callable[[pd.Series], pd.Series], returns: str):
    """A function of whole column batches (Arrow transfer)."""
    return F.pandas_udf(function, returns)


def register(spark: SparkSession, functions: dict[str, tuple[Callable[..., pd.Series], str]]) -> list[str]:
    """Register batch functions for SQL under lower-cased names; returns the names."""
    for name, (function, returns) in functions.items():
        spark.udf.register(name.lower(), F.pandas_udf(function, returns))
    return [name.lower() for name in functions]


def read_registration(lines: list[str]) -> dict[str, str]:
    """``name class`` lines as a mapping; names are lower-cased, blank and # lines skipped."""
    pairs = (line.split() for line in lines if line.strip() and not line.lstrip().startswith("#"))
    return {p[0].lower(): p[1] for p in pairs if len(p) >= 2}


def register_java(spark: SparkSession, registration: dict[str, str], returns: str = "string") -> list[str]:
    """Register Java UDF classes that stand on the class path."""
    for name, class_name in registration.items():
        spark.udf.registerJavaFunction(name, class_name, returns)
    return list(registration)
