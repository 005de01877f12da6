"""Expressions given as text: checking before running, and fused evaluation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unsupported(spark: SparkSession, schema: T.StructType | str, expression: str) -> str | None:
    """Why an expression can't be evaluated over rows of a schema; None if it can.  Nothing is run."""
    try:
        spark.createDataFrame([], schema).select(F.expr(expression)).schema  # noqa: B018
    except (ParseException, AnalysisException) as error:
        return str(error).strip().splitlines()[0]
    return None


def evaluate(df: DataFrame, columns: Mapping[str, str], condition: str | None = None) -> DataFrame:
    """Filter by and project to expressions, in one step of generated code."""
    df = df if condition is None else df.filter(F.expr(condition))
    return df.select(*(F.expr(text).alias(name) for name, text in columns.items()))
