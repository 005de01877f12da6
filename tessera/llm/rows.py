"""Carrying a table's other columns through an operator, whatever their names are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: the struct that holds the columns an operator does not know
REST = "_rest"


def wrap(df: DataFrame, known: Sequence[str] = ("doc_id", "text")) -> DataFrame:
    """The known columns, and all others in one struct, so that no name of theirs can clash."""
    others = [c for c in df.columns if c not in known]
    return df.select(*known, *([F.struct(*others).alias(REST)] if others else []))


def unwrap(df: DataFrame, columns: Sequence[str], known: Sequence[str] = ("doc_id", "text")) -> DataFrame:
    """The columns as they stood before ``wrap``."""
    return df.select(*(F.col(c) if c in known else F.col(REST)[c].alias(c) for c in columns))
