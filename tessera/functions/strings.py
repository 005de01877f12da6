"""String functions that Spark lacks or that have policy variants; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.policy import SPARK, Policy


def char_pad(s: Column, width: int) -> Column:
    """A CHAR(width) value: padded with blanks on the right, never cut."""
    return F.when(F.char_length(s) < width, F.rpad(s, width, " ")).otherwise(s)


def concat_char(a: Column, width: int, b: Column) -> Column:
    """``concat`` whose first operand is CHAR(width)."""
    return F.concat(char_pad(a, width), b)


def like_char(s: Column, width: int, pattern: str) -> Column:
    """LIKE on a CHAR(width) value, which is padded first."""
    return char_pad(s, width).like(pattern)


def regexp_extract_null(s: Column, pattern: str, group: int = 1) -> Column:
    """``regexp_extract`` that gives NULL where nothing matches or the group does not exist."""
    if group > re.compile(pattern).groups:
        return F.lit(None).cast("string")
    return F.when(s.rlike(pattern), F.regexp_extract(s, pattern, group))


def substr(s: Column, start: int, length: int | None = None, policy: Policy = SPARK) -> Column:
    """``substr`` from a 1-based or, if negative, from-the-end position."""
    out = F.substring(s, start, length if length is not None else 2**31 - 1)
    if start == 0 and policy.zero_start_is_empty:
        return F.when(s.isNotNull(), F.lit(""))
    if start < 0 and policy.early_start_is_empty:
        return F.when(F.char_length(s) < -start, F.lit("")).otherwise(out)
    return out


def replace(s: Column, search: str, by: str = "", policy: Policy = SPARK) -> Column:
    """``replace``; of the empty string by policy."""
    if search == "" and policy.replace_empty:
        return F.regexp_replace(s, "", by)
    return F.replace(s, F.lit(search), F.lit(by))


def empty_to_null(s: Column) -> Column:
    return F.nullif(s, F.lit(""))


def count_char(s: Column, c: str) -> Column:
    """How often the first character of ``c`` stands in ``s``."""
    return (F.char_length(s) - F.char_length(F.replace(s, F.lit(c[:1]), F.lit("")))).cast("long")


def split_index(s: Column, separator: str, index: int) -> Column:
    """The piece of 0-based ``index`` between separators; NULL where there is none."""
    if index < 0:
        return F.lit(None).cast("string")
    return F.get(F.split(s, re.escape(separator), -1), F.lit(index))


def varchar_write_check(s: Column, width: int) -> Column:
    """A value written to VARCHAR(width): trailing blanks beyond the width go, other text is an error."""
    cut = F.rtrim(s)
    fitting = F.when(F.char_length(cut) <= width, F.rpad(cut, width, " "))
    kept = F.when(F.char_length(s) <= width, s).otherwise(F.substring(s, 1, width))
    return F.when(s.isNull(), s).when((F.char_length(s) <= width) | fitting.isNotNull(), kept).otherwise(F.raise_error(F.concat(F.lit(f"exceeds varchar({width}): "), s)))


def char_write_check(s: Column, width: int) -> Column:
    """A value written to CHAR(width): padded, or without its trailing blanks beyond the width."""
    return F.when(s.isNull(), s).otherwise(char_pad(varchar_write_check(s, width), width))
