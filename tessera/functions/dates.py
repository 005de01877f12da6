"""Date and time functions; functions over epoch milliseconds read UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.policy import SPARK, Policy

MS_PER_DAY = 86_400_000
#: epoch milliseconds of 0000-01-01 and of the last one of 9999-12-31
FIRST_MS, LAST_MS = -62_167_219_200_000, 253_402_300_799_999


def to_date(s: Column, policy: Policy = SPARK) -> Column:
    """Text as a date: shortened forms too, or whole ISO dates only."""
    out = F.to_date(s)
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), out) if policy.full_date_only else out


def unix_timestamp(s: Column, fmt: str = "yyyy-MM-dd HH:mm:ss", zone: str = "UTC") -> Column:
    """Seconds since the epoch of a text in a time zone; NULL if it does not parse."""
    return F.unix_timestamp(F.to_utc_timestamp(F.try_to_timestamp(s, F.lit(fmt)), zone))


def from_unixtime(seconds: Column, fmt: str = "yyyy-MM-dd HH:mm:ss", zone: str = "UTC") -> Column:
    """Seconds since the epoch as text in a time zone."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(seconds), zone), fmt)


def from_unix_millis(ms: Column, fmt: str = "yyyy-MM-dd HH:mm:ss", zone: str = "UTC") -> Column:
    """Milliseconds since the epoch as text in a time zone."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_millis(ms), zone), fmt)


def trunc_date(d: Column, level: str) -> Column:
    """First day of the WEEK (Monday), MONTH (MON, MM), QUARTER or YEAR (YYYY, YY); NULL for other levels."""
    return F.trunc(d, level)


def to_timestamp_ltz(n: Column, precision: int) -> Column:
    """Epoch seconds (precision 0) or milliseconds (3) as epoch milliseconds; NULL outside years 0 to 9999
    and for other precisions."""
    if precision not in (0, 3):
        return F.lit(None).cast("long")
    ms = n.cast("long") * F.lit(1000).cast("long") if precision == 0 else n.cast("long")
    return F.when(ms.between(F.lit(FIRST_MS), F.lit(LAST_MS)), ms)


def add_days_millis(ms: Column, days: Column) -> Column:
    """Milliseconds moved by whole days; NULL outside years 0 to 9999."""
    out = ms + days.cast("long") * F.lit(MS_PER_DAY)
    return F.when(out.between(F.lit(FIRST_MS), F.lit(LAST_MS)), out)


def hour_of_millis(ms: Column, zone: str = "UTC") -> Column:
    """Hour of day of epoch milliseconds in a time zone."""
    return F.hour(F.from_utc_timestamp(F.timestamp_millis(ms), zone))


def now_millis() -> Column:
    """Epoch milliseconds at the start of the query."""
    return F.unix_millis(F.current_timestamp())
