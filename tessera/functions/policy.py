"""Semantic variants that a host engine may ask for.

The default is Spark's behaviour; other hosts differ in a handful of edge cases,
each of them a field here.  Helpers that have such a case take a ``Policy``."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Policy:
    """Which of the variants hold."""

    #: a fraction cast to an integer: truncated, or rounded half up
    round_half_up: bool = False
    #: ``replace`` of the empty string: unchanged, or the replacement around every character
    replace_empty: bool = False
    #: ``substr`` that starts before the string: what overlaps, or the empty string
    early_start_is_empty: bool = False
    #: ``substr`` from 0: the same as from 1, or the empty string
    zero_start_is_empty: bool = False
    #: text to date: shortened dates such as 1996-02, or whole ISO dates only
    full_date_only: bool = False
    #: text to decimal with too many digits after the point: rounded, or null
    decimal_text_rounds: bool = True
    #: decimal results that overflow: null, or an error
    overflow_error: bool = False
    #: average of decimals: 4 more digits of scale than the input, or as many as fit
    wide_decimal_average: bool = False
    #: ``pmod`` by zero: null, or 0
    pmod_zero_is_zero: bool = False
    #: sample deviation of one value: null, or NaN
    lone_deviation_is_nan: bool = False
    #: offsets of RANGE frames: values of the order key, or positions
    range_offsets_are_rows: bool = False


SPARK = Policy()
HIVE = Policy(replace_empty=False, early_start_is_empty=True, zero_start_is_empty=False, wide_decimal_average=True)
PRESTO_STYLE = Policy(round_half_up=True, replace_empty=True, early_start_is_empty=True, zero_start_is_empty=True, full_date_only=True)
