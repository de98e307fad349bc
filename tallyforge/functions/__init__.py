"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400


def round_half_up(c: Column, places: int = 0) -> Column:
    """floor(x * 10**places + 0.5) / 10**places: halves go up, also below zero."""
    scale = 10**places
    rounded = F.floor(c * scale + 0.5)
    return rounded if places == 0 else rounded / scale


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp, whatever the session's time zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")).cast("long")


def utc_date(seconds: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / DAY).cast("int"))


def utc_month(seconds: Column) -> Column:
    return F.date_format(utc_date(seconds), "yyyy-MM")


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))
