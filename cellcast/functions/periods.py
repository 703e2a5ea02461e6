"""Hour periods as an integer index, calendar parts and spines.

A period is an integer count of wall-clock hours since 2012-01-01 00h. It is
computed from date and hour parts only (never through a time zone), so a
timestamp such as 2013-03-10 02:30 stays in hour 2 and one step is always one
hour. The ``YYYYMMDDHH`` text form exists only at the edges.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Index 0 of the hour calendar, and its covered range
# (2012-01-01 00h to 2015-01-01 23h) used by the optional strict check.
EPOCH = dt.date(2012, 1, 1)
CALENDAR_FIRST_HOUR = 0
CALENDAR_LAST_HOUR = 26327

def _epoch_date() -> Column:
    return F.lit(EPOCH)

def _epoch_ts() -> Column:
    return F.lit(dt.datetime(EPOCH.year, EPOCH.month, EPOCH.day)).cast("timestamp_ntz")

def hour_index(ts: Column) -> Column:
    """Timestamp (NTZ or session-zone) -> hours since the epoch, from its wall-clock parts."""
    return (F.datediff(F.to_date(ts), _epoch_date()) * 24 + F.hour(ts)).cast("int")

def hour_index_from_parts(year: Column, month: Column, day: Column, hour: Column) -> Column:
    """Calendar parts -> hour index. An impossible date raises (ANSI), like a calendar miss."""
    return (F.datediff(F.make_date(year, month, day), _epoch_date()) * 24 + hour).cast("int")

def period_timestamp(h: Column) -> Column:
    """Hour index -> TIMESTAMP_NTZ at the start of that hour."""
    return F.timestamp_add("HOUR", h, _epoch_ts())

def period_date(h: Column) -> Column:
    return F.date_add(_epoch_date(), F.floor(h / 24).cast("int"))

def period_parts(h: Column) -> dict[str, Column]:
    """Month, day and hour of a period (the calendar features)."""
    d = period_date(h)
    return {
        "month": F.month(d),
        "day": F.dayofmonth(d),
        "hour": F.pmod(h, F.lit(24)).cast("int"),
    }

def period_text(h: Column) -> Column:
    """Hour index -> 'YYYYMMDDHH'."""
    d = period_date(h)
    return F.concat(
        F.lpad(F.year(d).cast("string"), 4, "0"),
        F.lpad(F.month(d).cast("string"), 2, "0"),
        F.lpad(F.dayofmonth(d).cast("string"), 2, "0"),
        F.lpad(F.pmod(h, F.lit(24)).cast("string"), 2, "0"),
    )

def period_from_text(text: Column) -> Column:
    """'YYYYMMDDHH' -> hour index."""
    return hour_index_from_parts(
        F.substring(text, 1, 4).cast("int"), F.substring(text, 5, 2).cast("int"),
        F.substring(text, 7, 2).cast("int"), F.substring(text, 9, 2).cast("int"))

def day_key(h: Column) -> Column:
    """Hour index -> yyyymmdd as an integer (the period text without its hour)."""
    d = period_date(h)
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")

def shift_period(h: Column, k: int | Column, strict: bool = False) -> Column:
    """Move a period by ``k`` hours; ``strict`` fails outside the 2012-2015 calendar."""
    out = h + k
    if strict:
        out = F.when(out.between(CALENDAR_FIRST_HOUR, CALENDAR_LAST_HOUR), out).otherwise(
            F.raise_error(F.concat(F.lit("period outside calendar: "), out.cast("string"))))
    return out.cast("int")

# Monday = 0 ... Sunday = 6 (Python's weekday()).
WEEKDAY_COLUMNS = ["wd_mon", "wd_tue", "wd_wed", "wd_thu", "wd_fri", "wd_sat", "wd_sun"]

def weekday_onehot(d: Column) -> dict[str, Column]:
    """Seven 0/1 indicator columns, Monday first."""
    wd = F.weekday(d)
    return {name: (wd == i).cast("int") for i, name in enumerate(WEEKDAY_COLUMNS)}

def hour_spine(spark: SparkSession, first_hour: int, last_hour: int) -> DataFrame:
    """One row per hour index in ``[first_hour, last_hour)`` (end-exclusive)."""
    return spark.range(int(first_hour), int(last_hour)).select(F.col("id").cast("int").alias("period_h"))

def hours_from_year(spark: SparkSession, start_year: int, until: dt.datetime) -> DataFrame:
    """Request hours of the weather job: every hour from 1 January of ``start_year``
    up to ``until`` (exclusive), as hour indexes."""
    first = (dt.date(start_year, 1, 1) - EPOCH).days * 24
    until_date = until.date() if isinstance(until, dt.datetime) else until
    last = (until_date - EPOCH).days * 24 + (until.hour if isinstance(until, dt.datetime) else 0)
    if isinstance(until, dt.datetime) and (until.minute or until.second or until.microsecond):
        last += 1  # a partial hour has started, so it is requested
    return hour_spine(spark, first, last)


def hour_spine_between(bounds: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Hour spine ``[lo, hi]`` for bounds held in a one-row DataFrame (kept distributed)."""
    return bounds.select(F.explode(F.sequence(F.col(lo), F.col(hi))).alias("period_h"))

def day_spine_between(bounds: DataFrame, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Day spine from a one-row DataFrame of DATE bounds, inclusive."""
    return bounds.select(
        F.explode(F.sequence(F.col(lo), F.col(hi), F.expr("INTERVAL 1 DAY"))).alias("day"))
