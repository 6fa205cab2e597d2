"""Dates, decimal years, fixed steps and water years. All times are in the session's time zone, meant to be UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _year_start(year: Column) -> Column:
    return F.unix_micros(F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))


def to_decimal_year(ts: Column) -> Column:
    """Year plus the share of it that is over; leap years are longer."""
    ts = ts.cast("timestamp")
    year = F.year(ts)
    start, end = _year_start(year), _year_start(year + 1)
    return year + (F.unix_micros(ts) - start) / (end - start)


def from_decimal_year(value: Column) -> Column:
    """To the millisecond: a double near 2000 holds a year's share to some microseconds only."""
    year = F.floor(value).cast("int")
    start, end = _year_start(year), _year_start(year + 1)
    return F.timestamp_micros((start + 1000 * F.round((value - year) * (end - start) / 1000)).cast("long"))


def parse_date(text: Column) -> Column:
    """A date written as yyyyMMdd, yyyy-MM-dd or yyyy-MM-ddTHH:mm:ss."""
    text = F.trim(text)
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("yyyyMMdd")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    ).cast("date")


def water_year(date: Column) -> Column:
    """October to September, named by the year in which it ends."""
    return F.year(date) + (F.month(date) >= 10).cast("int")


def step_dates(start: Column, end: Column, days: int = 14) -> Column:
    """Dates from ``start`` to ``end``, ``days`` apart, as an array."""
    return F.sequence(start, end, F.make_interval(days=F.lit(days)))


def step_index(ts: Column, start: Column, days: int = 14) -> Column:
    """Which step of ``days`` days after ``start`` holds ``ts``."""
    return F.floor((F.unix_micros(ts.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / (days * 86_400_000_000)).cast("long")
