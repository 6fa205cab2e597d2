"""Ratios of two periods that are safe at zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INF = float("inf")


def safe_ratio(new: Column, old: Column) -> Column:
    """new / old; for an old value of 0 infinity, or 1 if the new one is 0 too."""
    return F.when(old == 0, F.when(new == 0, F.lit(1.0)).when(new.isNotNull(), F.lit(_INF))).otherwise(F.try_divide(new, old))


def percent_change(new: Column, old: Column) -> Column:
    """Change in per cent; for an old value of 0 it is 100, or 0 if the new one is 0 too."""
    return F.when(old == 0, F.when(new == 0, F.lit(0.0)).when(new.isNotNull(), F.lit(100.0))).otherwise(F.try_divide(new - old, old) * 100)


def grew_by(new: Column, old: Column, share: float = 0.3) -> Column:
    """1 if new exceeds old by more than ``share``, or is positive after 0; null counts as 0."""
    return F.coalesce((new > (1 + share) * old) | ((old == 0) & (new > 0)), F.lit(False)).cast("int")


def guarded_ratio(first: Column, second: Column, floor: float = 2.0) -> Column:
    """second / first with the first raised to ``floor``; null where both are below it."""
    return F.when(~((first < floor) & (second < floor)), F.try_divide(second, F.greatest(first, F.lit(floor))))


def both_low(first: Column, second: Column, floor: float = 2.0) -> Column:
    return (first < floor) & (second < floor)


def cm_per_year(metres_per_year: Column) -> Column:
    return F.abs(metres_per_year * 100)
