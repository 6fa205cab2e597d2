"""Fixed-step sums over a stream of measurements.

The batch operator anchors steps at each series' own start; a stream has one global anchor, so these
are tumbling windows with a watermark for late rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def step_sums(rows: DataFrame, by: list[str], time: str, value: str, days: int = 14, late: str = "2 days", least: float | None = None) -> DataFrame:
    """(by, start, end, total, peak, n); append mode gives each window once the watermark has passed it."""
    counted = F.count_if(F.col(value) > least) if least is not None else F.count(value)
    grouped = rows.withWatermark(time, late).groupBy(*by, F.window(time, f"{days} days").alias("w"))
    sums = grouped.agg(F.sum(value).alias("total"), F.max(value).alias("peak"), counted.alias("n"))
    return sums.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "total", "peak", "n")
