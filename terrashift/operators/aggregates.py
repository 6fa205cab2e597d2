"""Grouped summaries: percentiles, shares, bins, circular means, regressions, robust scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrashift.operators.picks import number_rows


def percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact percentiles with linear interpolation, and ``n``."""
    got = df.groupBy(*by).agg(F.percentile(value, list(shares.values())).alias("_p"), F.count(value).alias("n"))
    return got.select(*by, "n", *[F.get("_p", F.lit(i)).alias(name) for i, name in enumerate(shares)])


def ranked_percentiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """As :func:`percentiles` for groups of any size, also for the whole table with no ``by``.

    The built-in aggregate keeps all distinct values of a group in one task. Here rows are numbered
    in the order of group and value over all partitions, and each percentile is read off at the two
    ranks around it, so a group with a third of all rows spreads over a third of all tasks.
    """
    used = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"))
    numbered = number_rows(used, [*[F.col(c) for c in by], F.col("_v")], "_k")
    groups = numbered.groupBy(*by).agg(F.min("_k").alias("_first"), F.count("*").alias("n"))
    placed = numbered.join(groups, by) if by else numbered.join(F.broadcast(groups))
    at = lambda share: (F.col("n") - 1) * F.lit(share)
    rank = F.col("_k") - F.col("_first")

    def read(share: float) -> Column:
        low = F.floor(at(share))
        a, b = F.max(F.when(rank == low, F.col("_v"))), F.max(F.when(rank == low + 1, F.col("_v")))
        part = F.max(at(share) - low)
        return a + F.coalesce(part * (b - a), F.lit(0.0))

    return placed.groupBy(*by).agg(F.max("n").alias("n"), *[read(p).alias(name) for name, p in shares.items()]).filter("n IS NOT NULL")


def value_shares(df: DataFrame, category: Column, name: str = "category") -> DataFrame:
    """(category, n, share) over all rows with a category."""
    counts = df.select(category.alias(name)).filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("total")).drop("total")


def fold_rare(shares: DataFrame, least: float, name: str = "category", other: str = "Other") -> DataFrame:
    """Categories below a share of ``least`` become one."""
    label = F.when(F.col("share") >= least, F.col(name)).otherwise(F.lit(other))
    return shares.groupBy(label.alias(name)).agg(F.sum("n").alias("n"), F.sum("share").alias("share"))


def overlapping_bins(df: DataFrame, value: str, bins: dict[str, tuple[float | None, float | None]], by: list[str] | None = None) -> DataFrame:
    """(bin, n, percent): values on an edge that two bins share count in both."""
    by = by or []
    v = F.col(value)

    def inside(low: float | None, high: float | None) -> Column:
        cond = v.isNotNull()
        if low is not None:
            cond = cond & (v >= low)
        return cond & (v <= high) if high is not None else cond

    counts = df.groupBy(*by).agg(F.count(value).alias("total"), *[F.count_if(inside(*b)).alias(n) for n, b in bins.items()])
    long = counts.select(*by, "total", F.explode(F.array(*[F.struct(F.lit(n).alias("bin"), F.col(n).alias("n")) for n in bins])).alias("b"))
    return long.select(*by, "b.bin", "b.n", F.round(100 * F.try_divide("b.n", "total"), 1).alias("percent"))


def circular_mean(angle: Column) -> Column:
    """Mean direction in degrees of an aggregation."""
    r = F.radians(angle)
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r)))), F.lit(360.0))


def regression(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(n, slope, stderr) of the least-squares line of each group; null for fewer than two x."""
    used = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = used.groupBy(*by).agg(
        F.count("*").alias("n"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy")
    )
    left = F.greatest(F.col("_syy") - F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx")), F.lit(0.0))
    error = F.when(F.col("n") == 2, F.lit(0.0)).otherwise(F.sqrt(F.try_divide(F.try_divide(left, F.col("n") - 2), F.col("_sxx"))))
    usable = (F.col("n") > 1) & (F.col("_sxx") > 0)
    return sums.select(*by, "n", F.when(usable, F.try_divide("_sxy", "_sxx")).alias("slope"), F.when(usable, error).alias("stderr"))


def windowed_regression(df: DataFrame, by: list[str], x: str, y: str, windows: DataFrame) -> DataFrame:
    """Slopes in many windows (window, start, stop; both ends belong to it) by one grouping.

    The window table is small by nature and is broadcast after its rows are counted by its builder.
    """
    hit = df.join(F.broadcast(windows), (F.col(x) >= F.col("start")) & (F.col(x) <= F.col("stop")))
    return regression(hit, [*by, "window"], x, y)


def study_windows(spark, dry: list[tuple[float, float]], shocks: list[float], years: list[tuple[float, float]], whole: tuple[float, float]) -> DataFrame:
    """The window table: whole series, dry seasons, 3/6/9/12 months and 3-6/6-9/9-12 months after each shock, water years."""
    rows = [("linear", *whole)]
    rows += [(f"dry{i}", *d) for i, d in enumerate(dry, 1)]
    for i, s in enumerate(shocks, 1):
        rows += [(f"eq{i}_{m}month", s, s + m / 12) for m in (3, 6, 9, 12)]
        rows += [(f"eq{i}_{a}-{b}month", s + a / 12, s + b / 12) for a, b in ((3, 6), (6, 9), (9, 12))]
    rows += [(f"wy{i}", *y) for i, y in enumerate(years, 1)]
    return spark.createDataFrame(rows, "window string, start double, stop double")


def median_deviation(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median, mad): two passes over one grouping key."""
    centre = df.groupBy(*by).agg(F.median(value).alias("median"))
    return df.join(centre, by).groupBy(*by, "median").agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))


def daily_fill(df: DataFrame, by: list[str], day: str, value: str) -> DataFrame:
    """Sum for each day from the group's first to its last, 0 where there is none."""
    sums = df.groupBy(*by, day).agg(F.sum(value).alias(value))
    span = sums.groupBy(*by).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    calendar = span.select(*by, F.explode(F.sequence("_a", "_b", F.make_interval(days=F.lit(1)))).alias(day))
    return calendar.join(sums, [*by, day], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, left, n) of equal bins; the last one holds its upper end, empty ones are listed."""
    width = (high - low) / bins
    place = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col(value).between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.lit(low) + F.col("bin") * width).alias("left"), F.coalesce("n", F.lit(0)).alias("n"))


def transitions(first: Column, second: Column, floor: float) -> list[Column]:
    """Counts of those that stayed active, became active, became inactive."""
    a, b = first >= floor, second >= floor
    return [F.count_if(a & b).alias("remained"), F.count_if(~a & b).alias("became_active"), F.count_if(a & ~b).alias("became_inactive")]


def in_order(df: DataFrame, label: str, order: list[str], fill: dict[str, object]) -> DataFrame:
    """One row for each label of ``order`` with its position, gaps filled; other labels follow by name."""
    table = df.sparkSession.createDataFrame(list(enumerate(order)), f"position int, {label} string")
    joined = F.broadcast(table).join(df, label, "full").fillna(fill)
    rest = F.lit(len(order)) + F.row_number().over(Window.partitionBy(F.col("position").isNull()).orderBy(label)) - 1
    return joined.withColumn("position", F.coalesce("position", rest))
