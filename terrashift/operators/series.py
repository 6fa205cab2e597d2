"""Operators over time series held as long rows (id, t, value)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from terrashift.functions.ratio import grew_by, percent_change, safe_ratio
from terrashift.functions.time import step_index
from terrashift.operators.aggregates import percentiles
from terrashift.operators.blocks import BLOCK_ROWS, between_known, fits_a_block, in_blocks, in_window, total, with_halo
from terrashift.operators.joins import interval_join


def _around(by: list[str], t: str, before: int, after: int):
    return Window.partitionBy(*by).orderBy(t).rowsBetween(-before, after)


def rolling_mean(by: list[str], t: str, value: str, window: int = 5) -> Column:
    """Centred, over what there is at the ends."""
    return F.avg(value).over(_around(by, t, window // 2, window // 2))


def rolling_median(by: list[str], t: str, value: str, window: int = 3) -> Column:
    return F.percentile(value, F.lit(0.5)).over(_around(by, t, window // 2, window // 2))


def running_sum(by: list[str], t: str, value: str) -> Column:
    return F.sum(value).over(Window.partitionBy(*by).orderBy(t).rowsBetween(Window.unboundedPreceding, 0))


def rolling(df: DataFrame, by: list[str], t: str, value: str, out: str, window: int, how: str = "mean", rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with the centred ``mean`` or ``median`` of a series of any length, as the columns above give it."""
    of = {"mean": lambda w: F.avg(value).over(w), "median": lambda w: F.percentile(value, F.lit(0.5)).over(w)}[how]
    return in_window(df, by, [F.col(t)], window // 2, out, of, rows)


def running_total(df: DataFrame, by: list[str], t: str, value: str, out: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with the running sum of a series of any length."""
    return total(df, by, [F.col(t)], value, out, rows)


def normalize(df: DataFrame, by: list[str], value: str, out: str, how: str = "minmax", sign: Column | None = None) -> DataFrame:
    """Values turned by ``sign`` and brought to [0, 1], or to mean 0 and deviation 1; constants become 0."""
    v = F.col(value) * sign if sign is not None else F.col(value)
    whole = Window.partitionBy(*by)
    if how == "minmax":
        base, spread = F.min(v).over(whole), F.max(v).over(whole) - F.min(v).over(whole)
    elif how == "zscore":
        base, spread = F.avg(v).over(whole), F.stddev_pop(v).over(whole)
    else:
        raise ValueError(f"unknown way to normalize: {how}")
    return df.withColumn(out, F.when(v.isNotNull(), F.coalesce(F.try_divide(v - base, F.when(spread > 0, spread)), F.lit(0.0))))


def baseline_reset(by: list[str], t: str, value: str) -> Column:
    return F.col(value) - F.first(value).over(Window.partitionBy(*by).orderBy(t).rowsBetween(Window.unboundedPreceding, 0))


def first_dry_run(df: DataFrame, by: list[str], t: str, value: str) -> DataFrame:
    """(by, start): the first of two samples in a row without increase."""
    after = F.lead(value).over(Window.partitionBy(*by).orderBy(t))
    return df.withColumn("_next", after).filter((F.col(value) == 0) & (F.col("_next") == 0)).groupBy(*by).agg(F.min(t).alias("start"))


def onset_dates(df: DataFrame, by: list[str], t: str, value: str, split: Column, first: Column, last: Column) -> DataFrame:
    """(by, last_dry, first_wet): the last sample of 0 before ``split`` and the first above 0 from it on, with fallbacks."""
    return df.groupBy(*by).agg(
        F.coalesce(F.max(F.when((F.col(value) == 0) & (F.col(t) < split), F.col(t))), first).alias("last_dry"),
        F.coalesce(F.min(F.when((F.col(value) > 0) & (F.col(t) >= split), F.col(t))), last).alias("first_wet"),
    )


def interpolate(df: DataFrame, by: list[str], t: str, value: str, rows: int = BLOCK_ROWS) -> DataFrame:
    """Nulls filled on the line between their neighbours, by position; at the end the last value stays."""
    return between_known(df, by, [F.col(t)], value, rows)


def detrend(df: DataFrame, by: list[str], t: str, value: str, out: str) -> DataFrame:
    """Values less the least-squares line over their position."""
    placed = df.withColumn("_i", (F.row_number().over(Window.partitionBy(*by).orderBy(t)) - 1).cast("double"))
    line = placed.groupBy(*by).agg(F.regr_slope(value, "_i").alias("_k"), F.regr_intercept(value, "_i").alias("_c"))
    return placed.join(line, by).withColumn(out, F.col(value) - (F.coalesce("_k", F.lit(0.0)) * F.col("_i") + F.coalesce("_c", value))).drop("_i", "_k", "_c")


def robust_outliers(df: DataFrame, by: list[str], t: str, value: str, low: str, high: str, factor: float = 3.0, window: int = 3, mode: str = "literal") -> DataFrame:
    """(by, eaof, iqrmed): share of samples far from a rolling median, and the median error width.

    A sample is far if its residual exceeds ``factor`` times the larger of half its error width and
    1.4826 times the median deviation. Mode ``literal`` takes high - low as the width, ``distances``
    high + low, for errors given as distances from the value. Series without usable samples get
    (1, infinity).
    """
    width = F.col(high) - F.col(low) if mode == "literal" else F.col(high) + F.col(low)
    r = df.withColumns({"_r": F.col(value) - rolling_median(by, t, value, window), "_w": width})
    med = r.groupBy(*by).agg(F.median("_r").alias("_m"))
    mad = r.join(med, by).withColumn("_dev", F.abs(F.col("_r") - F.col("_m"))).groupBy(*by).agg(F.coalesce(F.median("_dev"), F.lit(0.0)).alias("_mad"))
    tau = F.when(F.col("_w").isNotNull(), F.greatest(F.col("_w") / 2, 1.4826 * F.col("_mad")))
    scaled = r.join(mad, by).withColumn("_tau", tau)
    usable = F.col("_r").isNotNull() & (F.col("_tau") > 0)
    return scaled.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(usable, (F.abs("_r") > factor * F.col("_tau")).cast("double"))), F.lit(1.0)).alias("eaof"),
        F.coalesce(F.median(F.when(usable, F.col("_w"))), F.lit(float("inf"))).alias("iqrmed"),
    )


def cleaned_series(slide: DataFrame, background: DataFrame, by: list[str], t: str, value: str) -> DataFrame:
    """(by, t, clean, err_low, err_high): median of the slide less that of its background, with joint quartile distances."""
    quartiles = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    a = percentiles(slide, [*by, t], value, quartiles).drop("n")
    b = percentiles(background, [*by, t], value, quartiles).drop("n").withColumnsRenamed({q: f"b{q}" for q in quartiles})
    return a.join(b, [*by, t]).select(
        *by, t, (F.col("q2") - F.col("bq2")).alias("clean"),
        F.hypot(F.col("q2") - F.col("q1"), F.col("bq2") - F.col("bq1")).alias("err_low"),
        F.hypot(F.col("q3") - F.col("q2"), F.col("bq3") - F.col("bq2")).alias("err_high"),
    )


def resample_trailing(grid: DataFrame, rain: DataFrame, shakes: DataFrame, by: list[str], days: int = 14, least_shake: float = 0.001) -> DataFrame:
    """Sums over (t - days, t] for each grid time t, their running sums, and counts of shakes above a level.

    ``rain``: (by, time, mm), ``shakes``: (by, time, pga); empty windows give 0.
    """
    wet = interval_join(grid, rain, by, "t", "time", days).groupBy(*by, "t").agg(F.sum("mm").alias("rain"))
    shook = interval_join(grid, shakes, by, "t", "time", days).groupBy(*by, "t").agg(F.sum("pga").alias("pga"), F.count_if(F.col("pga") > least_shake).alias("eq_count"))
    out = grid.join(wet, [*by, "t"], "left").join(shook, [*by, "t"], "left").fillna({"rain": 0.0, "pga": 0.0, "eq_count": 0})
    return out.withColumns({f"{c}_cum": running_sum(by, "t", c) for c in ("rain", "pga", "eq_count")})


def resample_forward(grid: DataFrame, values: DataFrame, by: list[str], time: str, value: str, days: int = 14, least: float | None = None) -> DataFrame:
    """Sum and peak over [t, t + days) of steps that follow each other from each group's own start.

    Empty windows give null, with a count of 0; with ``least`` only values above it are counted.
    """
    start = grid.groupBy(*by).agg(F.min("t").alias("_t0"))
    counted = F.count_if(F.col(value) > least) if least is not None else F.count(value)
    placed = values.join(start, by).withColumn("_k", step_index(F.col(time), F.col("_t0"), days)).filter("_k >= 0")
    sums = placed.groupBy(*by, "_k").agg(F.sum(value).alias("total"), F.max(value).alias("peak"), counted.alias("n"))
    steps = grid.join(start, by).withColumn("_k", step_index(F.col("t"), F.col("_t0"), days))
    return steps.join(sums, [*by, "_k"], "left").drop("_k", "_t0").fillna({"n": 0})


def period_comparison(df: DataFrame, by: list[str], period: str, first: object, second: object, value: str, share: float = 0.3) -> DataFrame:
    """Sums of two periods, their ratio, change in per cent and whether the second is larger by ``share``."""
    total = lambda p: F.coalesce(F.sum(F.when(F.col(period) == p, F.col(value))), F.lit(0.0))
    sums = df.filter(F.col(period).isin(first, second)).groupBy(*by).agg(total(first).alias("first"), total(second).alias("second"))
    a, b = F.col("first"), F.col("second")
    return sums.withColumns({"ratio": safe_ratio(b, a), "percent": percent_change(b, a), "grew": grew_by(b, a, share)})


def group_stack(df: DataFrame, group: str, series: str, t: str, value: str, window: int = 5, how: str = "minmax") -> DataFrame:
    """Per group and time: median and 5th and 95th percentile of the normalized series, smoothed median, counts."""
    scaled = normalize(df, [group, series], value, "_v", how)
    stats = scaled.groupBy(group, t).agg(F.percentile("_v", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("_p"), F.countDistinct(series).alias("n_series"), F.count("_v").alias("n_points"))
    flat = stats.select(group, t, *[F.get("_p", F.lit(i)).alias(n) for i, n in enumerate(("p5", "median", "p95"))], "n_series", "n_points")
    return flat.withColumn("smooth", rolling_mean([group], t, "median", window))


def cross_correlation(df: DataFrame, by: list[str], t: str, a: str, b: str, step_days: float, max_lag_days: float = 120.0, least: int = 5, rows: int = BLOCK_ROWS) -> DataFrame:
    """(by, lag, lag_days, correlation): full correlation of the two standardized series at all lags within the bound.

    Groups with fewer than ``least`` samples, or a constant series, give no rows, nor do lags without a
    pair of samples. Lag k compares a(i + k) with b(i). A series is an array, correlated by transforms;
    one with more than ``rows`` samples is several, each with the samples that lags reach beside it, and
    their sums are added up.
    """
    bound = int(max_lag_days // step_days)
    whole = df.groupBy(*by).agg(F.count("*").alias("_n"), *[f(c).alias(f"_{n}{i}") for i, c in enumerate((a, b)) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    whole = whole.filter((F.col("_n") >= least) & (F.col("_s0") > 0) & (F.col("_s1") > 0))
    short = fits_a_block(df, by, rows)
    if short:
        placed = df.withColumns({"_i": F.row_number().over(Window.partitionBy(*by).orderBy(t)).cast("long"), "_block": F.lit(0), "_own": F.lit(True)})
    else:
        placed = with_halo(in_blocks(df, by, [F.col(t)], rows), bound, rows)
    z = lambda c, i: (F.col(c) - F.col(f"_m{i}")) / F.col(f"_s{i}")
    standard = placed.join(whole, by).select(*by, "_block", F.struct("_i", "_own", z(a, 0).alias("a"), z(b, 1).alias("b")).alias("_v"))
    arrays = standard.groupBy(*by, "_block").agg(F.sort_array(F.collect_list("_v")).alias("_v"))

    @F.arrow_udf(_LAGS)
    def lags(blocks: pa.Array) -> pa.Array:
        v, cuts = blocks.values, blocks.offsets.to_numpy()
        x, y, own = (v.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "_own"))
        parts = [_correlated(x[i:j], y[i:j], own[i:j], bound) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        sizes = np.cumsum([0, *[len(p[0]) for p in parts]])
        columns = [pa.array(np.concatenate([p[k] for p in parts]) if parts else []) for k in range(3)]
        kinds = [("lag", pa.int32()), ("pairs", pa.int64()), ("c", pa.float64())]
        flat = pa.StructArray.from_arrays([c.cast(k) for c, (_, k) in zip(columns, kinds, strict=True)], fields=[pa.field(*k) for k in kinds])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat)

    found = arrays.select(*by, F.explode(lags("_v")).alias("_c")).select(*by, "_c.lag", "_c.c")
    if not short:
        found = found.groupBy(*by, "lag").agg(F.sum("c").alias("c"))
    return found.select(*by, "lag", F.col("c").alias("correlation"), (F.col("lag") * F.lit(step_days)).alias("lag_days"))


_LAGS = T.ArrayType(T.StructType([T.StructField("lag", T.IntegerType()), T.StructField("pairs", T.LongType()), T.StructField("c", T.DoubleType())]))


def _correlated(a: np.ndarray, b: np.ndarray, own: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lags with pairs, how many, and the sums of a(i + lag) b(i) over the own samples i; samples without both values don't count."""
    known = ~(np.isnan(a) | np.isnan(b))
    a, b = np.where(known, a, 0.0), np.where(known & own, b, 0.0)
    bound = min(bound, len(a) - 1)
    size = 1 << (len(a) + bound).bit_length()
    transform = lambda v: np.fft.rfft(v, size)
    both = lambda u, v: np.fft.irfft(transform(u) * np.conj(transform(v)), size)
    lag = np.arange(-bound, bound + 1)
    pairs = np.rint(both(known.astype(float), (known & own).astype(float))[lag]).astype(np.int64)
    met = pairs > 0
    return lag[met], pairs[met], both(a, b)[lag][met]


def best_lag(correlations: DataFrame, by: list[str], digits: int = 9) -> DataFrame:
    """The lag of the highest correlation, the smallest lag of equal ones."""
    key = F.struct(-F.round("correlation", digits), F.col("lag"))
    return correlations.groupBy(*by).agg(F.min_by(F.struct("lag", "lag_days", "correlation"), key).alias("_r")).select(*by, "_r.*")
