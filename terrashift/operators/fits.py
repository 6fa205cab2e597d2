"""Curve fits: a line before an event and a decaying exponential after it, and polynomials."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrashift.operators.joins import parameter_grid
from terrashift.operators.picks import number_rows


def decay_grid_fit(curves: DataFrame, by: list[str], t: str, y: str, event: float, betas: list[float], ends: list[float], search: float = 0.25, before: float = 1.0) -> DataFrame:
    """(by, t1, k, b, c, beta, rmse): the best of all combinations of break time, end level and decay rate.

    y = k t + b before t1, c - (c - y(t1)) exp(-beta (t - t1)) from it on. Break times are the samples
    within ``search`` of the event, or the event if there are none; the line is fitted over ``before``
    time units up to the break. A curve is one array; see :func:`best_decay` for how it is searched.
    """
    used = curves.filter(F.col(t).isNotNull() & F.col(y).isNotNull()).select(*by, F.struct(F.col(t).cast("double").alias("t"), F.col(y).cast("double").alias("y")).alias("_s"))
    samples = used.groupBy(*by).agg(F.sort_array(F.collect_list("_s")).alias("_s"))
    beta, c = np.sort(np.array(betas, float)), np.sort(np.array(ends, float))

    @F.arrow_udf(_FIT)
    def fit(arrays: pa.Array) -> pa.Array:
        held, cuts = arrays.values, arrays.offsets.to_numpy()
        ts, ys = held.field("t").to_numpy(), held.field("y").to_numpy()
        rows = [best_decay(ts[i:j], ys[i:j], event, beta, c, search, before) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.array([None if r is None else dict(zip(_FIT.names, r, strict=True)) for r in rows], pa.struct([(n, pa.float64()) for n in _FIT.names]))

    fitted = samples.select(*by, fit("_s").alias("f")).filter("f IS NOT NULL")
    return fitted.select(*by, "f.t1", "f.k", (F.col("f.y1") - F.col("f.k") * F.col("f.t1")).alias("b"), "f.c", "f.beta", "f.rmse")


_FIT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("t1", "k", "y1", "c", "beta", "rmse")])


def best_decay(t: np.ndarray, y: np.ndarray, event: float, betas: np.ndarray, ends: np.ndarray, search: float, before: float) -> tuple[float, ...] | None:
    """(t1, k, y1, c, beta, rmse) of least error, of equal ones the first; None if no break has two samples on both sides.

    As exp(-beta (t - t1)) = exp(beta t1) exp(-beta t), one pass from the end gives for a rate the sums
    behind all breaks, and with them the error is a parabola in the end level. So the work is samples
    times rates plus combinations, and the memory some arrays of the curve. Combinations that are about
    as good as the best are computed again sample by sample, so that no digits of the sums decide.
    """
    x, middle = t - event, float(y.mean())
    z, n = y - middle, len(t)
    near = np.unique(t[np.abs(x) <= search])
    t1 = near if len(near) else np.array([event])
    at = t1 - event
    high, post = np.searchsorted(t, t1, "right"), np.searchsorted(t, t1, "left")
    low = np.searchsorted(t, t1 - before - 1e-9 * (1 + np.abs(t1)), "left")
    while (out := np.append(t, np.inf)[low] - t1 < -before).any():  # what lies within the time before is a matter of the difference itself
        low = low + out
    upto = lambda v: np.concatenate(([0.0], np.cumsum(v)))
    sums = {name: upto(v) for name, v in (("x", x), ("xx", x * x), ("z", z), ("xz", x * z), ("zz", z * z))}
    own = lambda name: sums[name][high] - sums[name][low]
    count = high - low
    ok = (count >= 2) & (n - post >= 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean_x, mean_z = own("x") / count, own("z") / count
        spread = own("xx") - count * mean_x**2
        ok &= spread > 1e-13 * np.maximum(own("xx"), 1e-300)
        k = (own("xz") - count * mean_x * mean_z) / spread
        y1 = mean_z + k * (at - mean_x)
    t1, at, k, y1, post = (v[ok] for v in (t1, at, k, y1, post))
    if not len(t1):
        return None
    first = lambda name: sums[name][post]  # noqa: E731  # of the samples before the break
    s, ss, sz = first("x") - at * post, first("xx") - 2 * at * first("x") + at**2 * post, first("xz") - at * first("z")
    line = k**2 * ss + 2 * k * (y1 * s - sz) + post * y1**2 - 2 * y1 * first("z") + first("zz")
    m, rest_z, rest_zz = n - post, sums["z"][-1] - first("z"), sums["zz"][-1] - first("zz")
    behind = lambda v: np.append(np.cumsum(v[::-1])[::-1], 0.0)[post - post[0]]  # noqa: E731  # sums from each break to the end
    later, level = x[post[0] :] - at[0], ends - middle
    slack = 1e-12 * (sums["zz"][-1] + n * np.abs(level).max() ** 2)
    least, found = np.inf, []
    for j, beta in enumerate(betas):
        decay, turn = np.exp(-beta * later), np.exp(beta * (at - at[0]))
        e, ee, ez = turn * behind(decay), turn**2 * behind(decay**2), turn * behind(decay * z[post[0] :])
        square, mixed = m - 2 * e + ee, rest_z - y1 * e - ez + y1 * ee
        flat = line + rest_zz - 2 * y1 * ez + y1**2 * ee
        for i, c in enumerate(level):
            error = square * c**2 - 2 * mixed * c + flat
            least = min(least, float(error.min()))
            found += [(float(error[b]), b, i, j) for b in np.flatnonzero(error <= least + slack)]
        found = [f for f in found if f[0] <= least + slack]
    best = None
    for _, b, i, j in sorted(found, key=lambda f: f[1:]):
        since = x - at[b]
        model = np.where(since < 0, k[b] * since + y1[b], level[i] - (level[i] - y1[b]) * np.exp(-betas[j] * np.maximum(since, 0)))
        rmse = float(np.sqrt(np.mean((model - z) ** 2)))
        if best is None or round(rmse, 12) < best[0]:
            best = (round(rmse, 12), (float(t1[b]), float(k[b]), float(y1[b] + middle), float(ends[i]), float(betas[j]), rmse))
    return best[1]


def decay_loglinear_fit(curves: DataFrame, by: list[str], t: str, y: str, event: float, ends: list[float], before: float = 4 / 12, fallback: bool = True) -> DataFrame:
    """(by, k, b, c, beta, rmse) for a fixed break: ln(c - y) is regressed on time for each end level c.

    Without a usable end level the line goes on, with a decay rate of 0; without ``fallback`` such curves,
    and those without a line before the break, give no row.
    """
    used = curves.filter(F.col(t).isNotNull() & F.col(y).isNotNull()).select(*by, (F.col(t) - event).alias("s"), F.col(y).alias("y"))
    pre = used.filter("s < 0")
    count = pre.groupBy(*by).agg(F.count("*").alias("m"), F.max_by("y", "s").alias("last"))
    line = pre.filter(F.col("s") >= -before).groupBy(*by).agg(F.regr_slope("y", "s").alias("slope"), F.regr_intercept("y", "s").alias("level"))
    first = used.filter("s >= 0").groupBy(*by).agg(F.min_by("y", "s").alias("first"))
    two = F.col("m") >= 2
    known = used.select(*by).distinct().join(count, by, "left").join(line, by, "left").join(first, by, "left")
    lines = (known if fallback else known.filter("slope IS NOT NULL")).select(
        *by, F.when(two, F.coalesce("slope", F.lit(0.0))).otherwise(0.0).alias("k"),
        F.when(two, F.coalesce("level", "last")).otherwise(F.coalesce("last", "first")).alias("y1"),
    )
    grid = parameter_grid(lines, c=ends)
    z = F.col("c") - F.col("y")
    logs = grid.filter(F.col("c") > F.col("y1")).join(used.filter("s >= 0"), by).filter(z > 0)
    fitted = logs.groupBy(*by, "k", "y1", "c").agg(F.count("*").alias("_m"), F.regr_slope(F.ln(z), F.col("s")).alias("_g"), F.regr_intercept(F.ln(z), F.col("s")).alias("_a")).filter("_m >= 2 AND _g IS NOT NULL")
    model = F.when(F.col("s") < 0, F.col("k") * F.col("s") + F.col("y1")).otherwise(F.col("c") - F.exp(F.col("_a") + F.col("_g") * F.col("s")))
    off = lambda m: F.sqrt(F.avg((m - F.col("y")) * (m - F.col("y"))))
    errors = fitted.join(used, by).groupBy(*by, "k", "y1", "c", "_g").agg(off(model).alias("rmse"))
    best = errors.groupBy(*by).agg(F.min(F.struct(F.round("rmse", 12).alias("r"), "c", "_g", "k", "y1", "rmse")).alias("f")).select(
        *by, "f.k", "f.y1", "f.c", (-F.col("f._g")).alias("beta"), "f.rmse"
    )
    plain = lines.join(best, by, "left_anti").join(used, by).groupBy(*by, "k", "y1").agg(off(F.col("k") * F.col("s") + F.col("y1")).alias("rmse"))
    plain = plain.select(*by, "k", "y1", (F.col("y1") + 1e-6).alias("c"), F.lit(0.0).alias("beta"), "rmse")
    return (best.unionByName(plain) if fallback else best).select(*by, "k", (F.col("y1") - F.col("k") * event).alias("b"), "c", "beta", "rmse")


def decay_times(k: Column, beta: Column, amplitude: Column) -> dict[str, Column]:
    """Times to lose half and nine tenths of the amplitude, and until the decay is as slow as the line before."""
    inf = F.lit(float("inf"))
    usable = (beta > 0) & (k > 0) & (amplitude > 0)
    ratio = F.greatest(amplitude * beta, F.lit(1e-12)) / F.greatest(k, F.lit(1e-12))
    return {
        "t50": F.when(beta > 0, F.try_divide(F.lit(float(np.log(2))), beta)).otherwise(inf),
        "t90": F.when(beta > 0, F.try_divide(F.lit(float(np.log(10))), beta)).otherwise(inf),
        "tau_star": F.when(usable, F.try_divide(F.ln(ratio), beta)),
    }


def fit_intervals(fitted: DataFrame, event: float, alpha: float = 0.05) -> DataFrame:
    """One row over the fits of all draws (t1, k, b, c, beta): low, middle and high of each parameter and of the
    decay times, as <name>_low and so on, and the share of draws that break after the event, ``p_after``."""
    amplitude = F.col("c") - (F.col("k") * F.col("t1") + F.col("b"))
    rows = fitted.select("k", "beta", "t1", *[c.alias(n) for n, c in decay_times(F.col("k"), F.col("beta"), amplitude).items()])
    shares = {"low": alpha / 2, "mid": 0.5, "high": 1 - alpha / 2}
    sides = [F.percentile(n, F.lit(q)).alias(f"{n}_{side}") for n in ("k", "beta", "t50", "t90", "tau_star", "t1") for side, q in shares.items()]
    return rows.agg(*sides, F.avg((F.col("t1") > event).cast("double")).alias("p_after"))


def fit_band(fitted: DataFrame, times: DataFrame, t: str, alpha: float = 0.05) -> DataFrame:
    """(t, low, high): the interval of the fitted curves of all draws at each of ``times``."""
    at = times.select(F.col(t).alias("t"), F.lit(1).alias("_k")).distinct()
    since, y1 = F.col("t") - F.col("t1"), F.col("k") * F.col("t1") + F.col("b")
    model = F.when(since < 0, F.col("k") * since + y1).otherwise(F.col("c") - (F.col("c") - y1) * F.exp(-F.col("beta") * since))
    curves = fitted.withColumn("_k", F.lit(1)).join(at, "_k").select("t", model.alias("y"))
    return curves.groupBy("t").agg(F.percentile("y", F.lit(alpha / 2)).alias("low"), F.percentile("y", F.lit(1 - alpha / 2)).alias("high"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solved(powers: pd.Series, products: pd.Series) -> pd.Series:
    """Least-squares coefficients from sums of powers x^0 to x^2d and products x^0 y to x^d y; None for too few rows."""

    def one(p, q):
        if q is None or p is None or any(v is None or not np.isfinite(v) for v in (*p, *q)):
            return None
        n = len(q)
        return np.linalg.lstsq(np.array([[p[i + j] for j in range(n)] for i in range(n)], float), np.array(q, float), rcond=None)[0]

    return pd.Series([one(p, q) for p, q in zip(powers, products, strict=True)], dtype=object)


def polynomial_rmse(df: DataFrame, by: list[str], t: str, ys: list[str], degree: int = 4) -> DataFrame:
    """(by, rmse_<y>...): root mean square residual of a polynomial in time for each column.

    Series are scaled to [-1, 1], summed by powers, solved where the few sums are, and joined back
    for their residuals, so a series of any length spreads over all tasks. With no more values than
    the degree the residual is NaN.
    """
    usable = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    names = F.array(*[F.struct(F.lit(y).alias("v"), F.col(y).cast("double").alias("y")) for y in ys])
    keys = df.select(*by).distinct().withColumn("v", F.explode(F.array(*[F.lit(y) for y in ys])))
    long = df.select(*by, F.col(t).cast("double").alias("_t"), F.explode(names).alias("p")).select(*by, "_t", "p.v", "p.y").filter(usable("_t") & usable("y"))
    own = [*by, "v"]
    limits = long.groupBy(*own).agg(((F.min("_t") + F.max("_t")) / 2).alias("_mid"), ((F.max("_t") - F.min("_t")) / 2).alias("_half"))
    scaled = long.join(limits, own).withColumn("_x", F.coalesce(F.try_divide(F.col("_t") - F.col("_mid"), F.col("_half")), F.lit(0.0)))
    power = lambda i: F.lit(1.0) if i == 0 else F.pow("_x", F.lit(float(i)))
    sums = scaled.groupBy(*own).agg(
        F.count("*").alias("_n"), F.array(*[F.sum(power(i)) for i in range(2 * degree + 1)]).alias("_p"), F.array(*[F.sum(power(i) * F.col("y")) for i in range(degree + 1)]).alias("_q")
    )
    solved = sums.filter(F.col("_n") > degree).select(*own, _solved("_p", "_q").alias("_c"))
    off = F.col("y") - sum(F.get("_c", F.lit(i)) * power(i) for i in range(degree + 1))
    rmse = scaled.join(solved, own).groupBy(*own).agg(F.sqrt(F.avg(off * off)).alias("rmse"))
    whole = keys.join(rmse, own, "left").groupBy(*by).agg(*[F.coalesce(F.max(F.when(F.col("v") == y, F.col("rmse"))), F.lit(float("nan"))).alias(f"rmse_{y}") for y in ys])
    return whole


def resampled_ids(df: DataFrame, ident: str, draws: int, seed: int = 42) -> DataFrame:
    """(draw, id, times): how often each id comes in each draw with replacement.

    Every draw numbers the ids and hashes its slots to them, so draws are made where the rows are and
    come out the same for any partitioning.
    """
    numbered = number_rows(df.select(ident).distinct(), [F.col(ident)], "k").withColumn("k", F.col("k") - 1)
    total = numbered.agg(F.count("*").alias("n"))
    slots = numbered.join(F.broadcast(total)).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picks = slots.withColumn("pick", F.pmod(F.xxhash64(F.lit(seed), "draw", "k"), F.col("n")))
    times = picks.groupBy("draw", "pick").agg(F.count("*").alias("times"))
    return times.join(numbered.select(F.col("k").alias("pick"), ident), "pick").select("draw", ident, "times")

