"""Rank tests, correlations, adjustments and bootstraps over long rows (variable, group, value).

Ranks come from running counts over ranges of values, so no variable is one task; only the tails of distributions and the resampling
are Python, over few small rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from terrashift.operators.picks import number_rows, total_before

# --- tails of distributions -----------------------------------------------------------------------


def normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_tail(x: float, k: float) -> float:
    """Upper tail of the chi-square distribution: series below, continued fraction above the mode."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def beta_share(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(10_000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d or tiny)
        c = 1 + num / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def student_two_sided(t: float, df: float) -> float:
    return beta_share(df / 2, 0.5, df / (df + t * t))


@lru_cache(maxsize=None)
def _rank_sum_counts(n1: int, n2: int) -> tuple[int, ...]:
    """How many of the orders of two samples without ties give each U."""
    counts = [1] + [0] * (n1 * n2)
    for i in range(1, n1 + 1):  # product of (1 - q^(n2+i)) / (1 - q^i)
        for k in range(len(counts) - 1, n2 + i - 1, -1):
            counts[k] -= counts[k - n2 - i]
        for k in range(i, len(counts)):
            counts[k] += counts[k - i]
    return tuple(counts)


def rank_sum_p(u: float, n1: int, n2: int, ties: float) -> float:
    """Two-sided p of Mann-Whitney's U: exact for a sample of 8 or fewer without ties, else normal with
    tie and continuity corrections. ``ties``: sum of t^3 - t over tied groups."""
    if min(n1, n2) <= 8 and ties == 0:
        counts = _rank_sum_counts(n1, n2)
        high = int(max(u, n1 * n2 - u))
        return min(1.0, 2 * sum(counts[high:]) / sum(counts))
    n = n1 + n2
    sd = math.sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1))))
    if sd == 0:
        return 1.0
    return min(1.0, 2 * normal_tail((abs(u - n1 * n2 / 2) - 0.5) / sd))


@F.pandas_udf(T.DoubleType())
def _chi2_p(h: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(a, b - 1) if pd.notna(a) and b > 1 else None for a, b in zip(h, k, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def _rank_sum(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([rank_sum_p(*map(float, (a,)), int(b), int(c), float(t)) for a, b, c, t in zip(u, n1, n2, ties, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def _rho_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    def p(r: float, m: float) -> float:
        if pd.isna(r) or m < 3:
            return math.nan
        return 0.0 if abs(r) >= 1 else student_two_sided(r * math.sqrt((m - 2) / (1 - r * r)), m - 2)

    return pd.Series([p(a, b) for a, b in zip(rho, n, strict=True)], dtype=float)


# --- ranks ----------------------------------------------------------------------------------------


def value_ranks(counts: DataFrame, by: list[str], value: str, n: str = "n") -> DataFrame:
    """(by, value, n, rank) of the distinct values of each group, from how often each occurs: ranks with ties at their mean.

    Sums of counts run over ranges of all groups and values, so no group comes into one task.
    """
    total = total_before(counts, [*[F.col(c) for c in by], F.col(value)], n, "_before")
    first = total.groupBy(*by).agg(F.min("_before").alias("_first")) if by else total.agg(F.min("_before").alias("_first"))
    placed = total.join(first, by) if by else total.join(F.broadcast(first))
    return placed.select(*by, value, n, (F.col("_before") - F.col("_first") + (F.col(n) + 1) / 2).alias("rank"))


def with_ranks(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """``df`` with the rank of each non-null value in its group, ties at their mean; null values have none."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranks = value_ranks(counts, by, value, "_n").select(*by, value, F.col("rank").alias(out))
    same = [F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")) for c in by] + [F.col(f"l.`{value}`") == F.col(f"r.`{value}`")]
    return df.alias("l").join(ranks.alias("r"), same, "left").select("l.*", f"r.`{out}`")


def _sized(df: DataFrame, by: list[str], group: str, value: str, least: int) -> DataFrame:
    """(by, group, value, n): how often each value occurs in groups of at least ``least`` values."""
    used = df.filter(F.col(value).isNotNull() & F.col(group).isNotNull())
    counts = used.groupBy(*by, group, value).agg(F.count("*").alias("n"))
    large = counts.groupBy(*by, group).agg(F.sum("n").alias("_m")).filter(F.col("_m") >= least).drop("_m")
    return counts.join(large, [*by, group])


def _ties(counts: DataFrame, by: list[str]) -> DataFrame:
    """Sum of t^3 - t over the tied values of each group."""
    t = F.col("n").cast("double")
    return counts.groupBy(*by).agg(F.sum(t * t * t - t).alias("ties"))


def kruskal_h(df: DataFrame, by: list[str], group: str, value: str, least: int = 5) -> DataFrame:
    """(by, h, k_groups, n): tie-corrected H over groups of at least ``least`` values."""
    used = _sized(df, by, group, value, least)
    counts = used.groupBy(*by, value).agg(F.sum("n").alias("n"))
    ranked = used.join(value_ranks(counts, by, value).select(*by, value, "rank"), [*by, value])
    sums = ranked.groupBy(*by, group).agg(F.sum(F.col("rank") * F.col("n")).alias("_s"), F.sum("n").alias("_m"))
    total = sums.groupBy(*by).agg(F.sum(F.col("_s") * F.col("_s") / F.col("_m")).alias("_q"), F.sum("_m").alias("n"), F.count("*").alias("k_groups"))
    n = F.col("n").cast("double")
    raw = F.lit(12.0) / (n * (n + 1)) * F.col("_q") - 3 * (n + 1)
    fix = 1 - F.col("ties") / (n * n * n - n)
    h = F.when((F.col("k_groups") > 1) & (fix > 0), F.try_divide(raw, fix))
    return total.join(_ties(counts, by), by).select(*by, h.alias("h"), "k_groups", "n")


def kruskal(df: DataFrame, by: list[str], group: str, value: str, least: int = 5) -> DataFrame:
    return kruskal_h(df, by, group, value, least).withColumn("p_value", _chi2_p(F.col("h"), F.col("k_groups")))


def rank_sums(df: DataFrame, by: list[str], group: str, value: str, least: int = 5) -> DataFrame:
    """(by, g1, g2, n1, n2, u, ties) of each pair of groups, g1 before g2 by name.

    The pairs are of group labels, a fixed few; counts of values join their pairs by label.
    """
    used = _sized(df, by, group, value, least)
    labels = used.select(*by, F.col(group).alias("g1")).distinct()
    pairs = labels.join(labels.withColumnRenamed("g1", "g2"), by).filter("g1 < g2") if by else labels.withColumn("_k", F.lit(1)).join(labels.withColumnRenamed("g1", "g2").withColumn("_k", F.lit(1)), "_k").filter("g1 < g2").drop("_k")
    sides = pairs.select(*by, "g1", "g2", F.explode(F.array("g1", "g2")).alias(group))
    keys = [*by, "g1", "g2"]
    both = sides.join(used, [*by, group])
    first = F.col(group) == F.col("g1")
    counts = both.groupBy(*keys, value).agg(F.sum("n").alias("n"), F.sum(F.when(first, F.col("n")).otherwise(0)).alias("_n1"))
    ranked = counts.select(*keys, value, "_n1").join(value_ranks(counts.select(*keys, value, "n"), keys, value), [*keys, value])
    got = ranked.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("_n1")).alias("_s"), F.sum("_n1").alias("n1"), F.sum(F.col("n") - F.col("_n1")).alias("n2"))
    u = F.col("_s") - F.col("n1") * (F.col("n1") + 1) / 2
    return got.join(_ties(counts, keys), keys).select(*keys, "n1", "n2", u.alias("u"), "ties")


def holm(df: DataFrame, by: list[str], p: str, out: str = "p_holm", monotone: bool = False) -> DataFrame:
    """Step-down adjustment; as first published it never decreases along the order, here only with ``monotone``."""
    order = Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last())
    m = F.count(p).over(Window.partitionBy(*by))
    adjusted = F.when(F.col(p).isNotNull(), F.least((m - F.row_number().over(order) + 1) * F.col(p), F.lit(1.0)))
    df = df.withColumn(out, adjusted)
    return df.withColumn(out, F.max(out).over(order.rowsBetween(Window.unboundedPreceding, 0))) if monotone else df


def benjamini_hochberg(df: DataFrame, by: list[str], p: str, out: str = "q", standard: bool = True) -> DataFrame:
    """False discovery rates: the running minimum from the largest p down, or without ``standard`` from the smallest up."""
    order = Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last())
    raw = F.col(p) * F.count(p).over(Window.partitionBy(*by)) / F.row_number().over(order)
    df = df.withColumn("_q", F.when(F.col(p).isNotNull(), raw))
    frame = order.rowsBetween(0, Window.unboundedFollowing) if standard else order.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.min("_q").over(frame), F.lit(1.0)))).drop("_q")


def pairwise_rank_sums(df: DataFrame, by: list[str], group: str, value: str, least: int = 5, monotone: bool = False) -> DataFrame:
    """Mann-Whitney for all pairs of groups with Holm's adjustment."""
    tested = rank_sums(df, by, group, value, least)
    tested = tested.withColumn("p_value", _rank_sum(F.col("u"), F.col("n1"), F.col("n2"), F.col("ties"))).drop("ties")
    return holm(tested, by or ["_all"], "p_value", "p_holm", monotone) if by else holm(tested.withColumn("_all", F.lit(1)), ["_all"], "p_value", "p_holm", monotone).drop("_all")


def spearman_rho(df: DataFrame, by: list[str], x: str, y: str, least: int = 10) -> DataFrame:
    """(by, n, rho): correlation of average ranks."""
    used = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).groupBy(*by, "_x", "_y").agg(F.count("*").alias("_m"))
    ranks = lambda c, out: value_ranks(used.groupBy(*by, c).agg(F.sum("_m").alias("n")), by, c).select(*by, c, F.col("rank").alias(out))
    ranked = used.join(ranks("_x", "_rx"), [*by, "_x"]).join(ranks("_y", "_ry"), [*by, "_y"])
    # weighted moments about the middle rank, which is known: a pair that occurs m times counts m times
    whole = used.groupBy(*by).agg(F.sum("_m").alias("_all")) if by else used.agg(F.sum("_m").alias("_all"))
    placed = ranked.join(whole, by) if by else ranked.join(F.broadcast(whole))
    m, middle = F.col("_m"), (F.col("_all") + 1) / 2
    off = placed.withColumns({"_dx": F.col("_rx") - middle, "_dy": F.col("_ry") - middle})
    total = lambda a, b: F.sum(m * F.col(a) * F.col(b))
    got = off.groupBy(*by).agg(F.sum("_m").alias("n"), F.try_divide(total("_dx", "_dy"), F.sqrt(total("_dx", "_dx") * total("_dy", "_dy"))).alias("rho"))
    return got.filter(F.col("n") >= least).select(*by, "n", "rho")


def spearman(df: DataFrame, by: list[str], x: str, y: str, least: int = 10) -> DataFrame:
    return spearman_rho(df, by, x, y, least).withColumn("p_value", _rho_p(F.col("rho"), F.col("n")))


def significance(kw: DataFrame, pairs: DataFrame, medians: DataFrame, by: list[str], g1: str, g2: str, group: str, alpha: float = 0.05) -> DataFrame:
    """One row for each variable: whether the groups differ, whether the key pair does, and which way its medians lie."""
    key = pairs.filter((F.col("g1") == g1) & (F.col("g2") == g2)).select(*by, "p_holm")
    med = medians.groupBy(*by).agg(F.max(F.when(F.col(group) == g1, F.col("median"))).alias("m1"), F.max(F.when(F.col(group) == g2, F.col("median"))).alias("m2"))
    arrow = F.when(F.col("m2") > F.col("m1"), "up").when(F.col("m2") < F.col("m1"), "down").otherwise("same")
    got = kw.join(key, by, "left").join(med, by, "left")
    return got.select(*by, (F.col("p_value") < alpha).alias("groups_differ"), F.coalesce(F.col("p_holm") < alpha, F.lit(False)).alias("pair_differs"), arrow.alias("direction"))


# --- resampling -----------------------------------------------------------------------------------


def median_difference(x: np.ndarray, y: np.ndarray, draws: int = 10_000, seed: int = 123) -> tuple[float, float, float]:
    """Difference of medians and its 95 % interval; draws of x come before those of y."""
    if not len(x) or not len(y):
        return math.nan, math.nan, math.nan
    rng = np.random.default_rng(seed)
    out = np.empty(draws)
    for i in range(draws):
        a = rng.choice(x, size=len(x), replace=True)
        out[i] = np.median(a) - np.median(rng.choice(y, size=len(y), replace=True))
    out.sort()
    return float(np.median(x) - np.median(y)), float(out[int(0.025 * draws)]), float(out[int(0.975 * draws)])


def bootstrap_median_difference(df: DataFrame, variable: str, group: str, value: str, g1: str, g2: str, draws: int = 10_000, seed: int = 123) -> DataFrame:
    """(variable, delta_median, ci_low, ci_high, n1, n2); one task for each variable, its sorted values as samples.

    Repeats one fixed stream of random numbers, so a variable's values must fit a task; for others
    see :func:`bootstrap_by_ranks`.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (np.sort(pdf.loc[pdf[group] == g, value].dropna().to_numpy(float)) for g in (g1, g2))
        return pd.DataFrame([[pdf[variable].iloc[0], *median_difference(x, y, draws, seed), len(x), len(y)]], columns=["variable", "delta_median", "ci_low", "ci_high", "n1", "n2"])

    two = df.filter(F.col(group).isin(g1, g2)).select(variable, group, value)
    return two.groupBy(variable).applyInPandas(one, "variable string, delta_median double, ci_low double, ci_high double, n1 long, n2 long")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _median_ranks(n: pd.Series, seed: pd.Series) -> pd.Series:
    """Ranks, among n sorted values, of the one or two middle values of a sample of n with replacement."""

    def ranks(n: int, seed: int) -> list[int]:
        rng, m = np.random.default_rng(seed & (2**64 - 1)), (n + 1) // 2
        low = rng.beta(m, n - m + 1)
        high = low if n % 2 else low + (1 - low) * rng.beta(1, n - m)
        return [min(int(n * u) + 1, n) for u in (low, high)]

    return pd.Series([ranks(int(a), int(b)) for a, b in zip(n, seed, strict=True)])


def bootstrap_by_ranks(df: DataFrame, variable: str, group: str, value: str, g1: str, g2: str, draws: int = 10_000, seed: int = 123) -> DataFrame:
    """As :func:`bootstrap_median_difference` for groups of any size, from random numbers of its own.

    The middle of a sample with replacement is a value whose rank follows from order statistics of
    uniform numbers, so only ranks are drawn. Values are numbered over all partitions and met by
    number; no group comes together. At most ``draws`` differences of a variable are sorted at a time.
    A variable without values in one of the groups has nulls for the medians.
    """
    used = df.filter(F.col(group).isin(g1, g2) & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    sided = used.select(F.col(variable).alias("variable"), (F.col(group) == g1).alias("first"), F.col(value).cast("double").alias("value"))
    placed = number_rows(sided, [F.col("variable"), F.col("first"), F.col("value")])
    sides = placed.groupBy("variable", "first").agg(F.min("number").alias("start"), F.count("*").alias("n"))
    middle = F.array(F.floor((F.col("n") + 1) / 2), F.ceil((F.col("n") + 1) / 2))
    drawn = sides.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    drawn = drawn.withColumn("ranks", _median_ranks("n", F.xxhash64(F.lit(seed), "variable", "first", "draw")))
    asked = sides.withColumns({"draw": F.lit(-1), "ranks": middle}).unionByName(drawn)
    asked = asked.select("variable", "first", "draw", "start", F.explode("ranks").alias("r")).withColumn("number", F.col("start") + F.col("r") - 1)
    medians = asked.join(placed.select("number", "value"), "number").groupBy("variable", "first", "draw").agg(F.avg("value").alias("m"))
    of = lambda side, c: F.when(F.col("first") == side, F.col(c))
    gaps = medians.groupBy("variable", "draw").agg((F.max(of(True, "m")) - F.max(of(False, "m"))).alias("d"))
    got = gaps.groupBy("variable").agg(
        F.max(F.when(F.col("draw") < 0, F.col("d"))).alias("delta_median"), F.sort_array(F.collect_list(F.when(F.col("draw") >= 0, F.col("d")))).alias("_d")
    )
    counts = sides.groupBy("variable").agg(*[F.coalesce(F.sum(of(s, "n")), F.lit(0)).alias(c) for s, c in ((True, "n1"), (False, "n2"))])
    at = lambda share: F.get("_d", F.lit(int(share * draws)))
    return got.join(counts, "variable").select("variable", "delta_median", at(0.025).alias("ci_low"), at(0.975).alias("ci_high"), "n1", "n2")
