"""Literal cases, edges and empty input of the operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrashift.operators import aggregates, blocks, cover, ellipsoid, fits, groups, joins, overlay, picks, series, spatial, stats


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_rolling_median_skips_nulls(spark):
    df = frame(spark, "i int, v double", (0, 1.0), (1, None), (2, 3.0), (3, 10.0))
    got = [r[0] for r in df.withColumn("g", F.lit(1)).withColumn("m", series.rolling_median(["g"], "i", "v")).orderBy("i").select("m").collect()]
    assert got == [1.0, 2.0, 6.5, 6.5]


def test_outlier_score_literal(spark):
    df = frame(spark, "id int, t int, v double, lo double, hi double", *[(1, i, v, 0.5, 1.0) for i, v in enumerate([0.0, 1.0, 2.0, 10.0, 4.0, 5.0, 6.0])])
    row = series.robust_outliers(df, ["id"], "t", "v", "lo", "hi").first()
    assert row["eaof"] == pytest.approx(1 / 7) and row["iqrmed"] == 0.5


def test_outlier_score_without_usable_samples(spark):
    df = frame(spark, "id int, t int, v double, lo double, hi double", (1, 0, 1.0, 0.0, 0.0), (1, 1, 1.0, 0.0, 0.0))
    row = series.robust_outliers(df, ["id"], "t", "v", "lo", "hi").first()
    assert (row["eaof"], row["iqrmed"]) == (1.0, math.inf)


def test_regression_literal(spark):
    df = frame(spark, "id int, x double, y double", (1, 2022.0, 0.0), (1, 2022.1, 0.01), (1, 2022.2, 0.03), (1, 2022.4, 0.04), (2, 1.0, 1.0), (3, 1.0, 0.0), (3, 2.0, 5.0))
    got = {r["id"]: r for r in aggregates.regression(df, ["id"], "x", "y").collect()}
    assert got[1]["slope"] == pytest.approx(0.102857143, abs=1e-8) and got[1]["stderr"] == pytest.approx(0.020603150, abs=1e-8)
    assert got[2]["slope"] is None and got[2]["stderr"] is None
    assert (got[3]["slope"], got[3]["stderr"]) == (5.0, 0.0)


def test_trailing_window_bounds(spark):
    grid = frame(spark, "id int, t timestamp", (1, day(14)))
    events = frame(spark, "id int, time timestamp, mm double", (1, day(0), 1.0), (1, day(14), 2.0), (1, day(7), 4.0))
    got = joins.interval_join(grid, events, ["id"], "t", "time", 14)
    assert sorted(r["mm"] for r in got.collect()) == [2.0, 4.0]
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def test_forward_resample_is_anchored_at_each_start(spark):
    grid = frame(spark, "id int, t timestamp", (1, day(3)), (1, day(17)), (2, day(0)))
    rain = frame(spark, "id int, time timestamp, mm double", (1, day(3), 1.0), (1, day(16), 5.0), (1, day(17), 7.0), (1, day(2), 9.0))
    got = {(r["id"], r["t"]): (r["total"], r["peak"], r["n"]) for r in series.resample_forward(grid, rain, ["id"], "time", "mm").collect()}
    assert got == {(1, day(3)): (6.0, 5.0, 2), (1, day(17)): (7.0, 7.0, 1), (2, day(0)): (None, None, 0)}


def test_constant_series_normalizes_to_zero(spark):
    df = frame(spark, "id int, v double", (1, 3.0), (1, 3.0), (2, None))
    got = sorted((r["id"], r["u"]) for r in series.normalize(df, ["id"], "v", "u").collect())
    assert got == [(1, 0.0), (1, 0.0), (2, None)]


def test_cross_correlation_literal(spark):
    a, b = [0, 0, 1, 2, 3, 3], [0, 1, 2, 3, 3, 3]
    df = frame(spark, "id int, t int, a double, b double", *[(1, i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], (2, 0, 1.0, 1.0))
    cc = series.cross_correlation(df, ["id"], "t", "a", "b", 14.0)
    best = series.best_lag(cc, ["id"]).collect()
    za, zb = ((np.array(x) - np.mean(x)) / np.std(x) for x in (a, b))
    full = np.correlate(za, zb, "full")
    assert len(best) == 1 and best[0]["correlation"] == pytest.approx(full.max()) and best[0]["correlation"] == pytest.approx(5.505978, abs=1e-6)
    assert best[0]["lag"] == int(np.argmax(full)) - 5


def test_rank_tests_literal(spark):
    x, y = [1, 2, 3, 4, 5], [2, 3, 4, 5, 9]
    df = frame(spark, "v string, g string, x double", *[("a", "X", float(i)) for i in x], *[("a", "Y", float(i)) for i in y])
    h = stats.kruskal(df, ["v"], "g", "x").first()
    assert h["h"] == pytest.approx(0.905590062, abs=1e-8) and h["p_value"] == pytest.approx(math.erfc(math.sqrt(h["h"] / 2)), abs=1e-9)
    u = stats.pairwise_rank_sums(df, ["v"], "g", "x").first()
    assert u["u"] == 8.0 and u["p_holm"] == u["p_value"]
    small = df.filter("x < 5")
    assert stats.kruskal(small, ["v"], "g", "x").count() == 0


def test_exact_rank_sum_counts():
    from itertools import combinations

    counts = stats._rank_sum_counts(3, 4)
    brute = [0] * 13
    for c in combinations(range(7), 3):
        brute[sum(c) - 3] += 1
    assert list(counts) == brute
    assert stats.rank_sum_p(0, 3, 4, 0) == pytest.approx(2 / 35)


def test_tails():
    assert stats.chi2_tail(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert stats.chi2_tail(30.0, 4) == pytest.approx(math.exp(-15) * 16, rel=1e-9)
    assert stats.student_two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)
    assert stats.normal_tail(1.959963985) == pytest.approx(0.025, abs=1e-9)


@pytest.mark.parametrize(("monotone", "want"), [(False, [0.03, 0.04, 0.06]), (True, [0.03, 0.06, 0.06])])
def test_holm(spark, monotone, want):
    df = frame(spark, "g int, i int, p double", (1, 0, 0.01), (1, 1, 0.04), (1, 2, 0.03))
    got = {r["i"]: r["p_holm"] for r in stats.holm(df, ["g"], "p", monotone=monotone).collect()}
    assert [got[i] for i in range(3)] == pytest.approx([want[0], want[1], want[2]])


@pytest.mark.parametrize(("standard", "want"), [(False, [0.03, 0.03, 0.03]), (True, [0.03, 0.04, 0.04])])
def test_benjamini_hochberg(spark, standard, want):
    df = frame(spark, "g int, i int, p double", (1, 0, 0.01), (1, 1, 0.04), (1, 2, 0.03), (1, 3, None))
    got = {r["i"]: r["q"] for r in stats.benjamini_hochberg(df, ["g"], "p", standard=standard).collect()}
    assert [got[0], got[1], got[2]] == pytest.approx(want) and got[3] is None


def test_bootstrap_literal():
    point, low, high = stats.median_difference(np.array([1.0, 2, 3, 4, 5]), np.array([2.0, 3, 4, 5, 9]))
    assert (point, low, high) == (-1.0, -6.0, 2.0)
    assert all(map(math.isnan, stats.median_difference(np.array([]), np.array([1.0]))))


def test_bootstrap_by_ranks_agrees_with_resampling(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(1, 1, 101), rng.normal(0, 2, 80)
    rows = [("v", "a", float(v)) for v in x] + [("v", "b", float(v)) for v in y] + [("v", "a", None), ("v", "a", math.nan), ("w", "a", 1.0), ("v", "c", 9.0)]
    df = frame(spark, "variable string, g string, value double", *rows)
    got = {r["variable"]: r for r in stats.bootstrap_by_ranks(df, "variable", "g", "value", "a", "b", draws=4000).collect()}
    point, low, high = stats.median_difference(x, y, draws=4000)
    assert (got["v"]["n1"], got["v"]["n2"], got["w"]["n1"], got["w"]["n2"]) == (101, 80, 1, 0)
    assert got["v"]["delta_median"] == pytest.approx(point)
    assert got["v"]["ci_low"] == pytest.approx(low, abs=0.08) and got["v"]["ci_high"] == pytest.approx(high, abs=0.08)
    assert got["w"]["delta_median"] is None and got["w"]["ci_low"] is None
    assert stats.bootstrap_by_ranks(df.limit(0), "variable", "g", "value", "a", "b", draws=10).count() == 0


def test_overlapping_bins_count_an_edge_twice(spark):
    df = frame(spark, "v double", (25.0,), (None,))
    got = {r["bin"]: r["n"] for r in aggregates.overlapping_bins(df, "v", {"a": (20.0, 25.0), "b": (25.0, 35.0)}).collect()}
    assert got == {"a": 1, "b": 1}


def test_circular_mean(spark):
    df = frame(spark, "a double", (350.0,), (10.0,), (20.0,))
    assert df.agg(aggregates.circular_mean(F.col("a"))).first()[0] == pytest.approx(6.704953, abs=1e-6)


def test_nearest_join_matches_brute_force_far_and_near(spark):
    rng = np.random.default_rng(5)
    t = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-180, 180, 60), rng.uniform(-89, 89, 60), strict=True))]
    s = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-180, 180, 40), rng.uniform(-89, 89, 40), strict=True))]
    got = {r["id"]: (r["sid"], r["distance_m"]) for r in joins.nearest_join(frame(spark, "id int, lon double, lat double", *t), frame(spark, "sid int, lon double, lat double", *s), "id", "sid").collect()}

    def xyz(lo, la):
        lo, la = math.radians(lo), math.radians(la)
        return np.array([math.cos(la) * math.cos(lo), math.cos(la) * math.sin(lo), math.sin(la)])

    for i, lo, la in t:
        d = [np.linalg.norm(xyz(lo, la) - xyz(a, b)) for _, a, b in s]
        assert got[i][0] == int(np.argmin(d)) and got[i][1] == pytest.approx(2 * math.asin(min(d) / 2) * 6371008.8)


def test_nearest_join_over_an_ocean(spark):
    """Supports on another continent, many of them in one place: no target meets them all."""
    rng = np.random.default_rng(6)
    t = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-124, -120, 300), rng.uniform(38, 42, 300), strict=True))]
    s = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(5, 8, 2000), rng.uniform(44, 47, 2000), strict=True))]
    targets, support = frame(spark, "id int, lon double, lat double", *t, (300, None, 1.0)), frame(spark, "sid int, lon double, lat double", *s)
    got = {r["id"]: r["sid"] for r in joins.nearest_join(targets, support, "id", "sid").collect()}

    def xyz(points):
        lo, la = np.radians([p[1] for p in points]), np.radians([p[2] for p in points])
        return np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=1)

    assert got == dict(enumerate(((xyz(t)[:, None] - xyz(s)[None]) ** 2).sum(axis=2).argmin(axis=1).tolist()))
    on_sphere = joins._on_sphere(targets.dropna(), "lon", "lat")
    items = joins._on_sphere(support, "lon", "lat").select("sid", *[F.col(c).alias(f"_s{c[1:]}") for c in ("_x", "_y", "_z")])
    place = ["_sx", "_sy", "_sz"]
    met = joins.nearest_leaves(on_sphere, items, ["_x", "_y", "_z"], place, place).count()
    assert met < 60 * len(t)


@pytest.mark.parametrize("node_rows", [50_000, 200])
def test_nearest_join_of_supports_in_one_place(spark, monkeypatch, node_rows):
    """All supports and targets within a few metres, on a line, at equal places: a target meets some tens of them."""
    monkeypatch.setattr(joins, "NODE_ROWS", node_rows)
    rng = np.random.default_rng(7)
    for width, height in ((1e-5, 1e-5), (1e-5, 1e-9)):
        spots = rng.uniform(0, 1, (2000, 2)) * [width, height] + [-123.0, 40.0]
        s = [(i, float(x), float(y)) for i, (x, y) in enumerate(spots)] + [(9000 + i, float(spots[i][0]), float(spots[i][1])) for i in range(500)]
        t = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-0.2, 1.2, (400, 2)) * [width, height] + [-123.0, 40.0])]
        targets, support = frame(spark, "id int, lon double, lat double", *t), frame(spark, "sid int, lon double, lat double", *s)
        got = {r["id"]: r["distance_m"] for r in joins.nearest_join(targets, support, "id", "sid").collect()}
        for i, lon, lat in t:
            gap = np.radians(spots - [lon, lat]) * [math.cos(math.radians(40)), 1]
            assert got[i] == pytest.approx(6371008.8 * np.hypot(*gap.T).min(), rel=1e-3, abs=1e-6)
        on_sphere, held = joins._on_sphere(targets, "lon", "lat"), joins._on_sphere(support.filter("sid < 9000"), "lon", "lat")
        items = held.select("sid", *[F.col(c).alias(f"_s{c[1:]}") for c in ("_x", "_y", "_z")]).dropDuplicates(["_sx", "_sy", "_sz"])
        place = ["_sx", "_sy", "_sz"]
        assert joins.nearest_leaves(on_sphere, items, ["_x", "_y", "_z"], place, place).count() < 100 * len(t)


def test_trees_hold_every_item_once(spark, monkeypatch):
    monkeypatch.setattr(joins, "NODE_ROWS", 100)
    rng = np.random.default_rng(3)
    rows = [(i % 2, i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1, (3000, 2)) ** 5)]
    tree, depth = joins.spatial_tree(frame(spark, "g int, i int, x double, y double", *rows), ["x", "y"], ["x", "y"], ["g"])
    got = tree.groupBy("g", "_node").agg(F.count("*").alias("n"), F.collect_list("i").alias("i")).collect()
    assert depth == 2 + joins._depth(6, joins.LEAF) and max(r["n"] for r in got) <= joins.LEAF
    assert sorted(i for r in got for i in r["i"]) == list(range(3000))


def test_asof_takes_equal_times_and_default(spark):
    t = frame(spark, "id int, t int", (1, 5), (1, 0), (2, 3))
    v = frame(spark, "id int, t int, v double", (1, 5, 7.0), (1, 2, 3.0))
    assert sorted((r["id"], r["t"], r["v"]) for r in joins.asof_join(t, v, "id", "t", "v").collect()) == [(1, 0, 0.0), (1, 5, 7.0), (2, 3, 0.0)]


@pytest.mark.parametrize("rows", [3, 40, 10_000])
def test_long_series_in_any_number_of_blocks(spark, rows):
    """One series and some short ones, cut into one block, a few, or hundreds: the same windows, sums and carried values."""
    rng = np.random.default_rng(11)
    data = [("a" if i % 5 else None if i % 2 else "b", i * 7 % 601, None if rng.random() < 0.4 else float(rng.integers(0, 50))) for i in range(600)] + [("c", 1, None), ("d", 1, 2.0)]
    df = frame(spark, "g string, t int, v double", *data).repartition(4)
    whole = df.groupBy().agg(F.count("*")).first()[0]
    assert whole == len(data)
    own = {g: sorted((t, v) for h, t, v in data if h == g) for g in {r[0] for r in data}}
    want, nan = {}, float("nan")
    for g, values in own.items():
        v = [x for _, x in values]
        known = [i for i, x in enumerate(v) if x is not None]
        for i, (t, _) in enumerate(values):
            near = lambda k, v=v, i=i: [x for x in v[max(0, i - k) : i + k + 1] if x is not None]
            a, b = max((k for k in known if k <= i), default=None), min((k for k in known if k >= i), default=None)
            line = None if a is None else v[a] if b is None or a == b else v[a] + (i - a) / (b - a) * (v[b] - v[a])
            so_far = [x for x in v[: i + 1] if x is not None]
            want[g, t] = (np.mean(near(2)) if near(2) else None, np.median(near(1)) if near(1) else None, sum(so_far) if so_far else None, line, None if a is None else v[a])
    steps = [
        series.rolling(df, ["g"], "t", "v", "x", 5, rows=rows), series.rolling(df, ["g"], "t", "v", "x", 3, "median", rows=rows), series.running_total(df, ["g"], "t", "v", "x", rows=rows),
        series.interpolate(df.withColumn("x", F.col("v")), ["g"], "t", "x", rows=rows), blocks.last_known(df, ["g"], [F.col("t")], F.col("v"), "x", rows=rows),
    ]
    for k, step in enumerate(steps):
        got = step.collect()
        assert sorted(step.columns) == ["g", "t", "v", "x"] and len(got) == len(data)
        assert [nan if r["x"] is None else r["x"] for r in got] == pytest.approx([nan if want[r["g"], r["t"]][k] is None else want[r["g"], r["t"]][k] for r in got], nan_ok=True), k
    targets = frame(spark, "g string, t double, k int", *[(g, float(t), i) for i, (g, t) in enumerate([("a", x) for x in range(-5, 620, 9)] + [("b", 50), ("z", 9), ("c", 5)])])
    met = joins.asof_join(targets, df.withColumn("t", F.col("t").cast("double")).dropna(subset=["v"]), "g", "t", "v", rows=rows).collect()
    assert len(met) == targets.count()
    for r in met:
        before = [v for t, v in own.get(r["g"], []) if t <= r["t"] and v is not None]
        assert r["v"] == (before[-1] if before else 0.0)


def test_a_hot_series_spreads_over_many_blocks(spark):
    df = spark.range(20_000).select(F.lit("a").alias("g"), (F.col("id") * 7919 % 20_000).alias("t"))
    sizes = [r["n"] for r in blocks.in_blocks(df, ["g"], [F.col("t")], 500).groupBy("g", "_block").agg(F.count("*").alias("n")).collect()]
    assert sizes == [500] * 40
    halo = blocks.with_halo(blocks.in_blocks(df, ["g"], [F.col("t")], 500), 3, 500).groupBy("_block").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert halo == 506


def test_columnwise_mixes_rows_and_row_mode_does_not(spark):
    df = frame(spark, "id int, k int, a double, b double", (1, 1, None, 2.0), (1, 2, 5.0, 3.0))
    assert picks.best_row(df, ["id"], [F.col("k")]).first().asDict() == {"id": 1, "k": 1, "a": None, "b": 2.0}
    assert picks.best_row(df, ["id"], [F.col("k")], mode="columnwise").first().asDict() == {"id": 1, "k": 1, "a": 5.0, "b": 2.0}


def test_decay_fit_recovers_a_curve(spark):
    t = np.arange(2022.0, 2024.5, 0.05)
    y = np.where(t < 2023.0, 0.1 * (t - 2023.0) + 0.3, 0.9 - 0.6 * np.exp(-3.0 * (t - 2023.0)))
    df = frame(spark, "g string, t double, y double", *[("a", float(a), float(b)) for a, b in zip(t, y, strict=True)])
    fit = fits.decay_grid_fit(df, ["g"], "t", "y", 2023.0, [1.0, 3.0, 5.0], [0.8, 0.9, 1.0]).first()
    assert (fit["c"], fit["beta"]) == (0.9, 3.0) and fit["rmse"] < 1e-6 and fit["k"] == pytest.approx(0.1)
    log = fits.decay_loglinear_fit(df, ["g"], "t", "y", 2023.0, [0.8, 0.9, 1.0]).first()
    assert log["c"] == 0.9 and log["beta"] == pytest.approx(3.0, abs=1e-6)


def test_fits_by_sums_are_those_of_all_combinations():
    rng = np.random.default_rng(0)
    betas, ends = np.linspace(0.1, 2, 9), np.linspace(0.7, 1, 7)
    for trial in range(40):
        n, high = int(rng.integers(2, 60)), 1e4 if trial % 7 == 0 else 0.0
        t = np.sort(rng.choice(np.arange(0, 4, 0.05), n, replace=bool(trial % 2)))
        y = rng.normal(0, 0.05, n) + np.where(t < 1.5, 0.1 * t, 0.9 - 0.7 * np.exp(-0.7 * (t - 1.5))) + high
        want = []
        near = np.unique(t[np.abs(t - 1.52) <= 0.25])
        for t1 in near if len(near) else [1.52]:
            s = t - t1
            pre = (s <= 0) & (s >= -1)
            if pre.sum() < 2 or (s >= 0).sum() < 2 or np.ptp(s[pre]) == 0:
                continue
            k, y1 = np.polyfit(s[pre], y[pre], 1)
            for c in ends + high:
                for beta in betas:
                    f = np.where(s < 0, k * s + y1, c - (c - y1) * np.exp(-beta * np.maximum(s, 0)))
                    want.append((float(np.sqrt(np.mean((f - y) ** 2))), t1, c, beta))
        got = fits.best_decay(t, y, 1.52, betas, ends + high, 0.25, 1.0)
        assert (got is None) == (not want)
        if want:
            assert got[5] == pytest.approx(min(want)[0], abs=1e-7 if high else 1e-9)
    assert fits.best_decay(np.array([0.0, 1.0]), np.array([1.0, 2.0]), 50.0, betas, ends, 0.25, 1.0) is None


def test_the_memory_of_a_fit_is_that_of_its_curve():
    import tracemalloc

    t = np.linspace(0, 4, 100_000)
    y = np.where(t < 1.5, 0.1 * t, 0.9 - 0.75 * np.exp(-0.7 * (t - 1.5)))
    tracemalloc.start()
    got = fits.best_decay(t, y, 1.5, np.linspace(0.1, 2, 20), np.linspace(0.7, 1, 31), 0.01, 1.0)
    assert tracemalloc.get_traced_memory()[1] < 60 * t.nbytes and got[3] == pytest.approx(0.9)
    tracemalloc.stop()


@pytest.mark.parametrize("rows", [7, 50, 10_000])
def test_correlations_of_series_in_any_number_of_blocks(spark, rows):
    rng = np.random.default_rng(3)
    data = [(g, i, None if rng.random() < 0.1 else float(x), float(y)) for g, n in (("a", 90), ("b", 12), ("c", 4), ("d", 30)) for i, (x, y) in enumerate(rng.normal(size=(n, 2)).cumsum(axis=0))]
    data = [(g, i, 5.0 if g == "d" else x, y) for g, i, x, y in data]
    df = frame(spark, "g string, t int, a double, b double", *data).repartition(3)
    got = {(r["g"], r["lag"]): r["correlation"] for r in series.cross_correlation(df, ["g"], "t", "a", "b", 2.0, 40.0, rows=rows).collect()}
    want = {}
    for g in "ab":
        x, y = (np.array([r[k] if r[k] is not None else np.nan for r in data if r[0] == g]) for k in (2, 3))
        x, y = (x - np.nanmean(x)) / np.nanstd(x), (y - y.mean()) / y.std()
        for lag in range(-20, 21):
            pairs = [x[i + lag] * y[i] for i in range(len(x)) if 0 <= i + lag < len(x) and not np.isnan(x[i + lag]) and not np.isnan(x[i])]
            if pairs:
                want[g, lag] = sum(pairs)
    assert set(got) == set(want) and got == pytest.approx(want)


def test_intervals_and_band_of_resampled_fits(spark):
    rows = [(i, 1.4 + 0.05 * i, 0.1 * i - 0.1, 0.02 * i, 0.8 + 0.01 * i, 0.5 + 0.1 * i) for i in range(6)]
    fitted = frame(spark, "draw int, t1 double, k double, b double, c double, beta double", *rows)
    _, t1, k, b, c, beta = np.array(rows).T
    a = c - (k * t1 + b)
    usable = (k > 0) & (a > 0)
    want = {"k": k, "beta": beta, "t50": math.log(2) / beta, "t90": math.log(10) / beta, "tau_star": np.log(a * beta / np.where(usable, k, 1))[usable] / beta[usable], "t1": t1}
    got = fits.fit_intervals(fitted, 1.52).first()
    for name, values in want.items():
        assert [got[f"{name}_{s}"] for s in ("low", "mid", "high")] == pytest.approx(np.percentile(values, [2.5, 50, 97.5]))
    assert got["p_after"] == pytest.approx(np.mean(t1 > 1.52))
    for row in fits.fit_band(fitted, frame(spark, "t double", (1.0,), (1.5,), (3.0,), (3.0,)), "t").collect():
        y = np.where(row["t"] < t1, k * row["t"] + b, c - a * np.exp(-beta * (row["t"] - t1)))
        assert [row["low"], row["high"]] == pytest.approx(np.percentile(y, [2.5, 97.5]))


def test_loglinear_fit_falls_back_to_the_line(spark):
    df = frame(spark, "g string, t double, y double", ("a", 0.0, 0.0), ("a", 0.1, 0.1), ("a", 0.2, 5.0))
    fit = fits.decay_loglinear_fit(df, ["g"], "t", "y", 0.2, [1.0]).first()
    assert fit["beta"] == 0.0 and fit["k"] == pytest.approx(1.0)


def test_resampled_ids_keep_the_number_and_ignore_partitions(spark):
    df = spark.range(30).withColumnRenamed("id", "k")
    a = {(r["draw"], r["k"]): r["times"] for r in fits.resampled_ids(df.repartition(7), "k", 5).collect()}
    b = {(r["draw"], r["k"]): r["times"] for r in fits.resampled_ids(df.repartition(2), "k", 5).collect()}
    assert a == b and all(sum(v for (d, _), v in a.items() if d == i) == 30 for i in range(5))


def test_overlap_area_of_concave_polygons():
    ell = np.array([(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4)], float)
    square = np.array([(0.5, 0.5), (2.5, 0.5), (2.5, 2.5), (0.5, 2.5)], float)
    assert spatial.overlap_area(ell, square) == pytest.approx(2 * 0.5 + 0.5 * 1.5)
    assert spatial.overlap_area(ell, ell) == pytest.approx(7.0)
    assert spatial.overlap_area(ell, square + 10) == 0


def test_clip_convex():
    got = spatial.clip_convex(np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float), np.array([(1, 1), (3, 1), (3, 3), (1, 3)], float))
    assert abs(spatial._ring_area(got)) == pytest.approx(1.0)


def test_ring_metrics_of_a_rectangle():
    lat, dlat, dlon = 40.0, 0.002, 0.01
    m = dict(zip(spatial.METRICS.names, spatial.ring_metrics(np.array([(0, lat), (dlon, lat), (dlon, lat + dlat), (0, lat + dlat)])), strict=True))
    assert m["area_m2"] == pytest.approx(853.9 * 222.07, rel=2e-3)
    assert m["axis_ratio"] == pytest.approx(853.9 / 222.07, rel=2e-3) and m["orientation_deg"] == pytest.approx(90, abs=0.5)
    assert m["center_lon"] == pytest.approx(dlon / 2) and m["center_lat"] == pytest.approx(lat + dlat / 2, abs=1e-6)


def test_components_of_a_long_path(spark):
    nodes = spark.range(60)
    edges = spark.createDataFrame([(i, i + 1) for i in range(39)] + [(41, 45)], "a long, b long")
    got = {r["id"]: r["component"] for r in spatial.label_components(nodes, edges).collect()}
    assert all(got[i] == 0 for i in range(40)) and got[45] == 41 and got[59] == 59


def test_union_outlines():
    area = lambda region: sum(overlay._area(r) for p in region for r in p)
    union = lambda *shapes: overlay.united([overlay.repair(s) for s in shapes])
    box = lambda x, y, w, h: [[np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float)]]
    assert area(union(box(0, 0, 2, 2), box(1, 1, 2, 2))) == pytest.approx(7)
    assert area(union(box(0, 0, 2, 2), box(0, 0, 2, 2))) == pytest.approx(4)  # one on the other
    side = union(box(0, 0, 1, 1), box(1, 0, 1, 1), box(0.5, 0.2, 0.2, 0.2))  # side by side, and one inside
    assert [len(p) for p in side] == [1] and area(side) == pytest.approx(2)
    frame_ = union(box(0, 0, 5, 1), box(0, 4, 5, 1), box(0, 0, 1, 5), box(4, 0, 1, 5))  # around a hole
    assert [len(p) for p in frame_] == [2] and area(frame_) == pytest.approx(16)
    assert area(union(frame_, box(2, 2, 1, 1), box(3, 3, 4, 4))) == pytest.approx(16 + 1 + 16 - 3)
    corners = union(box(0, 0, 1, 1), box(1, 1, 1, 1))
    assert len(corners) == 2 and area(corners) == pytest.approx(2)
    rng = np.random.default_rng(4)
    for _ in range(25):
        shapes = []
        for _ in range(rng.integers(2, 7)):  # stars around random places
            turn = np.sort(rng.uniform(0, 2 * np.pi, rng.integers(5, 12)))
            if np.diff(np.append(turn, turn[0] + 2 * np.pi)).max() <= 3:
                shapes.append([[rng.uniform(0, 2, 2) + rng.uniform(0.3, 1.2, len(turn))[:, None] * np.stack([np.cos(turn), np.sin(turn)], axis=1)]])
        if len(shapes) < 2:
            continue
        region = union(*shapes)
        if len(shapes) == 2:
            p, q = (s[0][0] for s in shapes)
            assert area(region) == pytest.approx(spatial._ring_area(p) + spatial._ring_area(q) - spatial.overlap_area(p, q))
        for spot in rng.uniform(-1, 3, (60, 2)):
            inside = any(overlay._around(p[0], spot) and not any(overlay._around(h, spot) for h in p[1:]) for p in region)
            assert inside == any(overlay._around(s[0][0], spot) for s in shapes)


def test_the_union_of_a_long_chain_is_linear():
    import time

    took = []
    for n in (1500, 15_000):
        x, y = np.arange(n) * 0.7, 0.3 * np.sin(np.arange(n) * 0.37)
        squares = [[[np.array([(a, b), (a + 1, b), (a + 1, b + 1), (a, b + 1)])]] for a, b in zip(x, y, strict=True)]
        start = time.perf_counter()
        region = overlay.united(squares)
        took.append(time.perf_counter() - start)
        want = n - 0.3 * (1 - np.abs(np.diff(y))).sum()
        assert [len(p) for p in region] == [1] and overlay._area(region[0][0]) == pytest.approx(want, rel=1e-9)
    assert took[1] < 40 * took[0]


def test_unions_of_regions_with_holes_by_neighbours(spark, monkeypatch):
    """A chain of frames in two components, many more than are united at a time."""
    monkeypatch.setattr(spatial, "_AT_A_TIME", 8)
    box = lambda x, y, w: [{"x": a, "y": b} for a, b in ((x, y), (x + w, y), (x + w, y + w), (x, y + w))]
    rows = [(i, [[box(3.0 * (i // 2), 50.0 * (i % 2), 4.0), box(3.0 * (i // 2) + 1, 50.0 * (i % 2) + 1, 1.0)]]) for i in range(300)]
    polygons = frame(spark, "id int, region array<array<array<struct<x:double,y:double>>>>", *rows).repartition(3)
    labels = frame(spark, "id int, component int", *[(i, i % 2) for i in range(300)])
    got = {r["component"]: r for r in spatial.union_components(polygons, labels, ring="region").collect()}
    for k in (0, 1):
        assert (got[k]["n"], got[k]["parts"]) == (150, 1) and got[k]["area"] == pytest.approx(4.0 * (3 * 149 + 4) - 150)
        assert len(got[k]["region"][0]) == 151 and len(got[k]["ring"]) == 4


def test_unions_of_components(spark, monkeypatch):
    monkeypatch.setattr(spatial, "_AT_A_TIME", 4)  # so that a component takes several rounds
    square = lambda x, y, w=1.0: [{"x": x, "y": y}, {"x": x, "y": y + w}, {"x": x + w, "y": y + w}, {"x": x + w, "y": y}]
    rows = [(i, square(i * 0.5, 0.0)) for i in range(30)] + [(50, square(0.0, 9.0)), (51, square(5.0, 9.0, 2.0)), (60, square(0.0, 0.0, 0.0))]
    polygons = frame(spark, "id int, ring array<struct<x:double,y:double>>", *rows)
    labels = frame(spark, "id int, component int", *[(i, 0) for i in range(30)], (50, 50), (51, 50), (60, 60))
    got = {r["component"]: r for r in spatial.union_components(polygons, labels).collect()}
    assert (got[0]["n"], got[0]["parts"]) == (30, 1) and got[0]["area"] == pytest.approx(15.5)
    assert (got[50]["n"], got[50]["parts"], got[50]["area"]) == (2, 2, pytest.approx(5.0)) and {p["x"] for p in got[50]["ring"]} == {5.0, 7.0}
    assert (got[60]["n"], got[60]["parts"], got[60]["area"]) == (1, 0, 0.0)


def test_components_of_string_ids(spark):
    """A shuffled path of 1,000 named nodes is one component."""
    names = [f"ls_{i:04d}" for i in range(1000)]
    order = np.random.default_rng(2).permutation(1000)
    edges = frame(spark, "a string, b string", *[(names[a], names[b]) for a, b in zip(order, order[1:], strict=False)])
    nodes = frame(spark, "id string", *[(n,) for n in [*names, "zz"]])
    got = {r["id"]: r["component"] for r in spatial.label_components(nodes, edges).collect()}
    assert got == {n: names[0] for n in names} | {"zz": "zz"}


def test_pixels_with_nulls_are_in_their_polygon(spark):
    ring = [{"x": float(x), "y": float(y)} for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]
    polygons = frame(spark, "ring array<struct<x:double,y:double>>", (ring,), (ring,))
    grid = frame(spark, "lon double, lat double, vel double, _in string", (0.6, 0.6, None, "mine"), (0.6, 0.6, None, "mine"), (0.5, 0.2, 1.0, None), (1.5, 0.5, None, None), (None, 0.5, 2.0, None))
    got = sorted(((r["lon"], r["lat"]), r["vel"], r["label"]) for r in spatial.polygon_mask(grid, polygons).collect() if r["lon"] is not None)
    assert [g[2] for g in got] == [1, 1, 1, 0] and spatial.polygon_mask(grid, polygons).filter("lon IS NULL").first()["label"] == 0


def test_covers_are_bounded_and_right():
    rng = np.random.default_rng(4)
    for size in (1e-6, 1.0, 1e6):
        for _ in range(12):
            turn = np.sort(rng.uniform(0, 2 * np.pi, rng.integers(3, 40)))
            ring = rng.uniform(-3, 3, 2) * size + size * rng.uniform(0.2, 1, len(turn))[:, None] * np.stack([np.cos(turn), np.sin(turn)], axis=1)
            squares = cover.cover([ring])
            edges = [s for s in squares if not s[3]]
            assert len({s[0] for s in edges}) <= 1 and len(edges) <= 4 * cover.BORDER and len(squares) <= 12 * cover.BORDER
            spots = ring.mean(axis=0) + rng.uniform(-1.2, 1.2, (400, 2)) * size
            held = cover._within(spots[:, 0], spots[:, 1], ring, np.roll(ring, -1, axis=0))
            seen = {s[:3]: s[3] for s in squares}
            for (x, y), inside in zip(spots.tolist(), held.tolist(), strict=True):
                met = [seen[k] for n in {s[0] for s in squares} if (k := (n, math.floor(x / 2.0**n), math.floor(y / 2.0**n))) in seen]
                assert len(met) <= 1 and (not inside or met) and (inside or met != [True])
    assert cover.cover([np.zeros((0, 2))]) == [] and cover.cover([np.array([(0.0, 0.0), (1.0, 1.0)])]) == []


def test_points_in_a_large_region_with_a_hole(spark):
    box = lambda x, y, w: [{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + w, y), (x + w, y + w), (x, y + w))]
    regions = frame(spark, "id int, region array<array<array<struct<x:double,y:double>>>>", (1, [[box(0, 0, 1000), box(100, 100, 500)]]), (2, [[box(150, 150, 0.01)]]), (3, None), (4, []))
    points = frame(spark, "p int, lon double, lat double, id string", (1, 50.0, 50.0, "a"), (2, 150.005, 150.005, "b"), (3, 601.0, 300.0, "c"), (4, None, 1.0, "d"), (5, -1.0, 5.0, "e"))
    got = cover.containment_join(points, regions.withColumnRenamed("id", "r"), ring="region").collect()
    assert sorted((r["p"], r["r"], r["id"]) for r in got) == [(1, 1, "a"), (2, 2, "b"), (3, 1, "c")]
    assert cover.containment_join(points, regions.withColumnRenamed("id", "r").limit(0), ring="region").count() == 0
    squares = regions.select("id", F.size(cover.region_cover("region")).alias("n")).collect()
    assert all(r["n"] < 12 * cover.BORDER for r in squares)


def test_nearest_other_pixel_near_and_lone(spark):
    rng = np.random.default_rng(9)
    rows = [(i % 3, i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 900, (90, 2)))] + [(0, 100 + i, 5.0 + i % 4, 5.0 + i // 4) for i in range(16)] + [(1, 200, 3.0, 3.0), (1, 201, 3.0, 3.0), (7, 300, 1.0, 1.0)]
    got = {r["c"]: (r["mean_nn"], r["n"]) for r in spatial.mean_nearest_distance(frame(spark, "c int, i int, x double, y double", *rows), ["c"]).collect()}
    for c in range(3):
        p = np.array([r[2:] for r in rows if r[0] == c])
        d = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1)) + np.diag([np.inf] * len(p))
        assert got[c] == (pytest.approx(d.min(axis=1).mean()), len(p))
    assert 7 not in got


def test_components_of_a_chain_from_its_far_end(spark):
    """0, n, n - 1, ..., 1: the least node meets the chain at its largest."""
    chain = [0, *range(300, 0, -1)]
    edges = spark.createDataFrame([*zip(chain, chain[1:], strict=False), (400, 401), (402, 999)], "a long, b long")
    got = {r["id"]: r["component"] for r in spatial.label_components(spark.range(405), edges).collect()}
    assert got == {i: 0 if i <= 300 else 400 if i == 401 else i for i in range(405)}


def test_rows_are_numbered_across_partitions(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS v").repartition(5)
    got = picks.number_rows(df, [F.col("v").desc()]).collect()
    assert all(r["number"] == 1000 - r["v"] for r in got) and len(got) == 1000
    assert picks.number_rows(df.limit(0), [F.col("v")]).count() == 0


def test_a_common_value_fills_many_ranges(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 0.0).otherwise(F.col("id").cast("double")).alias("v"), "id").repartition(5)
    seen = picks.number_rows(df, [F.col("v")])
    got = sorted((r["number"], r["v"]) for r in seen.collect())
    assert [n for n, _ in got] == list(range(1, 20_001)) and [v for _, v in got] == sorted(v for _, v in got)
    order = [F.col("v"), F.xxhash64("v", "id")]
    sizes = [r["n"] for r in df.repartitionByRange(4, *order).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 8000


def test_ranks_by_running_counts(spark):
    rng = np.random.default_rng(1)
    v = [None if x > 28 else float(x) for x in rng.integers(0, 30, 400)]
    df = frame(spark, "g int, v double, w double", *[(i % 3, x, float(i * 7 % 11)) for i, x in enumerate(v)]).repartition(6)
    got = stats.with_ranks(df, ["g"], "v", "rank").collect()
    assert len(got) == 400
    for g in range(3):
        own = [x for i, x in enumerate(v) if i % 3 == g and x is not None]
        for r in got:
            if r["g"] == g:
                assert r["rank"] == (None if r["v"] is None else sum(x < r["v"] for x in own) + (own.count(r["v"]) + 1) / 2)
    rho = {r["g"]: r["rho"] for r in stats.spearman_rho(df, ["g"], "v", "w").collect()}
    ranks = lambda a: np.array([(np.array(a) < x).sum() + (a.count(x) + 1) / 2 for x in a])
    for g in range(3):
        pairs = [(x, float(i * 7 % 11)) for i, x in enumerate(v) if i % 3 == g and x is not None]
        assert rho[g] == pytest.approx(np.corrcoef(ranks([p[0] for p in pairs]), ranks([p[1] for p in pairs]))[0, 1])


def test_groupings(spark):
    df = frame(spark, "i int, g string, v double, w double", (1, "a", 1.0, 5.0), (2, "b", 3.0, None), (3, None, None, 2.0))
    big = groups.by_strategies(df, {"one": F.col("g"), "two": F.when(F.col("v") > 2, "big")}, ["i"]).collect()
    assert sorted(map(tuple, big)) == [("one", "a", 1), ("one", "b", 2), ("two", "big", 2)]
    some = groups.in_subsets(df, {"low": F.col("v") < 4, "high": F.col("v") > 2}).select("i", "subset").collect()
    assert sorted(map(tuple, some)) == [(1, "low"), (2, "high"), (2, "low")]
    every = groups.with_superset(df, "g", "all", F.col("g") != "b").select("i", "g").collect()
    assert sorted(map(tuple, every)) == [(1, "a"), (1, "all"), (2, "b")]
    assert [r[0] for r in df.select(groups.side_of(F.col("v"), 2.0)).collect()] == ["coast", "inland", None]
    flags = groups.proximity(df, {"near_v": (F.col("v"), 1.0), "near_w": (F.col("w"), 5.0)}).select("near_v", "near_w", "both").collect()
    assert list(map(tuple, flags)) == [(True, True, True), (False, False, False), (False, True, False)]
    speeds = groups.velocities_by_category(df, "g", ["v", "w"], 2.0).collect()
    assert sorted((r["window"], str(r["g"]), r["n"], r["percent"], r["median"]) for r in speeds) == [("v", "b", 1, 100.0, 3.0), ("w", "None", 1, 50.0, 2.0), ("w", "a", 1, 50.0, 5.0)]


def test_polynomials_are_those_of_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 2, 2020 + float(t), float(np.sin(t) + 0.1 * e), None if i % 5 == 0 else float(t**2)) for i, (t, e) in enumerate(zip(rng.uniform(0, 3, 80), rng.normal(size=80), strict=True))]
    df = frame(spark, "g int, t double, y double, z double", *rows, (5, 1.0, 1.0, 1.0), (6, None, None, None))
    got = {r["g"]: r for r in fits.polynomial_rmse(df, ["g"], "t", ["y", "z"]).collect()}
    for g in range(2):
        for name, k in (("y", 2), ("z", 3)):
            t, v = np.array([(r[1], r[k]) for r in rows if r[0] == g and r[k] is not None]).T
            x = t - t.mean()
            want = np.sqrt(np.mean((np.polyval(np.polyfit(x, v, 4), x) - v) ** 2))
            assert got[g][f"rmse_{name}"] == pytest.approx(want, abs=1e-9)
    assert all(math.isnan(got[g][f"rmse_{c}"]) for g in (5, 6) for c in "yz")


def test_rejection_order(spark):
    args = [F.lit(True), F.lit(20), F.lit(0.9), F.lit(0.01), F.lit(1.0), F.lit(False)]
    assert spark.range(1).select(spatial.rejection(*args)).first()[0] == "Success"
    args[0] = F.lit(None).cast("boolean")
    assert spark.range(1).select(spatial.rejection(*args)).first()[0] == "no_valid_data"


def test_edge_box_corners_take_the_nearest_valid_pixel(spark):
    df = frame(spark, "b string, row int, col int, lon double, lat double", *[("a", r, c, None if r + c == 0 else float(c), float(-r)) for r in range(3) for c in range(3)])
    got = spatial.box_corners(df, ["b"], "edge").first()
    assert (got["tl_lon"], got["tl_lat"], got["br_lon"], got["br_lat"]) == (1.0, 0.0, 2.0, -2.0)


def test_operators_take_empty_input(spark):
    e = spark.createDataFrame([], "id int, t timestamp, v double, lo double, hi double")
    assert series.robust_outliers(e, ["id"], "t", "v", "lo", "hi").count() == 0
    assert series.interpolate(e, ["id"], "t", "v").count() == 0
    assert aggregates.regression(e, ["id"], "lo", "v").count() == 0
    assert aggregates.daily_fill(e.withColumn("d", F.col("t").cast("date")), ["id"], "d", "v").count() == 0
    assert stats.kruskal(e, ["id"], "hi", "v").count() == 0
    p = spark.createDataFrame([], "id int, lon double, lat double")
    assert joins.nearest_join(p, p.withColumnRenamed("id", "sid"), "id", "sid").count() == 0


def test_geodesic_known_lengths():
    from terrashift.operators.ellipsoid import inverse

    a, b, d = inverse(np.array([0.0, 0.0, 5.0, -71.117]), np.array([0.0, 0.0, 5.0, 42.25]), np.array([1.0, 0.0, 5.0, -123.683]), np.array([0.0, 1.0, 5.0, 45.517]))
    assert d[:3] == pytest.approx([111319.4908, 110574.3886, 0.0], abs=1e-3)
    assert a[0] == pytest.approx(90) and b[0] == pytest.approx(270) and a[1] == pytest.approx(0)
    c, e, f = inverse(np.array([-123.683]), np.array([45.517]), np.array([-71.117]), np.array([42.25]))
    assert d[3] == pytest.approx(f[0], abs=1e-4) and (a[3], b[3]) == pytest.approx((e[0], c[0]))


def test_geodesics_near_the_antipode():
    """Published lengths and azimuths; and halving agrees with the iteration where that settles."""
    lon1, lat1, lon2, lat2, want = np.array([(0, -30, 179.8, 29.9, 19989832.82761), (0, 0, 179.5, 0.5, 19936288.579), (0, 0, 179.7, 0.5, 19944127.421), (10, 40, -170, -40, 20003931.4586), (0, 90, 7, -90, 20003931.4586)], float).T
    there, back, length = ellipsoid.inverse(lon1, lat1, lon2, lat2)
    assert length == pytest.approx(want, abs=1e-3) and (there[0], back[0] - 180) == pytest.approx((161.89052473633, 18.09073724574), abs=1e-9)
    rng = np.random.default_rng(1)
    p = [rng.uniform(-180, 180, 300), rng.uniform(-89, 89, 300), rng.uniform(-180, 180, 300), rng.uniform(-89, 89, 300)]
    lines, halved = ellipsoid._Lines(*p), ellipsoid._Lines(*p)
    halved._halved(np.arange(300))
    assert halved.lengths() == pytest.approx(lines.lengths(), abs=1e-6) and halved.areas() == pytest.approx(lines.areas(), rel=1e-7, abs=1e5)
    assert np.abs(np.exp(1j * halved.azimuth2) - np.exp(1j * lines.azimuth2)).max() < 1e-7
    far = [p[0], p[1], p[0] + 180 + rng.uniform(-0.6, 0.6, 300), -p[1] + rng.uniform(-0.6, 0.6, 300)]
    assert ellipsoid.inverse(*far)[2] == pytest.approx(ellipsoid.inverse(*far[2:], *far[:2])[2], abs=1e-6)


def test_areas_of_geodesic_polygons(spark):
    from terrashift.operators.geodesy import region_size

    assert ellipsoid.WHOLE_AREA == pytest.approx(510065621724088.5, rel=1e-14)
    south = np.array([(-58, -63.1), (-74, -72.9), (-102, -71.9), (-102, -74.9), (-131, -74.3), (-163, -77.5), (163, -77.4), (172, -71.7), (140, -65.9), (113, -65.7), (88, -66.6), (59, -66.9), (25, -69.8), (-4, -70.0), (-14, -71.0), (-33, -77.3), (-46, -77.9), (-61, -74.7)], float)
    area, perimeter = ellipsoid.ring_area_perimeter(south)
    assert area == pytest.approx(13662703680020.1, rel=1e-12) and perimeter == pytest.approx(16831067.892793, abs=1e-5)
    assert ellipsoid.ring_area_perimeter(south[::-1])[0] == pytest.approx(-area, rel=1e-12)
    # a polygon and the two into which a diagonal cuts it, large and small, at a pole and across the date line
    for scale in (30.0, 1e-3):
        for lon, lat in ((-123.0, 40.0), (179.99, -10.0), (5.0, 59.0)):
            p = np.array([(0, 0), (1, 0.1), (1.1, 0.9), (-0.1, 1)]) * scale + [lon, lat]
            whole, first, second = (ellipsoid.ring_area_perimeter(q)[0] for q in (p, p[[0, 1, 2]], p[[0, 2, 3]]))
            assert whole > 0 and first + second == pytest.approx(whole, rel=1e-8)
    shape = lambda *corners: [{"x": float(x), "y": float(y)} for x, y in corners]
    box = lambda x, y, w: shape((x, y), (x + w, y), (x + w, y + w), (x, y + w))
    df = frame(spark, "i int, region array<array<array<struct<x:double,y:double>>>>", (1, [[box(0, 0, 1), box(0.25, 0.25, 0.5)]]), (2, None), (3, []))
    got = {r["i"]: r["s"] for r in df.select("i", region_size("region").alias("s")).collect()}
    outer, inner = (ellipsoid.ring_area_perimeter(np.array([(q["x"], q["y"]) for q in b])) for b in (box(0, 0, 1), box(0.25, 0.25, 0.5)))
    assert got[1]["area_m2"] == pytest.approx(outer[0] - inner[0]) and got[1]["perimeter_m"] == pytest.approx(outer[1] + inner[1]) and got[2] is None and got[3]["area_m2"] == 0


def test_nearest_segment_of_far_points(spark):
    from terrashift.operators.geodesy import nearest_segment

    p = frame(spark, "id int, x double, y double", (1, 0.0, 3.0), (2, 900.0, 900.0), (3, 2.0, -1.0))
    s = frame(spark, "line int, x1 double, y1 double, x2 double, y2 double", (7, 0.0, 0.0, 4.0, 0.0), (8, 0.0, 50.0, 0.0, 50.0))
    got = {r["id"]: (r["line"], r["distance"]) for r in nearest_segment(p, s, "id", "line").collect()}
    assert got[1] == (7, 3.0) and got[3] == (7, 1.0) and got[2][0] == 8 and got[2][1] == pytest.approx(math.hypot(900, 850))


def test_ranked_percentiles_are_those_of_numpy(spark):
    rng = np.random.default_rng(8)
    v = [*rng.integers(0, 30, 300).astype(float).tolist(), None]
    df = frame(spark, "g int, v double", *[(i % 3, x) for i, x in enumerate(v)], (9, 4.0)).repartition(6)
    shares = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.999, "e": 1.0}
    got = {r["g"]: r for r in aggregates.ranked_percentiles(df, ["g"], "v", shares).collect()}
    for g in range(3):
        own = [x for i, x in enumerate(v) if i % 3 == g and x is not None]
        assert [got[g][k] for k in shares] == pytest.approx([np.quantile(own, p) for p in shares.values()]) and got[g]["n"] == len(own)
    assert [got[9][k] for k in shares] == [4.0] * 5
    whole = aggregates.ranked_percentiles(df, [], "v", {"c": 0.5}).first()
    assert whole["c"] == pytest.approx(np.median([x for x in v if x is not None] + [4.0]))
    assert aggregates.ranked_percentiles(df.limit(0), [], "v", {"c": 0.5}).count() == 0
