"""Every plan that has SQL gives the rows that DuckDB gives."""

import glob
import math
import os

import numpy as np
import pytest

from terrashift.plans import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't there")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return "" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    mine = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert mine == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


@pytest.mark.parametrize("name", ["t150_pairwise"])
def test_rank_tests_use_all_orders(spark, duck, name):
    pairs = QUERIES[name](spark, DATA).collect()
    sizes = {(v, g): n for v, g, n in duck.sql("SELECT o_orderstatus, o_orderpriority, count(*) FROM orders GROUP BY ALL").fetchall()}
    assert pairs and all((p["n1"], p["n2"]) == (sizes[p["v"], p["g1"]], sizes[p["v"], p["g2"]]) for p in pairs)


def brute_fits(d, y, event):
    """The best of all combinations, with the break searched and with a fixed one and logarithms."""
    best, log_best = [], []
    for t1 in d[np.abs(d - event) <= 0.25]:
        pre = (d <= t1) & (d >= t1 - 1)
        if pre.sum() < 2 or (d >= t1).sum() < 2:
            continue
        k, y1 = np.polyfit(d[pre] - t1, y[pre], 1)
        for c in np.linspace(0.7, 1.0, 40):
            for beta in np.linspace(0.1, 2.0, 100):
                f = np.where(d < t1, k * (d - t1) + y1, c - (c - y1) * np.exp(-beta * np.maximum(d - t1, 0)))
                best.append((round(float(np.sqrt(np.mean((f - y) ** 2))), 12), t1, c, beta))
    s = d - event
    pre, post = (s < 0) & (s >= -0.8), s >= 0
    k, y1 = np.polyfit(s[pre], y[pre], 1)
    for c in np.linspace(0.6, 1.2, 61):
        ok = post & (c > y)
        if c <= y1 or ok.sum() < 2:
            continue
        slope, a = np.polyfit(s[ok], np.log(c - y[ok]), 1)
        f = np.where(s < 0, k * s + y1, c - np.exp(a + slope * s))
        log_best.append((round(float(np.sqrt(np.mean((f - y) ** 2))), 12), c, -slope))
    return min(best), min(log_best) if log_best else None


def test_fits_search_the_grids_of_the_survey(spark, monkeypatch):
    from terrashift.plans import timeseries

    t = np.arange(0, 4, 0.1)
    y = np.where(t < 1.5, 0.05 * t + 0.1, 0.87 - (0.87 - 0.175) * np.exp(-0.6 * (t - 1.5))) + 0.004 * np.sin(9 * t)
    fixture = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(t, y, strict=True)], "g string, t double, y double")
    monkeypatch.setattr(timeseries, "_curves", lambda spark, d: fixture)
    grid, logs = brute_fits(t, y, 1.52)
    got = QUERIES["c159_grid_fit"](spark, DATA).first()
    assert [got["rmse"], got["t1"], got["c"], got["beta"]] == pytest.approx(grid, abs=2e-6)
    got = QUERIES["c160_log_fit"](spark, DATA).first()
    assert [got["rmse"], got["c"], got["beta"]] == pytest.approx(logs, abs=2e-6)


def test_resampled_fits_and_draws_are_those_of_the_survey(spark, monkeypatch):
    from terrashift.operators import fits, stats

    seen, fit = [], fits.decay_grid_fit
    monkeypatch.setattr(fits, "decay_grid_fit", lambda c, by, t, y, e, betas, ends: seen.append((betas, ends)) or fit(c, by, t, y, e, betas[:2], ends[:2]))
    QUERIES["c162_resampled_fit"](spark, DATA)
    assert np.allclose(seen[0][0], np.linspace(0.1, 2.0, 100)) and np.allclose(seen[0][1], np.linspace(0.7, 1.0, 40))
    for name, plan in (("bootstrap_median_difference", "t151_bootstrap_seeded"), ("bootstrap_by_ranks", "t151_bootstrap")):
        monkeypatch.setattr(stats, name, lambda *a, draws, seed: (draws, seed))
        assert QUERIES[plan](spark, DATA) == (10_000, 123)


@pytest.fixture
def repeated(spark, duck, tmp_path):
    """Customers and suppliers 118,800 keys further on, where places and shapes repeat, and views of them."""

    def make(times):
        for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey")):
            sql = f"SELECT t.* REPLACE ({key} + 118800 * i AS {key}) FROM '{DATA}/{name}.parquet' t, range({times}) r(i)"
            duck.sql(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
        con = duck.cursor()
        for name in ("customer", "supplier"):
            con.sql(f"CREATE TEMP VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
        return str(tmp_path), con

    return make


def same_as_sql(name, spark, con, path):
    df, rel = QUERIES[name](spark, path), con.sql(ORACLES[name])
    columns = sorted(df.columns)
    mine = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    at = [rel.columns.index(c) for c in columns]
    return len(mine), mine == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", ["s051_containment", "s051_regions"])
def test_equal_shapes_meet_a_place_once(spark, repeated, monkeypatch, name):
    from terrashift.operators import cover

    seen, join = [], cover.containment_join
    monkeypatch.setattr(cover, "containment_join", lambda *a, **k: seen.append(join(*a, **k)) or seen[-1])
    path, con = repeated(1)
    QUERIES[name](spark, path)
    once = seen[-1].count()
    path, con = repeated(4)
    rows, same = same_as_sql(name, spark, con, path)
    assert same and rows > 0
    assert seen[-1].count() <= (once if name == "s051_containment" else 4 * once)


@pytest.mark.parametrize("name", ["s052_overlaps", "s136_clusters", "s136_unions"])
def test_equal_shapes_are_compared_once(spark, repeated, monkeypatch, name):
    from terrashift.operators import spatial

    seen, components = [], spatial.connected_components
    monkeypatch.setattr(spatial, "connected_components", lambda edges, keep: seen.append(edges.count()) or components(edges, keep))
    path, con = repeated(1)
    QUERIES[name](spark, path)
    path, con = repeated(3)
    rows, same = same_as_sql(name, spark, con, path)
    assert same and rows > 0
    assert len(set(seen)) == (0 if name == "s052_overlaps" else 1)  # no links of copies


@pytest.mark.parametrize("name", ["r014_repaired", "s034_overlay", "s034_remainders", "s034_clip", "s127_metrics", "s127_octants"])
def test_much_work_is_done_once_for_equal_values(spark, duck, repeated, monkeypatch, name):
    from terrashift.operators import overlay, picks

    seen, kept = {}, picks.kept
    for module in (picks, overlay):
        monkeypatch.setattr(module, "kept", lambda df, what: seen.update({what: kept(df, what)}) or seen[what])
    path, con = repeated(4)
    con.sql(f"CREATE TEMP VIEW region AS SELECT * FROM '{DATA}/region.parquet'")
    con.sql(f"COPY (SELECT * FROM region) TO '{path}/region.parquet' (FORMAT parquet)")
    if name in ORACLES:
        rows, same = same_as_sql(name, spark, con, path)
        assert same and rows > 0
    else:
        assert QUERIES[name](spark, path).count() == 4 * con.sql("SELECT count(DISTINCT c_custkey % 118800) FROM customer").fetchall()[0][0]
    done = seen["parts" if name == "s034_overlay" else "results"].count()
    assert 0 < done <= 150 * (5 if name == "s034_overlay" else 1)


def test_results_of_equal_values_join_back_with_nulls(spark):
    from pyspark.sql import functions as F

    from terrashift.operators.picks import once_each

    df = spark.range(40).select("id", F.when(F.col("id") % 4 > 0, F.array((F.col("id") % 4).cast("double"))).alias("v"))
    got = {r["id"]: (r["v"], r["n"]) for r in once_each(df, ["v"], n=F.coalesce(F.size("v"), F.lit(0)), v=F.concat("v", "v")).collect()}
    assert len(got) == 40 and got[5] == ([1.0, 1.0], 1) and got[4][0] is None


def test_curves_above_all_end_levels_give_no_row(spark, monkeypatch):
    from terrashift.plans import timeseries

    fixture = spark.createDataFrame([("g", i / 10, 5.0 + i / 100) for i in range(40)], "g string, t double, y double")
    monkeypatch.setattr(timeseries, "_curves", lambda spark, d: fixture)
    assert QUERIES["c160_log_fit"](spark, DATA).count() == 0


def from_range(duck, tmp_path, table, key, n):
    """``n`` rows of a table with keys from 0, its own rows repeated, in a folder and as a view."""
    duck.sql(f"COPY (SELECT t.* REPLACE (row_number() OVER () - 1 AS {key}) FROM '{DATA}/{table}.parquet' t, range({n}) LIMIT {n}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    con = duck.cursor()
    con.sql(f"CREATE TEMP VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    return con


def test_numbers_beyond_three_digits_are_those_of_sql(spark, duck, tmp_path):
    con = from_range(duck, tmp_path, "supplier", "s_suppkey", 1100)
    assert same_as_sql("p092_dense_ids", spark, con, str(tmp_path)) == (1100, True)


def test_a_gain_of_zero_is_divided_as_in_sql(spark, duck, tmp_path):
    con = duck.cursor()
    con.sql(f"COPY (SELECT * REPLACE (50 AS p_size, 5890 AS p_partkey) FROM '{DATA}/part.parquet' LIMIT 1) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con.sql(f"CREATE TEMP VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    assert same_as_sql("f124_look_gain", spark, con, str(tmp_path)) == (1, True)


def test_pixels_of_one_number_are_one(spark):
    from terrashift.operators.spatial import mean_nearest_distance

    rng = np.random.default_rng(3)
    rows = [(i % 2, i // 5, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(0, 90, (200, 2)))]
    got = {r["c"]: (r["mean_nn"], r["n"]) for r in mean_nearest_distance(spark.createDataFrame(rows, "c int, p int, x double, y double"), ["c"], ident="p").collect()}
    for c in (0, 1):
        own = [r for r in rows if r[0] == c]
        least = {}
        for a in own:
            least[a[1]] = min([least.get(a[1], math.inf), *(math.hypot(a[2] - b[2], a[3] - b[3]) for b in own if b[1] != a[1])])
        assert got[c] == (pytest.approx(np.mean(list(least.values()))), len(least))


@pytest.mark.parametrize("name", ["j042_nearest", "s025_nearest_line"])
def test_a_place_is_searched_once(spark, repeated, monkeypatch, name):
    from terrashift.operators import geodesy, joins

    seen, leaves = [], joins.nearest_leaves
    for module in (geodesy, joins):
        monkeypatch.setattr(module, "nearest_leaves", lambda targets, *a, **k: seen.append(targets.count()) or leaves(targets, *a, **k))
    for times in (1, 3):
        path, con = repeated(times)
        rows, same = same_as_sql(name, spark, con, path)
        assert same and rows == 150 * times
    assert name == "s025_nearest_line" or seen[0] == seen[1]
