"""Properties that hold for any data, and independence of the partitioning."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrashift.functions import buckets
from terrashift.operators import aggregates, series, stats


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    rows = [(int(g), f"s{i}", int(t), float(v) if v > -2 else None) for i, (g, t, v) in enumerate(zip(rng.integers(0, 5, 800), rng.integers(0, 40, 800), rng.normal(size=800), strict=True))]
    return spark.createDataFrame(rows, "g int, s string, t int, v double").cache()


def rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_normalized_values_lie_in_the_unit_interval(data):
    got = series.normalize(data, ["g"], "v", "u").filter("u IS NOT NULL").agg(F.min("u"), F.max("u")).first()
    assert (got[0], got[1]) == (0.0, 1.0)


def test_running_sums_of_positive_values_rise(data):
    up = data.withColumn("w", F.abs("v")).withColumn("c", series.running_sum(["g"], "t", "w"))
    from pyspark.sql.window import Window

    falls = up.withColumn("b", F.lag("c").over(Window.partitionBy("g").orderBy("t", "c"))).filter("c < b - 1e-9")
    assert falls.count() == 0


def test_shares_sum_to_one_and_survive_folding(data):
    shares = aggregates.value_shares(data, F.col("s").substr(1, 2))
    for df in (shares, aggregates.fold_rare(shares, 0.12)):
        total = df.agg(F.sum("share"), F.sum("n")).first()
        assert total[0] == pytest.approx(1) and total[1] == 800


def test_every_finite_ratio_has_one_class(data):
    q = F.exp(F.col("v") * 2)
    got = data.filter("v IS NOT NULL").select(buckets.ratio_bucket(q).alias("c"), q.alias("q"))
    assert got.filter("c IS NULL").count() == 0
    ends = {r["c"]: (r["a"], r["b"]) for r in got.groupBy("c").agg(F.min("q").alias("a"), F.max("q").alias("b")).collect()}
    order = [ends[c] for c in buckets.RATE_LABELS if c in ends]
    assert all(x[1] < y[0] for x, y in zip(order, order[1:], strict=False))


def test_histogram_counts_every_value_once(data):
    inside = data.filter("v BETWEEN -2 AND 2").count()
    got = aggregates.histogram(data, "v", -2.0, 2.0, 16)
    assert got.count() == 16 and got.agg(F.sum("n")).first()[0] == inside


@pytest.mark.parametrize(
    "op",
    [
        lambda df: series.group_stack(df, "g", "s", "t", "v"),
        lambda df: stats.kruskal_h(df, ["t"], "g", "v", 3),
        lambda df: aggregates.median_deviation(df, ["g"], "v"),
        lambda df: aggregates.percentiles(df, ["g"], "v", {"a": 0.1, "b": 0.9}),
    ],
)
def test_partitioning_changes_nothing(data, op):
    assert rows(op(data.repartition(1))) == rows(op(data.repartition(13)))


def test_ranks_sum_to_the_triangle_number(data):
    used = data.filter("v IS NOT NULL").withColumn("v", F.round("v", 1))
    got = stats.with_ranks(used, ["g"], "v", "r").groupBy("g").agg(F.sum("r").alias("r"), F.count("*").alias("n"))
    assert all(math.isclose(x["r"], x["n"] * (x["n"] + 1) / 2) for x in got.collect())
