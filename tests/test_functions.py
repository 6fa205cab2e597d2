"""Literal cases of the column functions."""

import math

import pytest
from pyspark.sql import functions as F

from terrashift.functions import buckets, coerce, geo, ratio, time


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "want"), [("Yes", True), ("0", False), ("1.0", True), ("maybe", None), (None, None), (" OFF ", False), ("0.0", False)]
)
def test_to_bool(spark, text, want):
    assert one(spark, coerce.to_bool(F.lit(text).cast("string"))) is want


@pytest.mark.parametrize(("text", "want"), [("(0.02,)", 0.02), ("[0.5, 1]", 0.5), ("nan", None), ("None", None), ("7", 7.0), ("x", None), ("", None)])
def test_first_float(spark, text, want):
    assert one(spark, coerce.first_float(F.lit(text))) == want


def test_split_list(spark):
    assert one(spark, coerce.split_list(F.lit("a; b,c|d/e&f"))) == ["a", "b", "c", "d", "e", "f"]
    assert one(spark, coerce.split_list(F.lit(None).cast("string"))) == []


def test_resolve_column(spark):
    df = spark.range(1).selectExpr("id AS center_lon", "id AS y")
    assert coerce.resolve_column(df, ["lon", "center_lon"]) == "center_lon"
    assert coerce.resolve_column(df, ["nope"], part="LON") == "center_lon"
    with pytest.raises(KeyError):
        coerce.resolve_column(df, ["nope"])


@pytest.mark.parametrize(("day", "want"), [("2022-12-20", 2022.967123288), ("2024-02-29", 2024.161202186), ("2022-10-01", 2022.747945205)])
def test_decimal_year(spark, day, want):
    got = one(spark, time.to_decimal_year(F.lit(day).cast("timestamp")))
    assert got == pytest.approx(want, abs=1e-9)
    back = one(spark, time.from_decimal_year(F.lit(got)).cast("string"))
    assert back == f"{day} 00:00:00"


@pytest.mark.parametrize(("text", "want"), [("20220105", "2022-01-05"), ("2022-01-05", "2022-01-05"), ("2022-01-05T10:00:00", "2022-01-05"), ("x", None)])
def test_parse_date(spark, text, want):
    assert one(spark, time.parse_date(F.lit(text)).cast("string")) == want


def test_water_year(spark):
    assert one(spark, time.water_year(F.lit("2022-09-30").cast("date"))) == 2022
    assert one(spark, time.water_year(F.lit("2022-10-01").cast("date"))) == 2023


@pytest.mark.parametrize(("to", "want"), [((-123.99, 40.0), 851.803733), ((-124.0, 40.01), 1111.950802)])
def test_distance(spark, to, want):
    got = one(spark, geo.distance_m(F.lit(-124.0), F.lit(40.0), F.lit(to[0]), F.lit(to[1])))
    assert got == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize(
    ("slope", "aspect", "want"),
    [(0, 90, 0.521869), (0, 0, -0.092020), (90, 90, -0.848048), (60, 280, -0.999391), (30, 280, -0.882948), (15, 280, -0.731354), (30, 10, -0.424024), (30, 210, -0.580985)],
)
def test_look_gain(spark, slope, aspect, want):
    assert one(spark, geo.los_gain(F.lit(32.0), F.lit(-100.0), F.lit(float(slope)), F.lit(float(aspect)))) == pytest.approx(want, abs=1e-6)


def test_los_to_downslope(spark):
    g = geo.los_gain(F.lit(32.0), F.lit(-100.0), F.lit(30.0), F.lit(280.0))
    assert one(spark, geo.los_to_downslope(F.lit(-1.0), g)) == pytest.approx(1.132570, abs=1e-6)
    assert one(spark, geo.los_to_downslope(F.lit(-1.0), F.lit(0.0))) is None


@pytest.mark.parametrize(("angle", "want"), [(0, "N"), (22.4, "N"), (22.5, "NE"), (67.5, "E"), (180, "S"), (337.4, "NW"), (337.5, "N"), (-10, "N")])
def test_octant(spark, angle, want):
    assert one(spark, buckets.compass_octant(F.lit(float(angle)))) == want


@pytest.mark.parametrize(("angle", "want"), [(0, "NS"), (45, "NS"), (67.5, "EW"), (180, "NS"), (135, "EW"), (225, "NS"), (315, "NS")])
def test_axis(spark, angle, want):
    assert one(spark, buckets.axis_class(F.lit(float(angle)))) == want


@pytest.mark.parametrize(("aspect", "want"), [(9.9, -1), (10, 1), (190, 1), (190.1, -1), (370, 1)])
def test_expected_sign(spark, aspect, want):
    assert one(spark, buckets.expected_sign(F.lit(float(aspect)))) == want


@pytest.mark.parametrize(("new", "old", "want"), [(2.0, 1.0, 2.0), (3.0, 0.0, math.inf), (0.0, 0.0, 1.0), (None, 1.0, None)])
def test_safe_ratio(spark, new, old, want):
    assert one(spark, ratio.safe_ratio(F.lit(new).cast("double"), F.lit(old).cast("double"))) == want


@pytest.mark.parametrize(("new", "old", "want"), [(3.0, 2.0, 50.0), (3.0, 0.0, 100.0), (0.0, 0.0, 0.0)])
def test_percent_change(spark, new, old, want):
    assert one(spark, ratio.percent_change(F.lit(new), F.lit(old))) == want


@pytest.mark.parametrize(
    ("a", "b", "want"), [(1.0, 1.0, (None, None)), (1.0, 8.0, (4.0, "Faster")), (1.0, 8.1, (4.05, "Much Faster")), (10.0, 2.0, (0.2, "Much Slower")), (10.0, 8.4, (0.84, "Similar"))]
)
def test_guarded_ratio(spark, a, b, want):
    q = ratio.guarded_ratio(F.lit(a), F.lit(b), 2.0)
    got = spark.range(1).select(q.alias("q"), buckets.ratio_bucket(q).alias("c")).first()
    assert got["c"] == want[1] and (got["q"] is None if want[0] is None else got["q"] == pytest.approx(want[0]))


@pytest.mark.parametrize(("q", "want"), [(0.59, "Much Lower"), (0.6, "Lower"), (0.83, "Similar"), (1.2, "Similar"), (3.0, "Higher"), (3.1, "Much Higher")])
def test_shaking_bucket(spark, q, want):
    assert one(spark, buckets.shaking_bucket(F.lit(q))) == want


@pytest.mark.parametrize(("q", "want"), [(1.1, "Similar"), (1.5, "Higher"), (1.51, "Much Higher")])
def test_rain_bucket(spark, q, want):
    assert one(spark, buckets.rain_bucket(F.lit(q))) == want


@pytest.mark.parametrize(("q", "want"), [(2.49, "slump"), (2.5, "earthflow"), (4.5, "earthflow"), (4.51, "complex"), (math.nan, "unknown")])
def test_shape(spark, q, want):
    assert one(spark, buckets.shape_class(F.lit(q))) == want


def test_cell_index_rounds_half_to_even(spark):
    assert one(spark, geo.cell_index(F.lit(2.5), F.lit(0.0), F.lit(1.0))) == 2
    assert one(spark, geo.cell_index(F.lit(3.5), F.lit(0.0), F.lit(1.0))) == 4
