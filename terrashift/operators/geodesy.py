"""Distances on the ellipsoid and to lines."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrashift.operators.ellipsoid import inverse, ring_area_perimeter
from terrashift.operators.joins import nearest_leaves
from terrashift.operators.overlay import _read

GEODESIC = T.StructType([T.StructField(n, T.DoubleType()) for n in ("azimuth", "back_azimuth", "distance_m")])


@F.pandas_udf(GEODESIC)
def geodesic(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(GEODESIC.names, inverse(*(s.to_numpy(float) for s in (lon1, lat1, lon2, lat2))), strict=True)))


_SIZE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("area_m2", "perimeter_m")])


@F.arrow_udf(_SIZE)
def region_size(regions: pa.Array) -> pa.Array:
    """Area on the ellipsoid and length of all rings of regions in degrees whose edges are geodesics; holes are taken off.

    For regions in simple rings, see :mod:`terrashift.operators.overlay`; null stays null.
    """

    def one(region) -> dict | None:
        if region is None:
            return None
        sizes = [(i, *ring_area_perimeter(r)) for p in _read(region) for i, r in enumerate(p)]
        return {"area_m2": float(sum(-abs(a) if i else abs(a) for i, a, _ in sizes)), "perimeter_m": float(sum(n for _, _, n in sizes))}

    return pa.array([one(r) for r in regions.to_pylist()], pa.struct([(n, pa.float64()) for n in _SIZE.names]))


def pixel_area(step_x: Column, step_y: Column, lon: Column, lat: Column) -> Column:
    """Area of one pixel in square metres from its two sides on the ellipsoid."""
    return F.abs(geodesic(lon, lat, lon + step_x, lat)["distance_m"] * geodesic(lon, lat, lon, lat + step_y)["distance_m"])


def segment_distance(x: Column, y: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Distance of a point and a segment in the plane."""
    dx, dy = x2 - x1, y2 - y1
    along = F.coalesce(F.try_divide((x - x1) * dx + (y - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    share = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    return F.hypot(x - x1 - share * dx, y - y1 - share * dy)


def nearest_segment(points: DataFrame, segments: DataFrame, ident: str, line: str) -> DataFrame:
    """(ident, line, distance): the nearest of the segments (line, x1, y1, x2, y2) to each point (ident, x, y), in plane units.

    Segments are found by their boxes, see :func:`terrashift.operators.joins.nearest_leaves`; of equal
    segments the smallest line is held, and points in the same place are one search. Cut long lines
    into short segments first.
    """
    ends = ("x1", "y1", "x2", "y2")
    held = segments.dropna(subset=list(ends)).groupBy(*ends).agg(F.min(line).alias(line))
    end = lambda pick, axis: pick(F.col(f"{axis}1"), F.col(f"{axis}2"))
    boxed = held.withColumns({f"_{name}{axis}": end(pick, axis) for name, pick in (("low", F.least), ("high", F.greatest)) for axis in "xy"})
    known = points.select(ident, "x", "y").dropna(subset=["x", "y"])
    met = nearest_leaves(known.select("x", "y").distinct(), boxed, ["x", "y"], ["_lowx", "_lowy"], ["_highx", "_highy"])
    gap = segment_distance(*[F.col(c) for c in ("x", "y", *ends)])
    found = met.groupBy("x", "y").agg(F.min(F.struct(gap.alias("d"), F.col(line))).alias("_b"))
    best = known.join(found, ["x", "y"]).groupBy(ident).agg(F.min("_b").alias("_b"))
    return best.select(ident, F.col(f"_b.{line}").alias(line), F.col("_b.d").alias("distance"))
