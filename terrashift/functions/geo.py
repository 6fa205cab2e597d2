"""Positions on the earth and in grids, and look directions of a radar."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean radius in metres; metres of a degree in the flat approximation.
EARTH_RADIUS_M, METRES_PER_DEGREE = 6_371_008.8, 111_000.0


def chord(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Straight distance of two points of the unit sphere."""
    xyz = lambda lon, lat: (F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat)))
    squares = [(a - b) * (a - b) for a, b in zip(xyz(lon1, lat1), xyz(lon2, lat2), strict=True)]
    return F.sqrt(squares[0] + squares[1] + squares[2])


def chord_to_metres(length: Column) -> Column:
    half = F.least(F.greatest(length / 2, F.lit(0.0)), F.lit(1.0))
    return 2 * F.asin(half) * EARTH_RADIUS_M


def distance_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres."""
    return chord_to_metres(chord(lon1, lat1, lon2, lat2))


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Direction from the first to the second point on the sphere, clockwise from north."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    y = F.sin(dl) * F.cos(p2)
    x = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def metres_to_degrees(metres: Column, lat: Column) -> Column:
    """Window size in degrees; the same for both axes, so a little wide in latitude."""
    return metres / (METRES_PER_DEGREE * F.cos(F.radians(lat)))


def cell_index(value: Column, origin: Column, step: Column) -> Column:
    """Nearest grid index, halves to even."""
    return F.rint((value - origin) / step).cast("long")


def closed_ring_wkt(points: list[tuple[Column, Column]]) -> Column:
    """POLYGON text of corner points, closed with the first."""
    texts = [F.concat_ws(" ", x.cast("string"), y.cast("string")) for x, y in [*points, points[0]]]
    return F.concat(F.lit("POLYGON(("), F.concat_ws(", ", *texts), F.lit("))"))


def point_in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule; ``ring``: array of structs (x, y), open or closed."""
    n = F.size(ring)

    def crosses(p: Column, i: Column) -> Column:
        q = F.get(ring, F.pmod(i + 1, n))
        at = p["x"] + F.try_divide((y - p["y"]) * (q["x"] - p["x"]), q["y"] - p["y"])
        return F.coalesce(((p["y"] > y) != (q["y"] > y)) & (x < at), F.lit(False))

    return F.aggregate(F.transform(ring, crosses), F.lit(False), lambda inside, c: inside != c)


def los_gain(incidence: Column, azimuth: Column, slope: Column, aspect: Column) -> Column:
    """Share of downslope motion that a radar with that look direction sees.

    Degrees; ``azimuth`` counter-clockwise from east, ``aspect`` clockwise from north.
    """
    inc, az, s = F.radians(incidence), F.radians(azimuth), F.radians(slope)
    down = F.radians(90 - aspect)
    east = -F.sin(inc) * F.sin(az) * F.cos(s) * F.cos(down)
    north = F.sin(inc) * F.cos(az) * F.cos(s) * F.sin(down)
    return east + north - F.cos(inc) * F.sin(s)


def los_to_downslope(los: Column, gain: Column, null_at_zero: bool = True) -> Column:
    """Where nothing is seen null, or what a division of doubles by this zero gives."""
    if null_at_zero:
        return F.try_divide(los, gain)
    sign = F.signum(los) * F.when(F.atan2(gain, F.lit(-1.0)) < 0, -1.0).otherwise(1.0)  # zeros have signs
    return F.when(gain == 0, F.when(los == 0, F.lit(math.nan)).otherwise(sign * F.lit(math.inf))).otherwise(F.try_divide(los, gain))


def downslope_to_los(value: Column, gain: Column, null_at_zero: bool = True) -> Column:
    return F.when(gain != 0, value * gain) if null_at_zero else value * gain


def look_sensitivity(azimuth: Column, heading_deg: float) -> Column:
    """How well motion in direction ``azimuth`` is seen from one heading: 1 along it, 0 across."""
    return F.abs(F.cos(F.radians(azimuth) - F.lit(math.radians(heading_deg))))
