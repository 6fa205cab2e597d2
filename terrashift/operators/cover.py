"""Points in polygons by hierarchical covers: squares inside need no test, those at the border meet the ring by its id.

A polygon is covered by squares of a quadtree whose sides are powers of two. It starts with the few
squares its box touches; those at its border are split until there are ``BORDER`` of them or more, those
inside stay as they are, those outside go. So a cover has about ``BORDER`` squares at the border and a
few inside for each of them and level, however large the polygon is. A point is keyed by the square it
lies in on each level that occurs: an equi-join, in which no ring is copied. Only points in squares at a
border are joined to the ring.

Polygons of up to ``FEW`` corners are tested as fast as they would be covered: the squares that their box
touches, some tens at most, are all taken for border, in columns without Python.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrashift.functions.geo import point_in_polygon
from terrashift.operators.picks import kept

#: Squares at the border at which a cover isn't refined further, and levels at most.
BORDER, LEVELS = 48, 24
#: Corners of a polygon that isn't worth a finer cover.
FEW = 32

_SQUARE = T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("i", T.LongType()), T.StructField("j", T.LongType()), T.StructField("inner", T.BooleanType())]))
_ARROW = pa.list_(pa.struct([("level", pa.int32()), ("i", pa.int64()), ("j", pa.int64()), ("inner", pa.bool_())]))


def _touched(i: np.ndarray, j: np.ndarray, side: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether any edge a -> b meets the closed square: their boxes meet, and its corners aren't all on one side of the edge."""
    x0, y0 = (i * side)[:, None], (j * side)[:, None]
    x1, y1 = x0 + side, y0 + side
    near = (np.minimum(a[:, 0], b[:, 0]) <= x1) & (np.maximum(a[:, 0], b[:, 0]) >= x0) & (np.minimum(a[:, 1], b[:, 1]) <= y1) & (np.maximum(a[:, 1], b[:, 1]) >= y0)
    square, edge = np.nonzero(near)
    d = b[edge] - a[edge]
    sides = [d[:, 0] * (y[square, 0] - a[edge, 1]) - d[:, 1] * (x[square, 0] - a[edge, 0]) for x in (x0, x1) for y in (y0, y1)]
    slack = 1e-12 * (np.abs(d).sum(axis=1)) * (np.abs(a[edge]).sum(axis=1) + side)
    apart = (np.minimum.reduce(sides) > slack) | (np.maximum.reduce(sides) < -slack)
    out = np.zeros(len(i), bool)
    out[square[~apart]] = True
    return out


def _within(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The even-odd rule."""
    y = y[:, None]
    crossed = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
    return (crossed & (x[:, None] < at)).sum(axis=1) % 2 == 1


def cover(rings: list[np.ndarray], border: int = BORDER) -> list[tuple[int, int, int, bool]]:
    """Squares (level, i, j, inner) of side 2^level that hold all that lies in an odd number of rings."""
    rings = [r for r in rings if len(r) > 2]
    if not rings:
        return []
    a, b = np.concatenate(rings), np.concatenate([np.roll(r, -1, axis=0) for r in rings])
    low, extent = a.min(axis=0), float(np.ptp(a, axis=0).max())
    smallest = math.frexp(float(np.abs(a).max()) or 1.0)[1] - 40  # finer ones than that aren't told apart well
    level = max(math.ceil(math.log2(extent)) if extent > 0 else smallest, smallest)
    first = np.floor(low / 2.0**level).astype(np.int64)
    i, j = (x.ravel() + f for x, f in zip(np.meshgrid([0, 1], [0, 1], indexing="ij"), first, strict=True))
    out = []
    for step in range(LEVELS + 1):
        side = 2.0**level
        edge = _touched(i, j, side, a, b)
        inner = ~edge & _within((i + 0.5) * side, (j + 0.5) * side, a, b)
        out += [(level, p, q, True) for p, q in zip(i[inner].tolist(), j[inner].tolist(), strict=True)]
        i, j = i[edge], j[edge]
        if len(i) >= border or step == LEVELS or level <= smallest:
            break
        level -= 1
        i, j = (np.repeat(2 * k, 4) + np.tile(s, len(k)) for k, s in ((i, [0, 0, 1, 1]), (j, [0, 1, 0, 1])))
    return out + [(level, p, q, False) for p, q in zip(i.tolist(), j.tolist(), strict=True)]


def _corners(ring) -> np.ndarray:
    p = np.array([(c["x"], c["y"]) for c in ring or () if c is not None and c["x"] is not None and c["y"] is not None], float).reshape(-1, 2)
    return p[np.isfinite(p).all(axis=1)]


@F.arrow_udf(_SQUARE)
def ring_cover(rings: pa.Array) -> pa.Array:
    return _squares([cover([_corners(r)]) for r in rings.to_pylist()])


@F.arrow_udf(_SQUARE)
def region_cover(regions: pa.Array) -> pa.Array:
    return _squares([cover([_corners(r) for p in region or () for r in p or ()]) for region in regions.to_pylist()])


def _squares(covers: list[list[tuple[int, int, int, bool]]]) -> pa.Array:
    return pa.array([[dict(zip(("level", "i", "j", "inner"), s, strict=True)) for s in c] for c in covers], _ARROW)


def _with_box_squares(df: DataFrame, corners: Column) -> DataFrame:
    """``df`` with ``_corners`` and ``_few``: the squares that the box of a few corners touches, of a side that gives some of them along the longer way.

    Each step is a column of its own, so that nothing is computed again for every square.
    """
    along = lambda axis: F.transform("_corners", lambda p: p[axis])
    df = df.withColumn("_corners", corners).withColumns({f"_{name}{a}": pick(along(a)) for a in "xy" for name, pick in (("low", F.array_min), ("high", F.array_max))})
    wide, tall = F.col("_highx") - F.col("_lowx"), F.col("_highy") - F.col("_lowy")
    reach = F.greatest(*[F.abs(f"_{side}{a}") for side in ("low", "high") for a in "xy"])
    level = F.ceil(F.log2(F.greatest(F.greatest(wide, tall) / 8, F.sqrt(wide * tall) / 2, reach * 2.0**-38, F.lit(1e-290)))).cast("int")
    df = df.withColumn("_level", level).withColumn("_side", F.pow(F.lit(2.0), F.col("_level")))
    index = lambda v: F.floor(F.col(v) / F.col("_side")).cast("long")
    df = df.withColumns({f"_{a}s": F.sequence(index(f"_low{a}"), index(f"_high{a}")) for a in "xy"})
    square = lambda i: F.transform("_ys", lambda j: F.struct(F.col("_level").alias("level"), i.alias("i"), j.alias("j"), F.lit(False).alias("inner")))
    few = F.when((F.size("_corners") > 2) & (F.size("_corners") <= FEW), F.flatten(F.transform("_xs", square)))
    return df.withColumn("_few", few).drop("_level", "_side", "_xs", "_ys", *[f"_{side}{a}" for side in ("low", "high") for a in "xy"])


def point_in_region(x: Column, y: Column, region: Column) -> Column:
    """Whether a point lies in an odd number of a region's rings: in a polygon and in none of its holes."""
    return F.aggregate(F.transform(F.flatten(region), lambda r: point_in_polygon(x, y, r)), F.lit(False), lambda inside, c: inside != c)


def containment_join(points: DataFrame, polygons: DataFrame, x: str = "lon", y: str = "lat", ring: str = "ring") -> DataFrame:
    """The columns of each point with those of every polygon that contains it, but the ring.

    ``ring`` is a ring or a region, see :mod:`terrashift.operators.overlay`; what is inside follows the
    even-odd rule. Polygons are written once with a number each. The levels that occur, some tens at
    most, come to the driver.
    """
    is_region = isinstance(polygons.schema[ring].dataType.elementType, T.ArrayType)
    rest = [c for c in polygons.columns if c != ring]
    corners = F.filter(F.flatten(F.flatten(ring)) if is_region else F.col(ring), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    # the Python function sees a ring only where it has many corners
    large = (region_cover if is_region else ring_cover)(F.when(F.size("_corners") > FEW, F.col(ring)))
    shaped = _with_box_squares(polygons.withColumn("_polygon", F.monotonically_increasing_id()), corners)
    squared = shaped.withColumn("_squares", F.when(F.size("_corners") > FEW, large).otherwise(F.col("_few")))
    numbered = kept(squared.drop("_corners", "_few"), "covers")
    squares = numbered.select(*rest, "_polygon", F.explode("_squares").alias("_s")).select(*rest, "_polygon", "_s.*").withColumnsRenamed({"level": "_level", "i": "_i", "j": "_j", "inner": "_inner"})
    levels = [r[0] for r in squares.select("_level").distinct().collect()]
    at = F.explode(F.array(*[F.struct(F.lit(n).alias("_level"), F.floor(F.col(x) / 2.0**n).cast("long").alias("_i"), F.floor(F.col(y) / 2.0**n).cast("long").alias("_j")) for n in sorted(levels)]))
    if not levels:
        return points.limit(0).join(polygons.drop(ring).limit(0), F.lit(True))
    # a fixed number of tasks: points are few bytes and meet many squares, each with a test
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = points.repartition(parts).select("*", at.alias("_at")).select(*[F.col(f"`{c}`") for c in points.columns], "_at.*")
    met = placed.join(squares, ["_level", "_i", "_j"]).drop("_level", "_i", "_j")
    shapes = numbered.select("_polygon", F.col(ring).alias("_ring"))
    holds = (point_in_region if is_region else point_in_polygon)(F.col(x), F.col(y), F.col("_ring"))
    at_border = met.filter(~F.col("_inner")).join(shapes, "_polygon").filter(holds).drop("_ring")
    return met.filter("_inner").unionByName(at_border).drop("_inner", "_polygon")
