"""Polygons and pixels: containment, clipping, overlap, metrics, clusters of pixels.

Polygons are arrays of structs (x, y). Geometry that has no column form runs in small numpy helpers
inside pandas functions; rows meet by grid cells, never by comparing all with all.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from terrashift.functions.geo import distance_m
from terrashift.operators.blocks import fits_a_block, in_blocks
from terrashift.operators.components import connected_components
from terrashift.operators.cover import containment_join
from terrashift.operators.ellipsoid import WGS84_A, WGS84_F, ring_area_perimeter
from terrashift.operators.joins import nearest_leaves
from terrashift.operators.overlay import as_region, outer_rings, region_area, region_bounds, repaired, union_of
from terrashift.operators.picks import kept

RING = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def with_bbox(df: DataFrame, ring: str = "ring") -> DataFrame:
    """Adds x0, x1, y0, y1 of each polygon."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return df.withColumns({"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)})


def polygon_mask(grid: DataFrame, polygons: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """``grid`` with label 1 for pixels in any polygon, else 0.

    Only positions are joined, so pixels keep whatever nulls they have and repeated pixels stay; one
    without a position lies in no polygon.
    """
    spots = grid.select(F.col(x).alias("_x"), F.col(y).alias("_y")).distinct()
    inside = containment_join(spots, polygons.select("ring"), "_x", "_y").select("_x", "_y").distinct()
    same = (F.col(f"g.`{x}`") == F.col("i._x")) & (F.col(f"g.`{y}`") == F.col("i._y"))
    return grid.drop("label").alias("g").join(inside.alias("i"), same, "left").select("g.*", F.col("i._x").isNotNull().cast("int").alias("label"))


def _ring_area(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return 0.5 * float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y))


def clip_convex(ring: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Part of a polygon inside a convex window: cut by one edge of the window after the other."""
    out = np.asarray(ring, float)
    window = window if _ring_area(window) > 0 else window[::-1]
    for a, b in zip(window, np.roll(window, -1, axis=0), strict=True):
        if not len(out):
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        kept = []
        for i in range(len(out)):
            j = (i + 1) % len(out)
            if side[i] >= 0:
                kept.append(out[i])
            if (side[i] >= 0) != (side[j] >= 0):
                kept.append(out[i] + (out[j] - out[i]) * side[i] / (side[i] - side[j]))
        out = np.array(kept).reshape(-1, 2)
    return out


def _bands(ring: np.ndarray, y: float) -> list[tuple[float, float]]:
    """Inside intervals of a polygon on a horizontal line."""
    a, b = ring, np.roll(ring, -1, axis=0)
    hit = (a[:, 1] > y) != (b[:, 1] > y)
    xs = np.sort(a[hit, 0] + (y - a[hit, 1]) * (b[hit, 0] - a[hit, 0]) / (b[hit, 1] - a[hit, 1]))
    return list(zip(xs[::2], xs[1::2], strict=True))


def overlap_area(p: np.ndarray, q: np.ndarray) -> float:
    """Area that two simple polygons share.

    Between two neighbouring heights of vertices or edge crossings the shared width changes
    linearly, so its values at two inner heights give the exact area of the strip.
    """
    heights = {*p[:, 1].tolist(), *q[:, 1].tolist()}
    for a, b in zip(p, np.roll(p, -1, axis=0), strict=True):
        c, d = q, np.roll(q, -1, axis=0)
        r, s = b - a, d - c
        det = r[0] * s[:, 1] - r[1] * s[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((c[:, 0] - a[0]) * s[:, 1] - (c[:, 1] - a[1]) * s[:, 0]) / det
            u = ((c[:, 0] - a[0]) * r[1] - (c[:, 1] - a[1]) * r[0]) / det
        ok = (det != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        heights.update((a[1] + t[ok] * r[1]).tolist())
    ys = sorted(heights)
    total = 0.0
    for low, high in zip(ys, ys[1:], strict=False):
        if high <= low:
            continue
        width = 0.0
        for share in (0.25, 0.75):
            y = low + share * (high - low)
            width += sum(max(0.0, min(e, g) - max(d, f)) for d, e in _bands(p, y) for f, g in _bands(q, y)) / 2
        total += width * (high - low)
    return total


def _hull(p: np.ndarray) -> np.ndarray:
    points = sorted(set(map(tuple, p.tolist())))
    if len(points) < 3:
        return np.array(points)

    def half(order: list) -> list:
        out: list = []
        for q in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(points) + half(points[::-1]))


METRICS = T.StructType(
    [
        T.StructField(name, T.DoubleType())
        for name in (
            "area_m2", "perimeter_m", "compactness", "max_diameter_m", "min_diameter_m", "axis_ratio", "orientation_deg", "hull_diameter_m", "center_lon", "center_lat",
        )
    ]
)


def ring_metrics(lonlat: np.ndarray) -> tuple[float, ...]:
    """Metrics of one polygon in degrees.

    Area and perimeter are those of the polygon of geodesics. Axes, diameter and centre are taken in a
    local plane scaled by the ellipsoid's radii of curvature at the polygon's middle.
    """
    p = lonlat[:-1] if len(lonlat) > 1 and (lonlat[0] == lonlat[-1]).all() else lonlat
    mid = math.radians(float(p[:, 1].mean()))
    e2 = WGS84_F * (2 - WGS84_F)
    w = math.sqrt(1 - e2 * math.sin(mid) ** 2)
    along, across = WGS84_A * (1 - e2) / w**3, WGS84_A / w * math.cos(mid)
    x0, y0 = p.mean(axis=0)
    xy = np.radians(p - [x0, y0]) * [across, along]
    area = _ring_area(xy)
    nxt = np.roll(xy, -1, axis=0)
    cross = xy[:, 0] * nxt[:, 1] - nxt[:, 0] * xy[:, 1]
    centre = ((xy + nxt) * cross[:, None]).sum(axis=0) / (6 * area) if area else np.zeros(2)
    hull = _hull(xy)
    best = (math.inf, 0.0, 0.0, 0.0)
    for a, b in zip(hull, np.roll(hull, -1, axis=0), strict=True):
        d = b - a
        if not (n := math.hypot(*d)):
            continue
        turned = hull @ np.array([[d[0], -d[1]], [d[1], d[0]]]) / n
        size = turned.max(axis=0) - turned.min(axis=0)
        if size[0] * size[1] < best[0]:
            direction = d if size[0] >= size[1] else np.array([-d[1], d[0]])
            best = (float(size[0] * size[1]), float(size.max()), float(size.min()), math.degrees(math.atan2(direction[0], direction[1])) % 180)
    spread = max((float(np.hypot(*(hull - h).T).max()) for h in hull), default=0.0)
    area, perimeter = ring_area_perimeter(p)
    area = abs(area)
    ratio = best[1] / best[2] if best[2] else math.nan
    compact = 4 * math.pi * area / perimeter**2 if perimeter else math.nan
    lon, lat = x0 + math.degrees(centre[0] / across), y0 + math.degrees(centre[1] / along)
    return area, perimeter, compact, best[1], best[2], ratio, best[3], spread, lon, lat


def _points(ring) -> np.ndarray:
    return np.array([(q["x"], q["y"]) for q in ring], float).reshape(-1, 2)


@F.pandas_udf(METRICS)
def polygon_metrics(rings: pd.Series) -> pd.DataFrame:
    names = METRICS.names
    rows = [ring_metrics(_points(r)) if r is not None and len(r) > 2 else (math.nan,) * len(names) for r in rings]
    return pd.DataFrame(rows, columns=names)


@F.pandas_udf(T.DoubleType())
def shared_area(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([overlap_area(_points(p), _points(q)) for p, q in zip(a, b, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def plane_area(a: pd.Series) -> pd.Series:
    return pd.Series([abs(_ring_area(_points(p))) for p in a], dtype=float)


@F.pandas_udf(RING)
def clip_to(rings: pd.Series, windows: pd.Series) -> pd.Series:
    return pd.Series([[{"x": x, "y": y} for x, y in clip_convex(_points(r), _points(w)).tolist()] for r, w in zip(rings, windows, strict=True)])


def _overlapping_shapes(polygons: DataFrame, ident: str, near: float, least_share: float, ring: str) -> tuple[DataFrame, DataFrame]:
    """(id, shape) of every polygon with a ring, and the pairs (a <= b) of shapes that overlap, with themselves too.

    A shape is a ring, however many polygons have it. Centres meet in grid cells of side ``near``, on a
    fixed number of tasks.
    """
    parts = int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = polygons.select(F.col(ident).alias("id"), F.col(ring).alias("ring")).filter("ring IS NOT NULL")
    p = kept(named.select("ring").distinct().withColumn("shape", F.monotonically_increasing_id()), "shapes")
    members = kept(named.join(p, "ring").select("id", "shape"), "members")
    p = with_bbox(p.repartition(parts).withColumn("area", plane_area("ring"))).withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2})
    p = kept(p, "shapes")
    cell = lambda c: F.floor(F.col(c) / near).cast("long")
    right = p.select(*[F.col(c).alias(f"r_{c}") for c in p.columns]).withColumns({"_i": F.floor(F.col("r_cx") / near).cast("long"), "_j": F.floor(F.col("r_cy") / near).cast("long")})
    left = p.withColumn("_i", F.explode(F.sequence(cell("cx") - 1, cell("cx") + 1))).withColumn("_j", F.explode(F.sequence(cell("cy") - 1, cell("cy") + 1)))
    close = F.hypot(F.col("cx") - F.col("r_cx"), F.col("cy") - F.col("r_cy")) <= near
    boxes = (F.col("x0") <= F.col("r_x1")) & (F.col("r_x0") <= F.col("x1")) & (F.col("y0") <= F.col("r_y1")) & (F.col("r_y0") <= F.col("y1"))
    pairs = left.join(right, ["_i", "_j"]).filter((F.col("shape") <= F.col("r_shape")) & close & boxes)
    enough = shared_area("ring", "r_ring") >= least_share * F.least("area", "r_area")
    return members, kept(pairs.repartition(parts).filter(enough).select(F.col("shape").alias("a"), F.col("r_shape").alias("b")), "overlaps")


def overlapping_pairs(polygons: DataFrame, ident: str, near: float, least_share: float = 0.3, ring: str = "ring") -> DataFrame:
    """(a, b) with a < b: centres within ``near`` (units of the rings) and a shared area of at least
    ``least_share`` of the smaller polygon.

    Only different rings are compared; the pairs of their copies are a plain join.
    """
    members, shapes = _overlapping_shapes(polygons, ident, near, least_share, ring)
    first = shapes.withColumnRenamed("a", "shape").join(members, "shape").select(F.col("id").alias("_a"), (F.col("shape") == F.col("b")).alias("_own"), F.col("b").alias("shape"))
    # a fixed number of tasks: a row becomes as many as its shape has copies
    parts = int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = first.repartition(parts).join(members, "shape").filter(F.when(F.col("_own"), F.col("_a") < F.col("id")).otherwise(F.col("_a") != F.col("id")))
    return both.select(F.least("_a", "id").alias("a"), F.greatest("_a", "id").alias("b"))


def overlapping_components(polygons: DataFrame, ident: str, near: float, least_share: float = 0.3, ring: str = "ring") -> DataFrame:
    """(id, component): the least id that each polygon reaches over :func:`overlapping_pairs`, without making the pairs of copies."""
    members, shapes = _overlapping_shapes(polygons, ident, near, least_share, ring)
    linked = connected_components(shapes, lambda df: kept(df, "components")).withColumnRenamed("node", "shape")
    # a shape without others is a component if it overlaps itself; one without an area or with odd corners may not
    own = shapes.filter("a = b").select(F.col("a").alias("shape"), F.col("a").alias("_self"))
    labels = own.join(linked, "shape", "full").select("shape", F.coalesce("component", "_self").alias("_group"))
    grouped = kept(members.join(labels, "shape").select("id", "_group"), "grouped")
    least = grouped.groupBy("_group").agg(F.min("id").alias("component"))
    found = grouped.join(least, "_group").groupBy("id").agg(F.min("component").alias("component"))
    return polygons.select(F.col(ident).alias("id")).join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def label_components(nodes: DataFrame, edges: DataFrame, ident: str = "id") -> DataFrame:
    """(id, component): the least id that each node reaches over edges (a, b); edges to other ids don't count.

    Rounds of large-star and small-star steps end when all components are stars, without a cap.
    Each round is written, which cuts the lineage.
    """
    ids = nodes.select(F.col(ident).alias("id"))
    inside = edges.select("a", "b").join(ids.select(F.col("id").alias("a")), "a", "left_semi").join(ids.select(F.col("id").alias("b")), "b", "left_semi")
    labels = connected_components(inside, lambda df: kept(df, "components")).withColumnRenamed("node", "id")
    return ids.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


#: Regions that are united in one go.
_AT_A_TIME = 64


def _curve_place(x: Column, y: Column) -> Column:
    """Place on a curve through a grid of 2^16 by 2^16 squares that keeps near squares together: bits of both in turn."""

    def spread(c: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            c = c.bitwiseOR(F.shiftleft(c, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return c

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def union_components(polygons: DataFrame, labels: DataFrame, ident: str = "id", ring: str = "ring") -> DataFrame:
    """(component, n, area, parts, ring, region) of polygons with labels (id, component): the union of each component.

    ``ring`` is a ring or a region of each polygon; the result's is the outer ring of the largest part,
    ``area`` that of all parts. Neighbours on a curve through the plane are united some tens at a time,
    so that their common edges go at once, in as many rounds as that takes: no component has to fit one
    task before it is united, and each round's work is that of the edges that are left. Polygons without
    an area count in ``n`` alone, and copies of a shape are united once.
    """
    is_region = isinstance(polygons.schema[ring].dataType.elementType, T.ArrayType)
    parts = int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = polygons.select(F.col(ident).alias("id"), F.col(ring).alias("_shape")).join(labels.select("id", "component"), "id")
    copies = kept(members.groupBy("component", "_shape").agg(F.count("*").alias("n")), "shapes")
    sizes = copies.groupBy("component").agg(F.sum("n").alias("n"))
    # a fixed number of tasks, as regions are much work for their bytes
    shapes = copies.repartition(parts).select("component", repaired(F.col("_shape") if is_region else as_region("_shape")).alias("region"))
    box = region_bounds("region")
    held = shapes.select("component", "region", ((box["x0"] + box["x1"]) / 2).alias("cx"), ((box["y0"] + box["y1"]) / 2).alias("cy"))
    held = kept(held, "regions")
    low = held.agg(F.min("cx").alias("x"), F.min("cy").alias("y"), F.greatest(F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy"), F.lit(1e-300)).alias("size")).first()
    square = lambda c, start: F.coalesce(F.floor((F.col(c) - F.lit(start or 0.0)) / F.lit(low["size"] or 1.0) * 65535), F.lit(0)).cast("long")
    held = held.select("component", "region", _curve_place(square("cx", low["x"]), square("cy", low["y"])).alias("place"))
    whole = False
    while not whole:
        whole = fits_a_block(held, ["component"], _AT_A_TIME)
        placed = held.withColumn("_block", F.lit(0).cast("long")) if whole else in_blocks(held, ["component"], [F.col("place")], _AT_A_TIME)
        grouped = placed.repartition(parts, "component", "_block").groupBy("component", "_block").agg(F.collect_list("region").alias("regions"), F.min("place").alias("place"))
        held = grouped.select("component", union_of("regions").alias("region"), "place")
        held = kept(held, "unions")
    shown = outer_rings(held, "region", "ring", largest=True)
    return shown.join(sizes, "component").select("component", "n", region_area("region").alias("area"), F.size("region").alias("parts"), "ring", "region")


def select_pixels(pixels: DataFrame, by: list[str], inner_m: float, outer_m: float, factor: float = 2.0, least_q95: int = 10) -> DataFrame:
    """Pixels (by, distance, vel) of each region's cluster, with its label, sign and background.

    The background lies beyond ``outer_m``. Inside ``inner_m`` pixels that differ from its median by
    more than ``factor`` deviations count; their median gives the sign. The cluster is what exceeds
    the 95th percentile of the signed difference, or the 75th if that is fewer than ``least_q95``.
    """
    p = pixels.filter(F.col("vel").isNotNull())
    ground = p.filter(F.col("distance") > outer_m).groupBy(*by).agg(F.median("vel").alias("bg_median"), F.stddev_pop("vel").alias("bg_std"))
    inside = p.filter(F.col("distance") < inner_m).join(ground, by)
    active = inside.filter(F.abs(F.col("vel") - F.col("bg_median")) > factor * F.col("bg_std"))
    turned = active.groupBy(*by).agg(F.signum(F.median(F.col("vel") - F.col("bg_median"))).alias("sign"))
    signed = active.join(turned, by).withColumn("rel", (F.col("vel") - F.col("bg_median")) * F.col("sign"))
    cuts = signed.groupBy(*by).agg(F.percentile("rel", F.array(F.lit(0.75), F.lit(0.95))).alias("_q"))
    marked = signed.join(cuts, by).withColumns({"above75": F.col("rel") > F.get("_q", F.lit(0)), "above95": F.col("rel") > F.get("_q", F.lit(1))})
    sizes = marked.groupBy(*by).agg(F.count_if("above75").alias("n_q75"), F.count_if("above95").alias("n_q95"))
    chosen = marked.join(sizes, by).withColumn("label", F.when(F.col("n_q95") >= least_q95, "q95").otherwise("q75"))
    return chosen.filter(F.when(F.col("label") == "q95", F.col("above95")).otherwise(F.col("above75"))).drop("_q", "above75", "above95")


def mean_nearest_distance(cluster: DataFrame, by: list[str], x: str = "x", y: str = "y", ident: str | None = None) -> DataFrame:
    """(by, mean_nn, n) over the pixels of each cluster, on a plane: the mean distance to the nearest other pixel.

    Places that several pixels share are 0 for each of them; the others are found by
    :func:`terrashift.operators.joins.nearest_leaves`. A cluster of one pixel gives no row. With ``ident``
    all places with the same value are one pixel, and the nearest one has another value.
    """
    if ident:
        spots = cluster.dropna(subset=[x, y, ident]).select(*by, F.col(ident).alias("_label"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).distinct()
        items = spots.groupBy(*by, F.col("_x").alias("_ox"), F.col("_y").alias("_oy")).agg(F.min("_label").alias("_la"), F.max("_label").alias("_lz"))
        met = nearest_leaves(spots, items, ["_x", "_y"], ["_ox", "_oy"], ["_ox", "_oy"], by, label="_label")
        gap = F.when((F.col("_la") != F.col("_label")) | (F.col("_lz") != F.col("_label")), F.hypot(F.col("_x") - F.col("_ox"), F.col("_y") - F.col("_oy")))
        return met.groupBy(*by, "_label").agg(F.min(gap).alias("d")).filter("d IS NOT NULL").groupBy(*by).agg(F.avg("d").alias("mean_nn"), F.count("*").alias("n"))
    spots = cluster.dropna(subset=[x, y]).groupBy(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(F.count("*").alias("_times"))
    items = spots.select(*by, F.col("_x").alias("_ox"), F.col("_y").alias("_oy"))
    met = nearest_leaves(spots, items, ["_x", "_y"], ["_ox", "_oy"], ["_ox", "_oy"], by, other=True)
    gap = F.hypot(F.col("_x") - F.col("_ox"), F.col("_y") - F.col("_oy"))
    near = met.groupBy(*by, "_x", "_y", "_times").agg(F.min(F.when(gap > 0, gap)).alias("d")).withColumn("d", F.when(F.col("_times") > 1, 0.0).otherwise(F.col("d")))
    return near.filter("d IS NOT NULL").groupBy(*by).agg((F.sum(F.col("d") * F.col("_times")) / F.sum("_times")).alias("mean_nn"), F.sum("_times").alias("n"))


def rejection(
    valid: Column, n_q75: Column, edge_share: Column, background: Column, spread: Column, skipped: Column,
    least_q75: int = 10, least_edge: float = 0.8, most_background: float = 0.015, most_spread: float = 2.0,
) -> Column:
    """The first reason that holds, in a fixed order, or Success."""
    return (
        F.when(~F.coalesce(valid, F.lit(False)), "no_valid_data")
        .when(F.coalesce(n_q75, F.lit(0)) == 0, "no_q75_pixels")
        .when(n_q75 < least_q75, "few_q75_pixels")
        .when(edge_share.isNull() | (edge_share < least_edge), "edge_of_frame")
        .when(background > most_background, "high_background_std")
        .when(spread > most_spread, "high_nn_scaled")
        .when(F.coalesce(skipped, F.lit(False)), "manual_skip")
        .otherwise("Success")
    )


def edge_share(pixels: Column, radius_m: Column, pixel_area: Column) -> Column:
    """Pixels there are, by the pixels that a full circle would hold."""
    return F.try_divide(pixels, F.try_divide(F.lit(math.pi) * radius_m * radius_m, pixel_area))


def box_corners(grid: DataFrame, by: list[str], how: str = "bbox", x: str = "lon", y: str = "lat") -> DataFrame:
    """Named corners of each box: of its bounding box, or the pixels nearest to the grid's own corners (needs row, col)."""
    if how == "bbox":
        lim = grid.groupBy(*by).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
        spot = {"tl": ("x0", "y1"), "tr": ("x1", "y1"), "bl": ("x0", "y0"), "br": ("x1", "y0")}
        return lim.select(*by, *[F.col(c).alias(f"{n}_{a}") for n, pair in spot.items() for a, c in zip(("lon", "lat"), pair, strict=True)])
    valid = grid.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    lim = grid.groupBy(*by).agg(F.max("row").alias("_r"), F.max("col").alias("_c"))
    placed = valid.join(lim, by)
    ring = {"tl": (F.lit(0), F.lit(0)), "tr": (F.lit(0), F.col("_c")), "bl": (F.col("_r"), F.lit(0)), "br": (F.col("_r"), F.col("_c"))}
    aggs = []
    for n, (r, c) in ring.items():
        far = F.greatest(F.abs(F.col("row") - r), F.abs(F.col("col") - c))  # the ring on which a pixel lies around that corner
        aggs.append(F.min_by(F.struct(F.col(x).alias("lon"), F.col(y).alias("lat")), F.struct(far, "row", "col")).alias(n))
    got = placed.groupBy(*by).agg(*aggs)
    return got.select(*by, *[F.col(f"{n}.{a}").alias(f"{n}_{a}") for n in ring for a in ("lon", "lat")])


def slope_aspect(grid: DataFrame, by: list[str], height: str, dx: float, dy: float, unit: str = "degrees") -> DataFrame:
    """Slope and downslope aspect (clockwise from north) by central differences; one-sided at the rim.

    ``row`` counts from the north, ``dx`` and ``dy`` are pixel sizes in the unit of height.
    """

    def gradient(line: str, order: str, step: float) -> Column:
        w = Window.partitionBy(*by, line).orderBy(order)
        back, ahead = F.lag(height).over(w), F.lead(height).over(w)
        return F.coalesce((ahead - back) / (2 * step), (ahead - F.col(height)) / step, (F.col(height) - back) / step, F.lit(0.0))

    east, south = gradient("row", "col", dx), gradient("col", "row", dy)
    flat = grid.withColumns({"_e": east, "_n": -south})
    slope = F.atan(F.hypot("_e", "_n"))
    aspect = F.when((F.col("_e") != 0) | (F.col("_n") != 0), F.pmod(F.degrees(F.atan2(-F.col("_e"), -F.col("_n"))), F.lit(360.0)))
    return flat.withColumns({"slope": F.degrees(slope) if unit == "degrees" else slope, "aspect": aspect}).drop("_e", "_n")


def great_circle_area(step_x: Column, step_y: Column, lon: Column, lat: Column) -> Column:
    """Area of one pixel from its two sides on the sphere."""
    return F.abs(distance_m(lon, lat, lon + step_x, lat) * distance_m(lon, lat, lon, lat + step_y))
