"""Regions with holes and several parts: repair of self-crossing rings, and overlay of any two regions.

A region is an array of polygons, a polygon an array of rings, its outer one first, a ring an array of
structs (x, y), open or closed. What lies inside a polygon is what its outer ring winds around, either
way, and none of its holes does; a region is all of its polygons together.

Both operators lay out the edges as a planar arrangement: edges are cut where they meet, pieces that lie
on each other become one, and each piece learns how often every ring winds around either of its sides.
A piece is on the result's outline if just one side is in the result. Outlines are linked with the inside
to the left and parted where they touch themselves, so that rings are simple; counter-clockwise ones are
outer rings, the others go to the smallest outer ring around them.

Regions are worked on a row at a time in Arrow functions; area, perimeter and bounds are columns without
Python.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrashift.operators.picks import kept

_POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
REGION = T.ArrayType(T.ArrayType(T.ArrayType(_POINT)))
_ARROW = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))

#: Places that are closer than this share of the extent are one.
NEAR = 1e-12
#: Pairs of edges, or of edges and rays, that are looked at together.
_PAIRS = 2_000_000


def _pieces(a: np.ndarray, b: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and original edges of all edges, cut where they cross, touch or overlap others; which starts and ends are corners.

    Edges are ordered along the longer side of all, so that each meets only those that begin before it ends.
    """
    low, high = np.minimum(a, b) - near, np.maximum(a, b) + near
    along = int(np.ptp(a[:, 1]) > np.ptp(a[:, 0]))
    across = 1 - along
    order = np.argsort(low[:, along], kind="stable")
    a, b, low, high = a[order], b[order], low[order], high[order]
    last = np.searchsorted(low[:, along], high[:, along], side="right")
    count = last - np.arange(len(a)) - 1
    d = b - a
    length = np.hypot(d[:, 0], d[:, 1])
    at_edge, at_share = [], []
    starts = np.concatenate(([0], np.cumsum(count)))
    row = 0
    while row < len(a):
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + _PAIRS, side="right")) - 1)
        i = np.repeat(np.arange(row, end), count[row:end])
        j = i + 1 + np.arange(len(i)) - np.repeat(starts[row:end] - starts[row], count[row:end])
        row = end
        meet = (low[i, across] <= high[j, across]) & (low[j, across] <= high[i, across])
        i, j = i[meet], j[meet]
        det = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
        gap = a[j] - a[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (gap[:, 0] * d[j, 1] - gap[:, 1] * d[j, 0]) / det
            u = (gap[:, 0] * d[i, 1] - gap[:, 1] * d[i, 0]) / det
        slack_i, slack_j = near / length[i], near / length[j]
        # edges that stay nearer than that along the shorter one run along each other
        cross = (np.abs(det) > near * np.maximum(length[i], length[j])) & (t >= -slack_i) & (t <= 1 + slack_i) & (u >= -slack_j) & (u <= 1 + slack_j)
        at_edge += [i[cross], j[cross]]
        at_share += [t[cross], u[cross]]
        # ends of one that lie on the other
        for one, other in ((i, j), (j, i)):
            for p in (a, b):
                away = p[other] - a[one]
                share = (away * d[one]).sum(axis=1) / length[one] ** 2
                off = np.abs(away[:, 0] * d[one, 1] - away[:, 1] * d[one, 0]) / length[one]
                on = (off <= near) & (share > 0) & (share < 1)
                at_edge.append(one[on])
                at_share.append(share[on])
    edge = np.concatenate([np.arange(len(a)), np.arange(len(a)), *at_edge]).astype(np.int64)
    share = np.clip(np.concatenate([np.zeros(len(a)), np.ones(len(a)), *at_share]), 0, 1)
    by = np.lexsort((share, edge))
    edge, share = edge[by], share[by]
    spots = np.where((share == 1)[:, None], b[edge], a[edge] + share[:, None] * d[edge])
    same = edge[1:] == edge[:-1]
    corner = (share == 0) | (share == 1)
    return spots[:-1][same], spots[1:][same], order[edge[:-1][same]], np.concatenate([corner[:-1][same], corner[1:][same]])


def _nodes(points: np.ndarray, corner: np.ndarray, near: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of places, and where each is: coordinates that are near are one, that of a corner if there is one.

    So level pieces are exactly level.
    """
    snapped = np.empty_like(points)
    for axis in (0, 1):
        order = np.argsort(points[:, axis], kind="stable")
        values = points[order, axis]
        first = np.concatenate(([True], np.diff(values) > 4 * near))
        group, stands = np.cumsum(first) - 1, values[first].copy()
        stands[group[corner[order]]] = values[corner[order]]
        snapped[order, axis] = stands[group]
    places, number = np.unique(snapped, axis=0, return_inverse=True)
    return number.ravel(), places


def _windings(u: np.ndarray, v: np.ndarray, net: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each ring winds around the left and the right side of every piece u -> v.

    ``net``: for each piece and ring, how often the ring runs along it less how often against it. A ray
    from the middle of a piece to the right sees what is to the right of a piece that goes up; one from
    a level piece, taken a little above it, what is to the left of one that goes right. Rays run along
    the shorter side of all, and meet only pieces of their own strip.
    """
    if np.ptp(u[:, 0]) > np.ptp(u[:, 1]):  # seen in a mirror all turns are the other way
        left, right = _windings(u[:, ::-1], v[:, ::-1], net)
        return -right, -left
    down = (v[:, 1] < u[:, 1]) | ((v[:, 1] == u[:, 1]) & (v[:, 0] < u[:, 0]))
    low, high = np.where(down[:, None], v, u), np.where(down[:, None], u, v)
    upward = np.where(down[:, None], -net, net)
    middle = (low + high) / 2
    slope = np.divide(high[:, 0] - low[:, 0], high[:, 1] - low[:, 1], out=np.zeros(len(u)), where=high[:, 1] != low[:, 1])
    # pieces by the strips that they cross
    base, strips = low[:, 1].min(), len(u)
    width = (high[:, 1].max() - base) / strips or 1.0
    strip = lambda y: np.clip(((y - base) / width).astype(np.int64), 0, strips - 1)
    rising = np.flatnonzero(high[:, 1] > low[:, 1])
    first, last = strip(low[rising, 1]), strip(high[rising, 1])
    count = last - first + 1
    piece = np.repeat(rising, count)
    at = np.repeat(first, count) + np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
    piece = piece[np.argsort(at, kind="stable")]
    starts = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=strips))))
    own = strip(middle[:, 1])
    meets = starts[own + 1] - starts[own]
    seen = np.zeros(net.shape, np.int64)
    before = np.concatenate(([0], np.cumsum(meets)))
    row = 0
    while row < len(u):
        end = max(row + 1, int(np.searchsorted(before, before[row] + _PAIRS, side="right")) - 1)
        i = np.repeat(np.arange(row, end), meets[row:end])
        j = piece[np.repeat(starts[own[row:end]], meets[row:end]) + np.arange(len(i)) - np.repeat(before[row:end] - before[row], meets[row:end])]
        row = end
        y = middle[i, 1]
        right = (low[j, 1] <= y) & (high[j, 1] > y) & (i != j)
        i, j, y = i[right], j[right], y[right]
        right = low[j, 0] + (y - low[j, 1]) * slope[j] > middle[i, 0]
        np.add.at(seen, i[right], upward[j[right]])
    level = (low[:, 1] == high[:, 1])[:, None]
    left, right = np.where(level, seen, seen + upward), np.where(level, seen - upward, seen)
    return np.where(down[:, None], right, left), np.where(down[:, None], left, right)


def _linked(u: np.ndarray, v: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """Simple rings of directed pieces u -> v (numbers of places), what is inside to their left."""
    d = places[v] - places[u]
    turn = np.arctan2(d[:, 1], d[:, 0])
    leaving: dict[int, list[int]] = {}
    for e in np.lexsort((turn, u)).tolist():
        leaving.setdefault(int(u[e]), []).append(e)
    used, rings = np.zeros(len(u), bool), []
    for first in range(len(u)):
        if used[first]:
            continue
        walk, held, e = [], {}, first
        while not used[e]:
            used[e] = True
            n = int(u[e])
            if n in held:  # the walk touches itself: the loop is a ring of its own
                loop = walk[held[n] :]
                for k in loop:
                    del held[k]
                del walk[len(walk) - len(loop) :]
                rings.append(loop)
            held[n] = len(walk)
            walk.append(n)
            back = (turn[e] + math.pi) % (2 * math.pi)
            ways = [w for w in leaving.get(int(v[e]), ()) if not used[w]]
            if not ways:
                break
            e = min(ways, key=lambda w: (back - turn[w]) % (2 * math.pi) or 2 * math.pi)  # the sharpest turn to the left
        rings.append(walk)
    return [places[r] for r in rings if len(r) > 2]


def _area(p: np.ndarray) -> float:
    x, y = (p - p[0]).T
    return 0.5 * float(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y))


def _straightened(p: np.ndarray, near: float) -> np.ndarray:
    """A ring without corners that lie on the line between their neighbours."""
    before, after = p - np.roll(p, 1, axis=0), np.roll(p, -1, axis=0) - p
    off = np.abs(before[:, 0] * after[:, 1] - before[:, 1] * after[:, 0])
    bent = off > near * (np.hypot(*before.T) + np.hypot(*after.T)) / 4
    return p[bent] if bent.sum() > 2 else p


def _around(p: np.ndarray, spot: np.ndarray) -> bool:
    q = np.roll(p, -1, axis=0)
    hit = (p[:, 1] > spot[1]) != (q[:, 1] > spot[1])
    x = p[hit, 0] + (spot[1] - p[hit, 1]) * (q[hit, 0] - p[hit, 0]) / (q[hit, 1] - p[hit, 1])
    return bool((x > spot[0]).sum() % 2)


def _polygons(rings: list[np.ndarray]) -> list[list[np.ndarray]]:
    """Outer rings, the largest first, each followed by its holes."""
    sized = sorted(((_area(r), r) for r in rings), key=lambda x: (-abs(x[0]), x[1].tolist()))
    outer = [(s, r) for s, r in sized if s > 0]
    out = [[r] for _, r in outer]
    for s, r in sized:
        if s < 0:
            spot = (r[0] + r[1]) / 2
            inside = [i for i, (_, o) in enumerate(outer) if _around(o, spot)]
            if inside:
                out[inside[-1]].append(r)
    return out


def arranged(regions: list[list[list[np.ndarray]]], rule: Callable[[list[np.ndarray]], np.ndarray]) -> list[list[np.ndarray]]:
    """The polygons of what ``rule`` says lies inside, from whether a place lies in each of the regions."""
    rings, owner, is_hole, region = [], [], [], []
    polygon = 0
    for k, polygons in enumerate(regions):
        for p in polygons:
            for i, r in enumerate(p):
                r = r[(r != np.roll(r, 1, axis=0)).any(axis=1)] if len(r) else r
                if len(r) > 2:
                    rings.append(r)
                    owner.append(polygon)
                    is_hole.append(i > 0)
                    region.append(k)
            polygon += 1
    if not rings:
        return []
    owners, hole, of = np.array(owner), np.array(is_hole), np.array(region)

    def inside(winding: np.ndarray) -> np.ndarray:
        held = [np.zeros(len(winding), bool) for _ in regions]
        for n in np.unique(owners):
            own = owners == n
            within = (winding[:, own & ~hole] != 0).any(axis=1) & ~(winding[:, own & hole] != 0).any(axis=1)
            held[of[own][0]] |= within
        return rule(held)

    return _outlined(rings, np.arange(len(rings)), inside)


def united(regions: list[list[list[np.ndarray]]]) -> list[list[np.ndarray]]:
    """The union of any number of regions in simple rings, outer ones counter-clockwise, holes clockwise.

    All rings together wind around a place once for each region that holds it, so one number a side is
    enough, however many regions there are.
    """
    rings = [r for polygons in regions for p in polygons for r in p if len(r) > 2]
    return _outlined(rings, np.zeros(len(rings), np.int64), lambda winding: winding[:, 0] > 0) if rings else []


def _outlined(rings: list[np.ndarray], kind: np.ndarray, inside: Callable[[np.ndarray], np.ndarray]) -> list[list[np.ndarray]]:
    """The polygons of the places that ``inside`` says are, from how often the rings of each kind wind around them."""
    a, b = np.concatenate(rings), np.concatenate([np.roll(r, -1, axis=0) for r in rings])
    net = np.zeros((len(a), int(kind.max()) + 1), np.int64)
    net[np.arange(len(a)), np.repeat(kind, [len(r) for r in rings])] = 1
    middle = (a.min(axis=0) + a.max(axis=0)) / 2  # so that no digits are lost far from the origin
    near = NEAR * (float(np.ptp(a, axis=0).max()) or 1.0)
    a, b, known = a - middle, b - middle, -1
    while len(a) != known:  # places move a little as they become one; what then meets is cut again
        known = len(a)
        start, end, edge, corner = _pieces(a, b, near)
        number, places = _nodes(np.concatenate([start, end]), corner, near)
        u, v = number[: len(start)], number[len(start) :]
        real = u != v
        u, v, along = u[real], v[real], net[edge[real]]
        # one piece for those that lie on each other; those whose rings run both ways alike are none
        turned = u > v
        pairs, which = np.unique(np.where(turned, v, u) * len(places) + np.where(turned, u, v), return_inverse=True)
        net = np.zeros((len(pairs), net.shape[1]), np.int64)
        np.add.at(net, which, np.where(turned[:, None], -along, along))
        low, high = pairs // len(places), pairs % len(places)
        some = net.any(axis=1)
        low, high, net = low[some], high[some], net[some]
        a, b, spots = places[low], places[high], np.concatenate([start, end])
        if not len(a):
            return []
        if (places[number] == spots).all():  # nothing moved
            break
    left, right = _windings(a, b, net)
    to_left, to_right = inside(left), inside(right)
    along, against = to_left & ~to_right, to_right & ~to_left
    outline = _linked(np.concatenate([low[along], high[against]]), np.concatenate([high[along], low[against]]), places)
    return [[r + middle for r in p] for p in _polygons([_straightened(r, near) for r in outline])]


def repair(region: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
    return arranged([region], lambda held: held[0])


@F.arrow_udf(REGION)
def union_of(many: pa.Array) -> pa.Array:
    """The union of an array of regions as :func:`repaired` gives them; null ones don't count."""
    return pa.array([_shown(united([_read(r) for r in regions or () if r is not None])) for regions in many.to_pylist()], _ARROW)


_RULES = {
    "intersection": lambda held: held[0] & held[1],
    "union": lambda held: held[0] | held[1],
    "difference": lambda held: held[0] & ~held[1],
    "symmetric": lambda held: held[0] ^ held[1],
}


def _read(region) -> list[list[np.ndarray]]:
    """Polygons of finite corners; a null ring or corner is none."""
    out = []
    for polygon in () if region is None else region:
        rings = []
        for ring in () if polygon is None else polygon:
            p = np.array([(c["x"], c["y"]) for c in ring if c is not None and c["x"] is not None and c["y"] is not None] if ring is not None else [], float).reshape(-1, 2)
            rings.append(p[np.isfinite(p).all(axis=1)])
        out.append(rings)
    return out


def _shown(region: list[list[np.ndarray]]) -> list:
    return [[[{"x": x, "y": y} for x, y in ring.tolist()] for ring in polygon] for polygon in region]


@F.arrow_udf(REGION)
def repaired(regions: pa.Array) -> pa.Array:
    """The same region in simple rings, outer ones counter-clockwise; null stays null, one without an area becomes empty."""
    return pa.array([None if r is None else _shown(repair(_read(r))) for r in regions.to_pylist()], _ARROW)


def overlay(a: Column | str, b: Column | str, how: str = "intersection") -> Column:
    """Intersection, union, difference (a without b) or symmetric difference of two regions; null if either is."""
    rule = _RULES[how]

    @F.arrow_udf(REGION)
    def laid(left: pa.Array, right: pa.Array) -> pa.Array:
        pairs = zip(left.to_pylist(), right.to_pylist(), strict=True)
        return pa.array([None if p is None or q is None else _shown(arranged([_read(p), _read(q)], rule)) for p, q in pairs], _ARROW)

    return laid(a, b)


def as_region(ring: Column | str) -> Column:
    """A single ring as a region."""
    return F.array(F.array(F.col(ring) if isinstance(ring, str) else ring))


def ring_area(ring: Column) -> Column:
    """Signed area of a ring, counter-clockwise above 0; null for one without corners."""
    n, origin = F.size(ring), F.get(ring, F.lit(0))

    def part(p: Column, i: Column) -> Column:
        q = F.get(ring, F.pmod(i + 1, n))
        return ((p["x"] - origin["x"]) * (q["y"] - origin["y"]) - (q["x"] - origin["x"]) * (p["y"] - origin["y"])) / 2

    return F.aggregate(F.transform(ring, part), F.lit(0.0), lambda s, v: s + v)


def region_area(region: Column | str) -> Column:
    """Area of a region in simple rings, as :func:`repaired` and :func:`overlay` give it: holes count below 0."""
    col = F.col(region) if isinstance(region, str) else region
    sizes = F.transform(F.flatten(col), ring_area)
    return F.aggregate(sizes, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def region_perimeter(region: Column | str) -> Column:
    """Length of all rings of a region."""
    col = F.col(region) if isinstance(region, str) else region

    def length(ring: Column) -> Column:
        to_next = lambda p, i: F.hypot(F.get(ring, F.pmod(i + 1, F.size(ring)))["x"] - p["x"], F.get(ring, F.pmod(i + 1, F.size(ring)))["y"] - p["y"])
        return F.aggregate(F.transform(ring, to_next), F.lit(0.0), lambda s, v: s + v)

    return F.aggregate(F.transform(F.flatten(col), length), F.lit(0.0), lambda s, v: s + v)


def outer_rings(df: DataFrame, region: str = "region", ring: str = "ring", largest: bool = False) -> DataFrame:
    """A row for each polygon's outer ring, or with ``largest`` only for that of the largest polygon."""
    parts = F.transform(region, lambda p: F.get(p, F.lit(0)))
    if largest:
        size = lambda p: F.aggregate(F.transform(p, ring_area), F.lit(0.0), lambda s, v: s + v)
        best = F.array_max(F.transform(region, lambda p: F.struct(size(p).alias("s"), F.get(p, F.lit(0)).alias("r"))))
        return df.withColumn(ring, best["r"])
    return df.withColumn(ring, F.explode(parts))


def region_bounds(region: Column | str) -> dict[str, Column]:
    """x0, x1, y0 and y1 of a region."""
    points = F.flatten(F.flatten(F.col(region) if isinstance(region, str) else region))
    of = lambda axis: F.transform(points, lambda p: p[axis])
    return {"x0": F.array_min(of("x")), "x1": F.array_max(of("x")), "y0": F.array_min(of("y")), "y1": F.array_max(of("y"))}


def clip_regions(regions: DataFrame, windows: DataFrame, region: str = "region", window: str = "window", cell: float = 1.0) -> DataFrame:
    """``regions`` cut by each of ``windows`` that they share an area with: their columns, ``region`` is the shared part.

    Both are covered by cells of side ``cell`` and meet in the first cell that their boxes share, so each
    pair is laid out once, and once for all rows with equal regions or windows.
    """
    shapes, frames = (kept(df.select(name).filter(F.col(name).isNotNull()).distinct(), "shapes") for df, name in ((regions, region), (windows, window)))
    index = lambda c: F.floor(c / cell).cast("long")

    def covered(df: DataFrame, name: str, prefix: str) -> DataFrame:
        box = {f"{prefix}{k}": c for k, c in region_bounds(name).items()}
        df = df.withColumns(box).filter(F.col(f"{prefix}x0").isNotNull())
        for axis in ("x", "y"):
            df = df.withColumn(f"_c{axis}", F.explode(F.sequence(index(F.col(f"{prefix}{axis}0")), index(F.col(f"{prefix}{axis}1")))))
        return df

    left, right = covered(shapes.withColumnRenamed(region, "_shape"), "_shape", "_l"), covered(frames.withColumnRenamed(window, "_frame"), "_frame", "_r")
    met = left.join(right, ["_cx", "_cy"])
    for axis in ("x", "y"):
        first = index(F.greatest(f"_l{axis}0", f"_r{axis}0"))
        met = met.filter((F.col(f"_c{axis}") == first) & (F.col(f"_l{axis}0") <= F.col(f"_r{axis}1")) & (F.col(f"_r{axis}0") <= F.col(f"_l{axis}1")))
    # a fixed number of tasks: pairs are few bytes and much work, and would be put together by their bytes
    parts = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = kept(met.select("_shape", "_frame").repartition(parts).withColumn("_part", overlay("_shape", "_frame")).filter(F.size("_part") > 0), "parts")
    own = [c for c in windows.columns if c not in regions.columns]
    found = regions.join(cut, F.col(region) == F.col("_shape")).join(windows.select(F.col(window).alias("_same"), *own), F.col("_frame") == F.col("_same"))
    return found.select(*[F.col("_part").alias(c) if c == region else F.col(f"`{c}`") for c in [*regions.columns, *own]])
