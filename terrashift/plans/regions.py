"""Plans over regions: rings that cross themselves, holes and windows of any shape, on a grid of whole numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrashift.operators.overlay import clip_regions, overlay, region_area, region_perimeter
from terrashift.operators.picks import once_each
from terrashift.plans.registry import query, r, scratch, table
from terrashift.sources import readers, writers

# Rings run along whole coordinates and cross themselves in all ways: the corners (x0, y0), (x1, y0), (x1, y1), (x2, y1) and so on.
_X, _Y = "(c_custkey * ({i} + 3) + {salt} * 11 * ({i} + 1) + c_custkey // ({i} + 2)) % 9", "(c_custkey * ({i} + 5) + {salt} * 7 * ({i} + 2) + c_custkey // ({i} + 3)) % 9"


def _ring(k, salt: int):
    x = [((k * (i + 3) + salt * 11 * (i + 1) + F.floor(k / (i + 2))) % 9).cast("double") for i in range(4)]
    y = [((k * (i + 5) + salt * 7 * (i + 2) + F.floor(k / (i + 3))) % 9).cast("double") for i in range(4)]
    at = lambda i, j: F.struct(x[i % 4].alias("x"), y[j].alias("y"))
    return F.array(*[at(i + s, i) for i in range(4) for s in (0, 1)])


def _regions(spark, d):
    """Customers as regions of two polygons, the first with a hole; nothing keeps these apart or simple."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("id"), F.array(F.array(_ring(k, 1), _ring(k, 2)), F.array(_ring(k, 3))).alias("region"))


def _edges_sql() -> str:
    """The upright edges of all rings: those right of a cell's middle that cross its height tell how often the ring winds around it."""
    rows = []
    for salt, polygon, hole in ((1, 0, 0), (2, 0, 1), (3, 1, 0)):
        for i in range(4):
            x = _X.format(i=(i + 1) % 4, salt=salt)
            rows.append(f"SELECT c_custkey AS id, {polygon} AS polygon, {hole} AS hole, {x} AS x, {_Y.format(i=i, salt=salt)} AS a, {_Y.format(i=(i + 1) % 4, salt=salt)} AS b FROM customer")
    return " UNION ALL ".join(rows)


_CELLS_SQL = f"""ed AS ({_edges_sql()}), cell AS (SELECT i, j FROM range(0, 9) AS p(i), range(0, 9) AS q(j)),
    wind AS (SELECT id, polygon, hole, i, j, sum(CASE WHEN x > i AND a <= j AND b > j THEN 1 WHEN x > i AND b <= j AND a > j THEN -1 ELSE 0 END) AS w FROM ed, cell GROUP BY ALL),
    poly AS (SELECT id, polygon, i, j, max(CASE WHEN hole = 0 AND w <> 0 THEN 1 ELSE 0 END) - max(CASE WHEN hole = 1 AND w <> 0 THEN 1 ELSE 0 END) AS inside FROM wind GROUP BY ALL),
    filled AS (SELECT id, i, j FROM poly GROUP BY id, i, j HAVING max(inside) = 1)"""


@query(
    "r014_repaired",
    f"""WITH {_CELLS_SQL}, steps(di, dj) AS (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)),
    rim AS (SELECT f.id, count(*) AS n FROM filled f, steps WHERE NOT EXISTS (SELECT 1 FROM filled g WHERE g.id = f.id AND g.i = f.i + di AND g.j = f.j + dj) GROUP BY f.id)
    SELECT c_custkey AS id, coalesce(a.n, 0)::DOUBLE AS area, coalesce(rim.n, 0)::DOUBLE AS perimeter FROM customer LEFT JOIN (SELECT id, count(*) AS n FROM filled GROUP BY id) a ON a.id = c_custkey LEFT JOIN rim ON rim.id = c_custkey""",
)
def repaired_features(spark, d):
    path = scratch(spark)
    writers.write_geojson_lines(_regions(spark, d), path)
    read = readers.read_regions(spark, path, "customers", lines=True)
    return read.select(F.col("properties.id").cast("long").alias("id"), r(region_area("region"), 9).alias("area"), r(region_perimeter("region"), 9).alias("perimeter"))


def _windows(spark, d):
    """Windows with a corner to the inside and a hole at their rim."""
    w = F.col("r_regionkey").cast("double")
    ring = lambda *corners: F.array(*[F.struct((w + x).alias("x"), F.lit(float(y)).alias("y")) for x, y in corners])
    shape = ring((0, 0), (5, 0), (5, 2), (2, 2), (2, 8), (0, 8))
    return table(spark, d, "region").select(F.col("r_regionkey").alias("window_id"), F.array(F.array(shape, ring((0, 3), (1, 3), (1, 5), (0, 5)))).alias("window"))


_WINDOW_CELL_SQL = "((i >= k AND i < k + 5 AND j < 2) OR (i >= k AND i < k + 2 AND j >= 2 AND j < 8)) AND NOT (i = k AND j >= 3 AND j < 5)"


@query("s034_overlay", f"WITH {_CELLS_SQL} SELECT id, k AS window_id, count(*)::DOUBLE AS area FROM filled, (SELECT r_regionkey AS k FROM region) WHERE {_WINDOW_CELL_SQL} GROUP BY id, k")
def overlaid(spark, d):
    cut = clip_regions(_regions(spark, d), _windows(spark, d), cell=4.0)
    return cut.select("id", "window_id", r(region_area("region"), 9).alias("area"))


@query(
    "s034_remainders",
    f"""WITH {_CELLS_SQL}, f AS (SELECT id, i, j, {_WINDOW_CELL_SQL.replace("k", "2")} AS cut FROM filled)
    SELECT c_custkey AS id, count(*) FILTER (WHERE NOT cut)::DOUBLE AS rest, (20 - count(*) FILTER (WHERE cut) + count(*) FILTER (WHERE NOT cut))::DOUBLE AS either FROM customer LEFT JOIN f ON f.id = c_custkey GROUP BY c_custkey""",
)
def remainders(spark, d):
    """What one window leaves of each region, and what lies in one of both alone."""
    window = _windows(spark, d).filter("window_id = 2").select("window")
    both = _regions(spark, d).join(F.broadcast(window.limit(1)))  # one row
    laid = once_each(both, ["region", "window"], **{n: r(region_area(overlay("region", "window", how)), 9) for n, how in (("rest", "difference"), ("either", "symmetric"))})
    return laid.select("id", "rest", "either")
