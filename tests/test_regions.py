"""Repair and overlay of regions, their readers and writers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrashift.operators import overlay
from terrashift.sources import readers, writers


def ring(*corners):
    return np.array(corners, float)


def box(x, y, w):
    return ring((x, y), (x + w, y), (x + w, y + w), (x, y + w))


def area(region):
    return sum(overlay._area(r) for p in region for r in p)


def winding(r, spot):
    q = np.roll(r, -1, axis=0)
    side = (q[:, 0] - r[:, 0]) * (spot[1] - r[:, 1]) - (spot[0] - r[:, 0]) * (q[:, 1] - r[:, 1])
    return int(((r[:, 1] <= spot[1]) & (q[:, 1] > spot[1]) & (side > 0)).sum() - ((r[:, 1] > spot[1]) & (q[:, 1] <= spot[1]) & (side < 0)).sum())


def inside(region, spot):
    return any(winding(p[0], spot) != 0 and not any(winding(h, spot) for h in p[1:]) for p in region)


def test_repair_of_known_shapes():
    bow = overlay.repair([[ring((0, 0), (2, 2), (2, 0), (0, 2))]])
    assert len(bow) == 2 and area(bow) == 2.0
    nested = overlay.repair([[box(0, 0, 10), box(1, 1, 8)], [box(2, 2, 6), box(3, 3, 4)]])
    assert [len(p) for p in nested] == [2, 2] and area(nested) == 56.0
    touching = overlay.repair([[box(0, 0, 4), ring((0, 0), (2, 1), (1, 2))]])
    assert [len(p) for p in touching] == [2] and area(touching) == 14.5
    twice = overlay.repair([[np.concatenate([box(0, 0, 2), box(0, 0, 2)])]])
    assert area(twice) == 4.0 and [len(p) for p in twice] == [1]
    spike = overlay.repair([[ring((0, 0), (1, 0), (5, 0), (1, 0), (1, 1), (0, 1))]])
    assert area(spike) == 1.0 and sorted(map(tuple, spike[0][0].tolist())) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    assert overlay.repair([[ring((0, 0), (1, 1), (2, 2))]]) == [] and overlay.repair([[box(0, 0, 1), box(-1, -1, 3)]]) == []
    far = overlay.repair([[ring((0, 0), (2, 2), (2, 0), (0, 2)) + [500_000, 4_500_000]]])
    assert area(far) == pytest.approx(2, rel=1e-9)


def test_overlay_with_a_window_that_is_not_convex():
    ell, square = [[ring((0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4))]], [[box(0.5, 0.5, 2)]]
    sizes = {how: area(overlay.arranged([ell, square], rule)) for how, rule in overlay._RULES.items()}
    assert sizes == {"intersection": 1.75, "union": 9.25, "difference": 5.25, "symmetric": 7.5}


@pytest.mark.parametrize("whole", [True, False])
def test_any_two_regions_agree_with_winding_numbers(whole):
    rng = np.random.default_rng(2)

    def region():
        corners = lambda: rng.integers(0, 6, (rng.integers(3, 9), 2)).astype(float) if whole else rng.uniform(0, 6, (rng.integers(3, 9), 2))
        return [[corners() for _ in range(rng.integers(1, 3))] for _ in range(rng.integers(1, 3))]

    for _ in range(40):
        a, b = region(), region()
        for rule in overlay._RULES.values():
            got = overlay.arranged([a, b], rule)
            for p in got:
                assert overlay._area(p[0]) > 0 and all(overlay._area(h) < 0 for h in p[1:])
                assert all(len(set(map(tuple, r.tolist()))) == len(r) for r in p)
            for spot in rng.uniform(0, 6, (25, 2)) + 1e-5:
                want = bool(rule([np.array([inside(a, spot)]), np.array([inside(b, spot)])])[0])
                assert want == any(overlay._around(p[0], spot) and not any(overlay._around(h, spot) for h in p[1:]) for p in got)


def test_columns_of_regions(spark):
    shape = lambda *rings: [[{"x": x, "y": y} for x, y in r.tolist()] for r in rings]
    rows = [(1, [shape(box(0, 0, 4), box(1, 1, 1))]), (2, None), (3, []), (4, [shape(box(0, 0, 1)), shape(box(5, 5, 2))]), (5, [None, [None], [[{"x": None, "y": 1.0}]]])]
    kind = "array<array<array<struct<x:double,y:double>>>>"
    df = spark.createDataFrame(rows, f"id int, region {kind}").withColumn("fixed", overlay.repaired("region"))
    got = {r.id: r for r in df.select("id", "fixed", overlay.region_area("fixed").alias("area"), overlay.region_perimeter("fixed").alias("rim")).collect()}
    assert (got[1].area, got[1].rim, got[4].area, got[4].rim) == (15.0, 20.0, 5.0, 12.0) and got[2].fixed is None and got[3].fixed == [] and got[5].fixed == []
    parts = overlay.outer_rings(df.filter("id IN (1, 4)"), "fixed")
    assert sorted((r.id, len(r.ring)) for r in parts.collect()) == [(1, 4), (4, 4), (4, 4)]
    largest = {r.id: r.a for r in overlay.outer_rings(df, "fixed", largest=True).select("id", overlay.ring_area(F.col("ring")).alias("a")).collect()}
    assert largest == {1: 16.0, 2: None, 3: None, 4: 4.0, 5: None}
    windows = spark.createDataFrame([("w", [shape(box(0.5, 0.5, 5.5))]), ("far", [shape(box(100, 100, 1))]), ("none", None)], f"name string, window {kind}")
    for cell in (0.7, 3.0, 1000.0):
        cut = overlay.clip_regions(df.drop("fixed"), windows, cell=cell).select("id", "name", overlay.region_area("region").alias("a")).collect()
        assert sorted((r.id, r.name, r.a) for r in cut) == [(1, "w", 11.25), (4, "w", 1.25)]


def test_regions_of_geojson(spark, tmp_path):
    closed = lambda r: [*r.tolist(), r[0].tolist()]
    polygon = lambda kind, c: {"type": "Feature", "properties": {"FID": 7}, "geometry": {"type": kind, "coordinates": c}}
    features = [
        polygon("Polygon", [closed(box(0, 0, 4)), closed(box(1, 1, 1))]), polygon("MultiPolygon", [[closed(box(0, 0, 1))], [closed(box(9, 0, 1)), closed(box(9.25, 0.25, 0.5))]]),
        polygon("Polygon", [closed(ring((0, 0), (2, 2), (2, 0), (0, 2)))]), polygon("Point", [1, 2]), {"type": "Feature", "properties": {}, "geometry": None},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    read = readers.read_regions(spark, str(tmp_path / "a.json"), "src")
    got = {r.feature: r for r in read.select("*", overlay.region_area("region").alias("a")).collect()}
    assert {k: (len(r.region), r.a, r.source, r.properties["FID"]) for k, r in got.items()} == {0: (1, 15.0, "src", "7"), 1: (2, 1.75, "src", "7"), 2: (2, 2.0, "src", "7")}
    assert [len(r) for r in readers.read_regions(spark, str(tmp_path / "a.json"), "src", repair=False).first().region[0]] == [5, 5]
    writers.write_geojson_lines(read.select(F.col("feature").alias("n"), "region").repartition(2), str(tmp_path / "lines"))
    again = readers.read_regions(spark, str(tmp_path / "lines"), "src", lines=True).select(F.col("properties.n").cast("int").alias("n"), overlay.region_area("region").alias("a"))
    assert {r.n: r.a for r in again.collect()} == {0: 15.0, 1: 1.75, 2: 2.0}


def test_layers_of_kml(spark, tmp_path):
    def text(r):
        return "<LinearRing><coordinates>\n " + " ".join(f"{x},{y},0" for x, y in [*r.tolist(), r[0].tolist()]) + "\n</coordinates></LinearRing>"

    polygon = lambda outer, *holes: f"<Polygon><outerBoundaryIs>{text(outer)}</outerBoundaryIs>{''.join(f'<innerBoundaryIs>{text(h)}</innerBoundaryIs>' for h in holes)}</Polygon>"
    mark = lambda name, shape: f"<Placemark><name>{name}</name>{shape}</Placemark>"
    many = f"<MultiGeometry>{polygon(box(0, 0, 1))}{polygon(box(5, 5, 2))}<MultiGeometry>{polygon(box(9, 9, 1))}</MultiGeometry></MultiGeometry>"
    (tmp_path / "a.kml").write_text(
        f"""<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>d</name>
        <Folder><name>A</name>{mark("one", polygon(box(0, 0, 4), box(1, 1, 1), box(2.5, 2.5, 1)))}<Folder><name>sub</name>{mark("two", many)}</Folder></Folder>
        <Folder><name>B</name>{mark("point", "<Point><coordinates>1,2</coordinates></Point>")}{mark("three", polygon(box(0, 0, 3)))}</Folder>{mark("top", polygon(box(0, 0, 1)))}</Document></kml>"""
    )
    got = readers.read_layers(spark, str(tmp_path), "src").select("file", "layer", "name", F.size("region").alias("n"), overlay.region_area("region").alias("a")).collect()
    assert sorted(map(tuple, got)) == [("a.kml", "", "top", 1, 1.0), ("a.kml", "A", "one", 1, 14.0), ("a.kml", "A/sub", "two", 3, 6.0), ("a.kml", "B", "three", 1, 9.0)]
    assert readers.read_placemarks(spark, str(tmp_path), "s").count() == 6
    with pytest.raises(Exception, match="nested deeper"):
        readers.read_layers(spark, str(tmp_path), "src", levels=1).collect()
