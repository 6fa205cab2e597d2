"""Readers, writers and the stream."""

import json

from pyspark.sql import functions as F

from terrashift.sources import readers, writers
from terrashift.streaming.windows import step_sums


def test_geojson(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    features = [
        {"type": "Feature", "properties": {"FID": 7}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    got = readers.read_geojson(spark, str(tmp_path / "a.json"), "src").orderBy("feature").collect()
    assert [r["feature"] for r in got] == [0, 1, 1] and len(got[0]["ring"]) == 4 and got[0]["properties"] == {"FID": "7"}


def test_placemarks(spark, tmp_path):
    (tmp_path / "a.kml").write_text(
        "<kml><Document><Placemark><name>one</name><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0,0 1,0,0 1,1,0</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark></Document></kml>"
    )
    got = readers.read_placemarks(spark, str(tmp_path / "a.kml"), "s").collect()
    assert got[0]["name"] == "one" and [(p["x"], p["y"]) for p in got[0]["ring"]] == [(0, 0), (1, 0), (1, 1)]


def test_segments(spark, tmp_path):
    (tmp_path / "a.txt").write_text("> a\n0 1\n2 3\n>\n4 5\n")
    got = [(r["segment"], r["x"], r["y"]) for r in readers.read_segments(spark, str(tmp_path / "a.txt")).orderBy("i").collect()]
    assert got == [(1, 0.0, 1.0), (1, 2.0, 3.0), (2, 4.0, 5.0)]


def test_segments_of_several_files_and_splits(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.txt").write_text("".join(f">\n{k} {i}\n{k} {i + 0.5}\n" for i in range(300)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        rows = readers.read_segments(spark, str(tmp_path)).orderBy("i").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = [(r["x"], r["segment"], r["y"]) for r in rows]
    assert got == [(float(k), i + 1, i + h) for k in range(2) for i in range(300) for h in (0.0, 0.5)]


def test_grid_text(spark, tmp_path):
    (tmp_path / "g.txt").write_text("-124.5 40.0 1.5\n -124.4\t40.0   NaN\n-124.3 40.0\n")
    got = sorted(tuple(r) for r in readers.read_grid_text(spark, str(tmp_path / "g.txt")).collect())
    assert got == [(-124.5, 40.0, 1.5), (-124.4, 40.0, None), (-124.3, 40.0, None)]


def test_tree(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "one.txt").write_text("123")
    (tmp_path / "a" / "two.txt").write_text("1")
    (tmp_path / "a" / "b" / "other.csv").write_text("1")
    got = {r["path"].rsplit("/", 1)[1]: (r["length"], r["parent"]) for r in readers.read_tree(spark, str(tmp_path), "*.txt").collect()}
    assert got == {"one.txt": (3, "b"), "two.txt": (1, "a")}


STUB = """
import io, json
class _Set:
    def __init__(self, v): self.v = v
    def __getitem__(self, k): import numpy as np; return np.array(self.v)
class _Group(dict):
    attrs = {}
class File:
    def __init__(self, f, mode): self.d = json.loads(f.read())
    def __enter__(self): return self
    def __exit__(self, *a): pass
    def __contains__(self, k): return k in self.d
    def __getitem__(self, k):
        v = self.d[k]
        if isinstance(v, list): return _Set(v)
        g = _Group(); g.attrs = {a: (b.encode() if isinstance(b, str) else b) for a, b in v.items()}
        return g
"""


def test_hdf5_through_a_stand_in(spark, tmp_path, monkeypatch):
    """The readers' own code with a module that reads JSON in place of h5py."""
    import importlib.util
    import sys

    if importlib.util.find_spec("h5py") is not None:
        import pytest

        pytest.skip("h5py is here")
    (tmp_path / "stub").mkdir()
    (tmp_path / "stub" / "h5py.py").write_text(STUB)
    monkeypatch.setattr(readers.importlib.util, "find_spec", lambda name: True)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.h5").write_text(json.dumps({"meta": {"site": "wc1", "n": 3}, "vel": [1, 2.5], "err": [0.5]}))
    (tmp_path / "in" / "b.h5").write_text(json.dumps({"meta": {}, "vel": [4]}))
    spark.sparkContext.addPyFile(str(tmp_path / "stub" / "h5py.py"))
    try:
        attributes = {r["path"].rsplit("/", 1)[1]: r["attributes"] for r in readers.read_hdf5_attributes(spark, str(tmp_path / "in")).collect()}
        assert attributes == {"a.h5": {"site": "wc1", "n": "3"}, "b.h5": {}}
        rows = sorted((r["path"].rsplit("/", 1)[1], r["i"], r["vel"], r["err"]) for r in readers.read_hdf5_series(spark, str(tmp_path / "in"), ["vel", "err"]).collect())
        assert rows == [("a.h5", 0, 1.0, 0.5), ("a.h5", 1, 2.5, None), ("b.h5", 0, 4.0, None)]
    finally:
        sys.modules.pop("h5py", None)
        sys.path[:] = [p for p in sys.path if "spark-" not in p or "userFiles" not in p]


def test_csv_versions_and_nan(spark, tmp_path):
    (tmp_path / "t_2.csv").write_text("id,v\na,NaN\nb,1.5\n")
    got = {r["id"]: r for r in readers.read_csv_versions(spark, [str(tmp_path / "t_*.csv")] * 2, "id string, v double").collect()}
    assert got["a"]["v"] is None and got["b"]["v"] == 1.5 and got["b"]["source_version"] == 2


def test_flatten_and_documents(spark):
    df = spark.sql("SELECT 1 AS id, named_struct('a', 'null', 'b', named_struct('c', 2.5)) AS s, array(1) AS l")
    assert readers.flatten(df).first().asDict() == {"id": 1, "s/a": None, "s/b/c": 2.5}
    docs = writers.as_document(spark.sql("SELECT 1 AS id, 'x' AS a, array(1, 2) AS l"), "id")
    assert writers.from_document(docs, "id", "a string, l array<int>").first().asDict() == {"id": 1, "a": "x", "l": [1, 2]}


def test_sinks(spark, tmp_path):
    df = spark.sql("SELECT explode(sequence(1, 4)) AS v, 'k' AS k")
    writers.write_both(df, str(tmp_path / "both"))
    assert spark.read.json(str(tmp_path / "both/json")).count() == 4
    writers.write_by_key(df, str(tmp_path / "keys"), "k")
    writers.replace_keys(df.limit(1), str(tmp_path / "keys"), "k")
    assert spark.read.parquet(str(tmp_path / "keys")).count() == 1
    manifest = writers.copy_selected(df, spark.sql("SELECT explode(array('k', 'z')) AS k"), str(tmp_path / "won"), "k")
    assert {r["k"]: r["status"] for r in manifest.collect()} == {"k": "copied", "z": "skipped"}
    assert writers.markdown(df.select("v").orderBy("v").limit(2)).splitlines()[-1] == "| 2 |"
    assert writers.p_text(0.0001) == "p<0.001"
    text = writers.latex(spark.sql("SELECT 'a_b' AS k_1, 1.234D AS v, CAST(NULL AS INT) AS n"))
    assert text.splitlines() == [r"\begin{tabular}{lll}", r"k\_1 & v & n \\", r"a\_b & 1.23 & — \\", r"\end{tabular}"]


def test_sites(spark, tmp_path):
    site = {"site_id": "a", "rainfall": [{"date": "2024-01-01", "rain_mm": 2.0}], "pga": None}
    (tmp_path / "s.json").write_text(json.dumps(site))
    sites = readers.read_sites(spark, str(tmp_path / "s.json"))
    assert readers.site_rain(sites).count() == 1 and readers.site_shakes(sites).count() == 0
    shaken = {"site_id": "b", "geology": {"name": "melange"}, "distances": {"road_m": 5.0, "elevation_m": 7.0}, "pga": [{"event_id": "e", "event_time": "2024-01-01T00:00:00", "pga_mean": 0.1, "mmi_mean": 4.5}]}
    (tmp_path / "t.json").write_text(json.dumps(shaken))
    sites = readers.read_sites(spark, str(tmp_path / "t.json"))
    assert [(r["pga"], r["pgv"], r["mmi"]) for r in readers.site_shakes(sites).collect()] == [(0.1, None, 4.5)]
    assert tuple(readers.site_context(sites).first()) == ("b", "melange", None, 5.0, None, 7.0)


def test_stream_of_steps(spark, tmp_path):
    rows = spark.sql("SELECT 1 AS id, timestamp'2024-01-01' + make_dt_interval(cast(i AS int)) AS t, 1.0D AS v FROM range(40) AS q(i)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = step_sums(stream, ["id"], "t", "v").writeStream.outputMode("append").format("memory").queryName("steps").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("steps").agg(F.count("*"), F.min("n"), F.max("total")).first()
    assert got[0] >= 2 and got[2] == 14.0
