"""Classic NetCDF grids, written here byte by byte."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrashift.sources import grids


def named(text):
    b = text.encode()
    return struct.pack(">i", len(b)) + b + b"\0" * (-len(b) % 4)


def attributes(pairs):
    if not pairs:
        return b"\0" * 8
    out = struct.pack(">ii", 12, len(pairs))
    for name, code, value in pairs:
        data = np.array([value], {3: ">i2", 5: ">f4", 6: ">f8"}[code]).tobytes()
        out += named(name) + struct.pack(">ii", code, 1) + data + b"\0" * (-len(data) % 4)
    return out


def write_grid(path, lon, lat, z, version=1, packed=False, records=False):
    """A grid of doubles, or of shorts with a scale, of fixed or of record rows."""
    dims = struct.pack(">ii", 10, 2) + named("lat") + struct.pack(">i", 0 if records else len(lat)) + named("lon") + struct.pack(">i", len(lon))
    code, kind = (3, ">i2") if packed else (6, ">f8")
    body = {"lat": (np.asarray(lat, ">f8"), 6, [0], []), "lon": (np.asarray(lon, ">f8"), 6, [1], [])}
    values = np.where(np.isnan(z), -999, np.round(z / 0.5) if packed else z).astype(kind)
    body["z"] = (values, code, [0, 1], [("_FillValue", code, -999), ("scale_factor", 6, 0.5)] if packed else [("_FillValue", code, -999)])
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    sizes = {n: len(pad((v[0] if records and d[0] == 0 else v).tobytes())) for n, (v, _, d, _) in body.items()}

    def header(begins):
        out = b"CDF" + bytes([version]) + struct.pack(">i", len(lat) if records else 0) + dims + b"\0" * 8 + struct.pack(">ii", 11, len(body))
        for n, (_, c, d, a) in body.items():
            out += named(n) + struct.pack(f">i{len(d)}i", len(d), *d) + attributes(a) + struct.pack(">ii", c, sizes[n]) + struct.pack(">q" if version == 2 else ">i", begins[n])
        return out

    at, begins = len(header(dict.fromkeys(body, 0))), {}
    fixed = [n for n, (_, _, d, _) in body.items() if not (records and d[0] == 0)]
    for n in [*fixed, *[n for n in body if n not in fixed]]:
        begins[n] = at
        at += sizes[n]
    data = header(begins) + b"".join(pad(body[n][0].tobytes()) for n in fixed)
    if records:
        data += b"".join(pad(body[n][0][i : i + 1].tobytes()) for i in range(len(lat)) for n in body if n not in fixed)
    path.write_bytes(data)


@pytest.mark.parametrize(("version", "packed", "records"), [(1, False, False), (2, True, False), (1, True, True)])
def test_grids_are_read_by_ranges_of_rows(spark, tmp_path, version, packed, records):
    rng = np.random.default_rng(1)
    lon, lat = -124 + np.arange(30) * 0.1, 40 - np.arange(200) * 0.05
    z = np.round(rng.uniform(0, 100, (200, 30)) * 2) / 2
    z[rng.random(z.shape) < 0.1] = np.nan
    write_grid(tmp_path / "a.nc", lon, lat, z, version, packed, records)
    write_grid(tmp_path / "b.nc", lon + 5, lat, z + 1, version, packed, records)
    df = grids.read_grid(spark, str(tmp_path), part_values=1000)
    assert df.rdd.getNumPartitions() == 2 * -(-200 // (1000 // 30))
    got = {(r["file"], r["row"], r["col"]): r for r in df.collect()}
    assert len(got) == 2 * z.size
    for i in (0, 7, 199):
        for j in (0, 11, 29):
            r = got["a.nc", i, j]
            assert (r["lon"], r["lat"]) == (lon[j], lat[i]) and (r["z"] is None if np.isnan(z[i, j]) else r["z"] == z[i, j])
    box = (-123.05, -122.45, 35.02, 36.01)
    part = grids.read_grid(spark, str(tmp_path), "z", box, part_values=1000)
    inside = [(i, j) for i in range(200) for j in range(30) if box[0] <= lon[j] <= box[1] and box[2] <= lat[i] <= box[3]]
    assert part.rdd.getNumPartitions() == 1 and sorted((r["row"], r["col"]) for r in part.collect()) == inside
    assert grids.read_grid(spark, str(tmp_path), "z", (50, 60, 0, 1)).count() == 0


def test_filters_reach_the_reader(spark, tmp_path):
    lon, lat = np.arange(40.0), np.arange(50.0)
    write_grid(tmp_path / "a.nc", lon, lat, np.add.outer(lat, lon))
    reader = grids._PushingReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([grids.GreaterThanOrEqual(("lat",), 20.0), grids.LessThan(("lat",), 30.0), grids.GreaterThan(("lon",), 35.0), grids.GreaterThan(("z",), 5.0)]))
    assert len(left) == 4 and [(p.start, p.stop, p.first, p.last) for p in reader.partitions()] == [(20, 31, 35, 40)]
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = grids.read_grid(spark, str(tmp_path)).filter((F.col("lat") >= 20) & (F.col("lat") < 30) & (F.col("lon") > 35))
        assert got.count() == 40 and got.agg(F.max("z")).first()[0] == 68.0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "a.nc").write_bytes(b"HDF5 of some kind")
    with pytest.raises(Exception, match="not a classic NetCDF file"):
        grids.read_grid(spark, str(tmp_path)).collect()
