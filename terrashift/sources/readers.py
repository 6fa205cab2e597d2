"""Readers of tables, features, grids and series."""

from __future__ import annotations

import importlib.util

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrashift.functions.coerce import nan_to_null
from terrashift.operators.overlay import repaired
from terrashift.operators.picks import once_each, total_before


def nulls_for_nan(df: DataFrame) -> DataFrame:
    """NaN means missing outside, null inside."""
    return df.withColumns({c: nan_to_null(F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    return nulls_for_nan(spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE"))


def read_csv_versions(spark: SparkSession, paths: list[str], schema: T.StructType | str, pattern: str = r"_(\d+)\.csv$") -> DataFrame:
    """Several files or globs with the file name and the version in it; unreadable files are skipped."""
    df = spark.read.schema(schema).option("ignoreCorruptFiles", True).csv(list(dict.fromkeys(paths)), header=True)
    name = F.col("_metadata.file_name")
    return nulls_for_nan(df.withColumns({"source_file": name, "source_version": F.regexp_extract(name, pattern, 1).try_cast("int")}))


def read_tree(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Paths of all files below a folder whose names fit a glob."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.element_at(F.split("path", "/"), -2).alias("parent"))


_FEATURE = "type string, features array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
_POLYGON = "array<array<array<double>>>"


def read_geojson(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(source, feature, properties, ring): outer rings of polygons; the parts of multi-polygons are rows of their own."""
    rows = spark.read.schema(_FEATURE).json(path, multiLine=True)
    features = rows.select(F.posexplode("features").alias("feature", "f"))
    multi = F.from_json("f.geometry.coordinates", f"array<{_POLYGON}>")
    single = F.array(F.from_json("f.geometry.coordinates", _POLYGON))
    parts = F.when(F.col("f.geometry.type") == "MultiPolygon", multi).when(F.col("f.geometry.type") == "Polygon", single)
    rings = features.select("feature", "f.properties", F.explode(parts).alias("p"))
    ring = F.transform(F.get("p", F.lit(0)), lambda q: F.struct(F.get(q, F.lit(0)).alias("x"), F.get(q, F.lit(1)).alias("y")))
    return rings.select(F.lit(source).alias("source"), "feature", "properties", ring.alias("ring"))


_COORDINATES = "struct<type:string,coordinates:string>"


def read_regions(spark: SparkSession, path: str, source: str, lines: bool = False, repair: bool = True) -> DataFrame:
    """(source, feature, properties, region) of the polygons and multi-polygons of GeoJSON files, holes included.

    A file is one collection of features, or with ``lines`` has a feature on each line, so that a file of
    any length spreads over many tasks. With ``repair`` rings that cross themselves are made simple, see
    :mod:`terrashift.operators.overlay`. Features without polygons drop out.
    """
    if lines:
        rows = spark.read.schema(f"properties map<string,string>, geometry {_COORDINATES}").json(path)
        features = rows.select(F.monotonically_increasing_id().alias("feature"), "properties", F.col("geometry").alias("g"))
    else:
        rows = spark.read.schema(_FEATURE).json(path, multiLine=True)
        features = rows.select(F.posexplode("features").alias("feature", "f")).select("feature", "f.properties", F.col("f.geometry").alias("g"))
    polygons = F.when(F.col("g.type") == "MultiPolygon", F.from_json("g.coordinates", f"array<{_POLYGON}>")).when(F.col("g.type") == "Polygon", F.array(F.from_json("g.coordinates", _POLYGON)))
    corner = lambda q: F.struct(F.get(q, F.lit(0)).alias("x"), F.get(q, F.lit(1)).alias("y"))
    region = F.transform(polygons, lambda p: F.transform(p, lambda r: F.transform(r, corner)))
    read = features.select(F.lit(source).alias("source"), "feature", "properties", region.alias("region")).filter("region IS NOT NULL")
    return once_each(read, ["region"], region=repaired("region")).select(*read.columns) if repair else read


_LINEAR = "LinearRing: array<struct<coordinates: string>>"
_KML_POLYGON = f"struct<outerBoundaryIs: struct<{_LINEAR}>, innerBoundaryIs: array<struct<{_LINEAR}>>>"
_KML_PLACEMARK = f"struct<name: string, Polygon: array<{_KML_POLYGON}>, MultiGeometry: struct<Polygon: array<{_KML_POLYGON}>, MultiGeometry: array<struct<Polygon: array<{_KML_POLYGON}>>>>>"


def _kml_folder(levels: int) -> str:
    deeper = f"array<{_kml_folder(levels - 1)}>" if levels else "array<string>"
    return f"struct<name: string, Placemark: array<{_KML_PLACEMARK}>, Folder: {deeper}>"


def _kml_ring(text: Column) -> Column:
    """Corners of ``lon,lat[,height]`` tuples."""
    part = lambda q, i: F.get(F.split(q, ","), F.lit(i)).try_cast("double")
    tuples = F.filter(F.split(F.trim(text), r"\s+"), lambda q: q != "")
    return F.transform(tuples, lambda q: F.struct(part(q, 0).alias("x"), part(q, 1).alias("y")))


def _kml_region(placemark: Column) -> Column:
    """All polygons of a placemark, of nested collections too."""
    none = lambda kind: F.array().cast(f"array<{kind}>")
    many = placemark["MultiGeometry"]
    inner = F.flatten(F.transform(F.coalesce(many["MultiGeometry"], none(f"struct<Polygon: array<{_KML_POLYGON}>>")), lambda m: F.coalesce(m["Polygon"], none(_KML_POLYGON))))
    every = F.concat(F.coalesce(placemark["Polygon"], none(_KML_POLYGON)), F.coalesce(many["Polygon"], none(_KML_POLYGON)), inner)
    rings = lambda boundary: F.transform(boundary["LinearRing"], lambda r: _kml_ring(r["coordinates"]))
    holes = lambda p: F.flatten(F.transform(F.coalesce(p["innerBoundaryIs"], none(f"struct<{_LINEAR}>")), rings))
    return F.transform(every, lambda p: F.concat(rings(p["outerBoundaryIs"]), holes(p)))


def read_layers(spark: SparkSession, path: str, source: str, levels: int = 6, repair: bool = True) -> DataFrame:
    """(source, file, layer, name, region) of the placemarks with polygons of KML files.

    ``layer`` is the path of folder names around a placemark, joined by ``/``. All layers come from one
    scan; a file is one row of it. Folders nested deeper than ``levels`` are an error, not left out.
    """
    container = _kml_folder(levels)
    schema = container.replace("struct<", f"struct<Document: array<{container}>, ", 1)
    rows = spark.read.format("xml").option("rowTag", "kml").schema(T.StructType.fromDDL(schema)).load(path)
    row = "struct<layer: string, placemark: " + _KML_PLACEMARK + ">"

    def placemarks(folder: Column, layer: Column, left: int) -> Column:
        own = F.transform(folder["Placemark"], lambda p: F.struct(layer.alias("layer"), p.alias("placemark")))
        if left < 0:
            return F.coalesce(own, F.array().cast(f"array<{row}>"))
        if not left:
            below = F.transform(folder["Folder"], lambda f: F.raise_error(F.lit(f"folders are nested deeper than {levels} levels")).cast(f"array<{row}>"))
        else:
            name = lambda f: F.concat_ws("/", F.nullif(layer, F.lit("")), F.coalesce(f["name"], F.lit("")))
            below = F.transform(folder["Folder"], lambda f: placemarks(f, name(f), left - 1))
        empty = F.array().cast(f"array<{row}>")
        return F.concat(F.coalesce(own, empty), F.coalesce(F.flatten(below), empty))

    top = F.struct(F.lit(None).cast("string").alias("name"), "Placemark", "Folder")
    whole = F.concat(F.transform(F.coalesce("Document", F.array().cast(f"array<{container}>")), lambda d: placemarks(d, F.lit(""), levels)), F.array(placemarks(top, F.lit(""), levels)))
    found = rows.select(F.col("_metadata.file_name").alias("file"), F.explode(F.flatten(whole)).alias("p"))
    read = found.select(F.lit(source).alias("source"), "file", "p.layer", F.col("p.placemark.name").alias("name"), _kml_region(F.col("p.placemark")).alias("region")).filter(F.size("region") > 0)
    return once_each(read, ["region"], region=repaired("region")).select(*read.columns) if repair else read


def read_placemarks(spark: SparkSession, path: str, source: str) -> DataFrame:
    """(source, name, ring): the outer rings of the polygons of KML files, as they are."""
    return read_layers(spark, path, source, repair=False).select("source", "name", F.explode("region").alias("p")).select("source", "name", F.get("p", F.lit(0)).alias("ring"))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(file, segment, i, x, y) of a text file of ``x y`` lines in which lines with ``>`` start a segment.

    Lines are ordered by the place of their split in the file and numbered by running counts over
    ranges, so a file of any length spreads over many tasks.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), place.alias("place"))
    numbered = total_before(lines.withColumn("one", F.lit(1)), [F.col("file"), F.col("place.split"), F.col("place.line")], "one", "i")
    counted = total_before(numbered.withColumn("starts", F.col("value").startswith(">").cast("int")), [F.col("i")], "starts", "before")
    first = counted.groupBy("file").agg(F.min("before").alias("first"))
    parts = F.split(F.trim("value"), r"\s+")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    placed = counted.join(first, "file").filter(~F.col("value").startswith(">") & (F.trim("value") != ""))
    return placed.select("file", (F.col("before") - F.col("first")).alias("segment"), "i", number(0).alias("x"), number(1).alias("y"))


def read_grid_text(spark: SparkSession, path: str) -> DataFrame:
    """(lon, lat, z) of a grid written as text, one pixel a line."""
    parts = F.split(F.trim("value"), r"\s+")
    names = ("lon", "lat", "z")
    return nulls_for_nan(spark.read.text(path).select(*[F.get(parts, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)]))


def read_window(spark: SparkSession, path: str, box: str, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Pixels of one box in [row0, row1) and [col0, col1); the conditions reach the Parquet scan."""
    df = spark.read.parquet(path)
    return df.filter((F.col("box_id") == box) & (F.col("y") >= rows[0]) & (F.col("y") < rows[1]) & (F.col("x") >= cols[0]) & (F.col("x") < cols[1]))


def radar_pixels(df: DataFrame, x_first: float, y_first: float, x_step: float, y_step: float, values: list[str]) -> DataFrame:
    """Coordinates from grid positions; a value of 0 means none."""
    zero = {v: F.nullif(F.col(v), F.lit(0.0)) for v in values}
    return nulls_for_nan(df).withColumns({**zero, "lon": F.lit(x_first) + F.col("x") * x_step, "lat": F.lit(y_first) + F.col("y") * y_step})


def flatten(df: DataFrame, sep: str = "/") -> DataFrame:
    """Nested fields as columns named by their path; arrays and maps are dropped, the text ``null`` is null."""

    def leaves(schema: T.StructType, path: tuple[str, ...]) -> list:
        out = []
        for f in schema.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                out += leaves(f.dataType, here)
            elif not isinstance(f.dataType, (T.ArrayType, T.MapType)):
                col = F.col(".".join(f"`{p}`" for p in here))
                col = F.nullif(col, F.lit("null")) if isinstance(f.dataType, T.StringType) else col
                out.append(col.alias(sep.join(here)))
        return out

    return df.select(*leaves(df.schema, ()))


# Fixed layout of a site's record of driving forces.
SITE_SCHEMA = (
    "site_id string, meta struct<lon:double,lat:double,global_start_date:string,global_end_date:string,eq_event_radius:int>, "
    "rainfall array<struct<date:date,rain_mm:double>>, geology struct<source:string,name:string,lithology:string,description:string>, "
    "distances struct<road_m:double,ocean_m:double,elevation_m:double>, "
    "pga array<struct<event_id:string,event_time:timestamp,lat:double,lon:double,pga_mean:double,pga_std:double,pgv_mean:double,pgv_std:double,mmi_mean:double,mmi_std:double>>"
)


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SITE_SCHEMA).json(path)


def site_rain(sites: DataFrame) -> DataFrame:
    return sites.select("site_id", F.explode("rainfall").alias("r")).select("site_id", F.col("r.date").alias("time"), F.col("r.rain_mm").alias("mm"))


def site_shakes(sites: DataFrame) -> DataFrame:
    return sites.select("site_id", F.explode("pga").alias("p")).select("site_id", "p.event_id", F.col("p.event_time").alias("time"), F.col("p.pga_mean").alias("pga"), F.col("p.pgv_mean").alias("pgv"), F.col("p.mmi_mean").alias("mmi"))


def site_context(sites: DataFrame) -> DataFrame:
    """(site_id, geology, lithology, road_m, ocean_m, elevation_m)."""
    return sites.select("site_id", F.col("geology.name").alias("geology"), "geology.lithology", "distances.road_m", "distances.ocean_m", "distances.elevation_m")


def _needs_hdf5() -> None:
    if importlib.util.find_spec("h5py") is None:
        raise RuntimeError("h5py isn't installed")


def read_hdf5_attributes(spark: SparkSession, path: str, group: str = "meta") -> DataFrame:
    """(path, attributes): all attributes of one group of each file, as text. Needs h5py on the executors."""
    _needs_hdf5()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def parse(batches):
        import io

        import h5py
        import pandas as pd

        for pdf in batches:
            rows = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with h5py.File(io.BytesIO(content), "r") as f:
                    attrs = {k: v.decode() if isinstance(v, bytes) else str(v[0] if getattr(v, "shape", None) == (1,) else v) for k, v in f[group].attrs.items()}
                rows.append((name, attrs))
            yield pd.DataFrame(rows, columns=["path", "attributes"])

    return files.mapInPandas(parse, "path string, attributes map<string,string>")


def read_hdf5_series(spark: SparkSession, path: str, datasets: list[str]) -> DataFrame:
    """(path, i, <datasets>): vectors as long rows, null where one is missing or shorter. Needs h5py on the executors."""
    _needs_hdf5()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def parse(batches):
        import io

        import h5py
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with h5py.File(io.BytesIO(content), "r") as f:
                    got = {d: f[d][:].astype(float) for d in datasets if d in f}
                n = max(map(len, got.values()), default=0)
                yield pd.DataFrame({"path": [name] * n, "i": range(n), **{d: [*got.get(d, []), *[None] * (n - len(got.get(d, [])))] for d in datasets}})

    return files.mapInPandas(parse, "path string, i long, " + ", ".join(f"`{d}` double" for d in datasets))
