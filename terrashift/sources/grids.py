"""Binary grids of the classic NetCDF format as a Spark data source.

A file's header says where each variable begins, so the rows of a grid are read by ranges: every
partition is some rows of one file, and a box leaves out the rows and columns that lie outside before a
byte of them is read. A coordinate of the box may be given as an option, or by filters on ``lon`` and
``lat`` where the session pushes filters down to Python sources.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

# Fixed values of the format: tags of lists, and the type of each code, big-endian.
_DIMENSIONS, _VARIABLES, _ATTRIBUTES = 10, 11, 12
_KINDS = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
#: Values of a partition.
PART_VALUES = 1_000_000


@dataclass
class Variable:
    dims: list[int]
    attributes: dict
    kind: str
    size: int
    begin: int
    by_record: bool = False


class Header:
    """Dimensions and variables of a file of version 1 or 2, from its first bytes."""

    def __init__(self, f):
        self.f = f
        magic = f.read(4)
        if magic[:3] != b"CDF" or magic[3] not in (1, 2):
            raise ValueError("not a classic NetCDF file")
        self.wide = magic[3] == 2
        records = self._int()
        self.dims = [(self._name(), self._int()) for _ in range(self._list(_DIMENSIONS))]
        self.attributes = self._attributes()
        self.variables: dict[str, Variable] = {}
        for _ in range(self._list(_VARIABLES)):
            name, dims = self._name(), [self._int() for _ in range(self._int())]
            attributes, kind, size = self._attributes(), _KINDS[self._int()], self._int()
            begin = struct.unpack(">q", f.read(8))[0] if self.wide else self._int()
            self.variables[name] = Variable(dims, attributes, kind, size, begin, bool(dims) and self.dims[dims[0]][1] == 0)
        self.record_size = sum(v.size for v in self.variables.values() if v.by_record)
        if sum(v.by_record for v in self.variables.values()) == 1:  # a lone record variable isn't padded
            v = next(v for v in self.variables.values() if v.by_record)
            self.record_size = int(np.prod([self.dims[d][1] for d in v.dims[1:]], dtype=np.int64)) * np.dtype(v.kind).itemsize
        self.records = records

    def _int(self) -> int:
        return struct.unpack(">i", self.f.read(4))[0]

    def _list(self, tag: int) -> int:
        found, n = self._int(), self._int()
        if found not in (0, tag):
            raise ValueError("a header of another layout")
        return n

    def _padded(self, n: int) -> bytes:
        return self.f.read(n + -n % 4)[:n]

    def _name(self) -> str:
        return self._padded(self._int()).decode()

    def _attributes(self) -> dict:
        out = {}
        for _ in range(self._list(_ATTRIBUTES)):
            name, kind, n = self._name(), np.dtype(_KINDS[self._int()]), self._int()
            data = self._padded(n * kind.itemsize)
            out[name] = data.decode(errors="replace") if kind.kind == "S" else np.frombuffer(data, kind)
        return out

    def length(self, variable: Variable) -> int:
        """Rows along the first dimension."""
        return self.records if variable.by_record else self.dims[variable.dims[0]][1]

    def rows(self, variable: Variable, start: int, stop: int) -> np.ndarray:
        """Rows [start, stop) of a variable, a row each."""
        width = int(np.prod([self.dims[d][1] for d in variable.dims[1:]], dtype=np.int64))
        kind = np.dtype(variable.kind)
        if not variable.by_record:
            self.f.seek(variable.begin + start * width * kind.itemsize)
            return np.frombuffer(self.f.read((stop - start) * width * kind.itemsize), kind).reshape(stop - start, width)
        out = []
        for i in range(start, stop):
            self.f.seek(variable.begin + i * self.record_size)
            out.append(np.frombuffer(self.f.read(width * kind.itemsize), kind))
        return np.stack(out) if out else np.zeros((0, width), kind)


def _open(path: str):
    """A file of any store that Arrow knows, or of a folder that all share."""
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        return store.open_input_file(name)
    return open(path.removeprefix("file://"), "rb")


def _files(path: str) -> list[str]:
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path)
        scheme = path.split("://")[0]
        info = store.get_file_info(name)
        return [path] if info.is_file else sorted(f"{scheme}://{i.path}" for i in store.get_file_info(fs.FileSelector(name)) if i.is_file)
    path = path.removeprefix("file://")
    return [path] if os.path.isfile(path) else sorted(os.path.join(path, n) for n in os.listdir(path) if not n.startswith((".", "_")))


@dataclass
class _Rows(InputPartition):
    path: str
    variable: str
    start: int
    stop: int
    first: int
    last: int


def _grid_variable(header: Header, name: str | None) -> str:
    """The named variable, or the only one of two dimensions that both have a coordinate."""
    if name:
        return name
    flat = [n for n, v in header.variables.items() if len(v.dims) == 2 and all(header.dims[d][0] in header.variables for d in v.dims)]
    if len(flat) != 1:
        raise ValueError(f"name the variable: one of {flat}")
    return flat[0]


class _GridReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.variable = options["path"], options.get("variable")
        self.part = int(options.get("part_values", PART_VALUES))
        box = [float(x) for x in options["box"].split(",")] if options.get("box") else [-np.inf, np.inf, -np.inf, np.inf]
        self.low, self.high = {"lon": box[0], "lat": box[2]}, {"lon": box[1], "lat": box[3]}

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in _files(self.path):
            with _open(path) as f:
                header = Header(f)
                name = _grid_variable(header, self.variable)
                ranges = []
                for d, axis in zip(header.variables[name].dims, ("lat", "lon"), strict=True):
                    along = header.variables[header.dims[d][0]]
                    at = header.rows(along, 0, header.length(along)).ravel().astype(float)
                    inside = np.flatnonzero((at >= self.low[axis]) & (at <= self.high[axis]))
                    ranges.append((int(inside[0]), int(inside[-1]) + 1) if len(inside) else (0, 0))
            (start, stop), (first, last) = ranges
            step = max(1, self.part // max(1, last - first))
            out += [_Rows(path, name, i, min(stop, i + step), first, last) for i in range(start, stop, step) if last > first]
        return out

    def read(self, part: _Rows | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no rows in the box
            return
        with _open(part.path) as f:
            header = Header(f)
            v = header.variables[part.variable]
            y, x = (header.variables[header.dims[d][0]] for d in v.dims)
            lat = header.rows(y, part.start, part.stop).ravel().astype(float)
            lon = header.rows(x, 0, header.length(x)).ravel().astype(float)[part.first : part.last]
            raw = header.rows(v, part.start, part.stop)[:, part.first : part.last]
            z = raw.astype(float)
            for missing in ("_FillValue", "missing_value"):
                if missing in v.attributes:
                    z[raw == v.attributes[missing][0]] = np.nan
            z = z * float(v.attributes.get("scale_factor", [1.0])[0]) + float(v.attributes.get("add_offset", [0.0])[0])
        n, m = z.shape
        row, col = np.divmod(np.arange(n * m, dtype=np.int64), max(m, 1))
        columns = [pa.array(np.tile(lon, n)), pa.array(np.repeat(lat, m)), pa.array(z.ravel(), from_pandas=True), pa.array(row + part.start), pa.array(col + part.first), pa.array([os.path.basename(part.path)] * (n * m))]
        yield pa.RecordBatch.from_arrays(columns, names=["lon", "lat", "z", "row", "col", "file"])


class _PushingReader(_GridReader):
    """For sessions that push filters down; others refuse a reader that takes them."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Limits of coordinates skip rows and columns; all filters are still applied by Spark."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute[0] in self.low:
                self.low[f.attribute[0]] = max(self.low[f.attribute[0]], float(f.value))
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute[0] in self.high:
                self.high[f.attribute[0]] = min(self.high[f.attribute[0]], float(f.value))
            yield f


class ClassicGrid(DataSource):
    """Options: path (a file or folder), variable, box (lon0,lon1,lat0,lat1), part_values, push (whether to take filters)."""

    @classmethod
    def name(cls) -> str:
        return "classic_grid"

    def schema(self) -> str:
        return "lon double, lat double, z double, row long, col long, file string"

    def reader(self, schema) -> DataSourceReader:
        return (_PushingReader if self.options.get("push") == "true" else _GridReader)(self.options)


def read_grid(spark: SparkSession, path: str, variable: str | None = None, box: tuple[float, float, float, float] | None = None, part_values: int = PART_VALUES) -> DataFrame:
    """(lon, lat, z, row, col, file) of the pixels of NetCDF grids of classic format, missing values null.

    ``box`` (lon0, lon1, lat0, lat1) reads only the rows and columns in it. Each partition is about
    ``part_values`` pixels.
    """
    spark.dataSource.register(ClassicGrid)
    reader = spark.read.format("classic_grid").option("path", path).option("part_values", str(part_values))
    reader = reader.option("push", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    if variable:
        reader = reader.option("variable", variable)
    if box:
        reader = reader.option("box", ",".join(map(repr, map(float, box))))
    return reader.load()
