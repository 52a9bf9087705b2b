"""Classic netCDF (CDF-1, CDF-2 and CDF-5) as DataFrames, and back.

A file comes to a task whole, as Spark's ``binaryFile`` source gives it, so any path that Spark
reads will do and the files of a series are read in parallel; a file may be as large as that source
allows (2 GiB). Values become one row for each element, with one column for each dimension.
NetCDF-4 is another format (HDF5) and is told so.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import matching, remove, scratch, write_bytes, write_joined

# External types of the format by their tag.
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
TAGS = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6, "u1": 7, "u2": 8, "u4": 9, "i8": 10, "u8": 11}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
#: What is read of a file to learn its variables.
HEADER_BYTES = 1 << 20
#: About what a task holds of a variable that is written from a table.
PIECE_BYTES = 1 << 20


@dataclass
class Variable:
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    kind: np.dtype
    begin: int
    record: bool
    attributes: dict = field(default_factory=dict)


@dataclass
class Header:
    dims: dict[str, int]
    variables: dict[str, Variable]
    attributes: dict
    record_bytes: int


@dataclass
class Rows:
    """A variable's values from a table: its numeric column ``value`` in the order of ``order``."""

    table: DataFrame
    order: tuple[str, ...]
    value: str


class _Reader:
    def __init__(self, raw: bytes) -> None:
        if raw[:4] == b"\x89HDF":
            raise ValueError("this is netCDF-4 (HDF5); only classic netCDF can be read")
        if raw[:3] != b"CDF" or raw[3] not in (1, 2, 5):
            raise ValueError("not a netCDF file")
        self.raw, self.at, self.version = raw, 4, raw[3]

    def number(self, code: str) -> int:
        value = struct.unpack_from(f">{code}", self.raw, self.at)[0]
        self.at += struct.calcsize(code)
        return value

    def count(self) -> int:
        return self.number("q" if self.version == 5 else "i")

    def name(self) -> str:
        n = self.count()
        text = self.raw[self.at : self.at + n].decode()
        self.at += -(-n // 4) * 4
        return text

    def listed(self, tag: int, item):
        found, n = self.number("i"), self.count()
        if found not in (0, tag):
            raise ValueError(f"damaged netCDF header: tag {found} where {tag} is due")
        return [item() for _ in range(n)]

    def attribute(self):
        name, kind, n = self.name(), np.dtype(TYPES[self.number("i")]), self.count()
        raw = self.raw[self.at : self.at + n * kind.itemsize]
        self.at += -(-len(raw) // 4) * 4
        if kind.char == "S":
            return name, raw.decode(errors="replace")
        values = np.frombuffer(raw, kind).tolist()
        return name, values[0] if len(values) == 1 else values


def header(raw: bytes) -> Header:
    """The header of a file, of which ``raw`` need not have more."""
    r = _Reader(raw)
    records = r.count()
    dims = r.listed(DIMENSIONS, lambda: (r.name(), r.count()))
    shared = dict(r.listed(ATTRIBUTES, r.attribute))
    unlimited = next((name for name, n in dims if n == 0), None)
    sizes = {name: n or max(0, records) for name, n in dims}

    def variable():
        name = r.name()
        own = tuple(dims[r.count()][0] for _ in range(r.count()))
        attributes = dict(r.listed(ATTRIBUTES, r.attribute))
        kind = np.dtype(TYPES[r.number("i")])
        r.count()  # the size, which follows from the shape
        begin = r.number("i" if r.version == 1 else "q")
        return name, Variable(own, tuple(sizes[d] for d in own), kind, begin, bool(own) and own[0] == unlimited, attributes)

    variables = dict(r.listed(VARIABLES, variable))
    spans = [int(np.prod(v.shape[1:], dtype=np.int64)) * v.kind.itemsize for v in variables.values() if v.record]
    step = spans[0] if len(spans) == 1 else sum(-(-s // 4) * 4 for s in spans)  # a single one is not padded
    return Header(sizes, variables, shared, step)


def _stored(raw, head: Header, name: str) -> np.ndarray:
    """A variable as it stands in the file, not copied."""
    v = head.variables[name]
    inner = [int(np.prod(v.shape[k + 1 :], dtype=np.int64)) * v.kind.itemsize for k in range(len(v.shape))]
    if 0 in v.shape:
        return np.zeros(v.shape, v.kind)
    return np.ndarray(v.shape, v.kind, raw, v.begin, [head.record_bytes, *inner[1:]] if v.record else inner)


def _decoded(stored: np.ndarray, v: Variable) -> np.ndarray:
    if v.kind.char == "S":
        return stored
    out = stored.astype(v.kind.newbyteorder("="))
    fills = [v.attributes[k] for k in ("_FillValue", "missing_value") if k in v.attributes]
    scale, offset = v.attributes.get("scale_factor", 1), v.attributes.get("add_offset", 0)
    if fills or out.dtype.kind == "f" or (scale, offset) != (1, 0):
        missing = np.isin(out, np.array(fills, out.dtype)) if fills else np.zeros(out.shape, bool)
        out = np.where(missing, np.nan, out.astype(np.float64) * scale + offset)
    return out


def values(raw: bytes, head: Header, name: str) -> np.ndarray:
    """A variable's values: floating ones as doubles with fill values as NaN, packed ones unpacked."""
    return _decoded(_stored(raw, head, name), head.variables[name])


def _front(dims: dict[str, int], variables: dict[str, tuple[tuple[str, ...], int, int, dict]], attributes: dict | None) -> bytes:
    """The header of a CDF-2 file of variables ``name -> (dims, tag, bytes, attributes)``, whose values
    follow it in order."""

    def name(text: str) -> bytes:
        raw = text.encode()
        return struct.pack(">i", len(raw)) + raw + b"\0" * (-len(raw) % 4)

    def listed(tag: int, items: list[bytes]) -> bytes:
        return struct.pack(">ii", tag if items else 0, len(items)) + b"".join(items)

    def attribute(key: str, value) -> bytes:
        if isinstance(value, str):
            raw, tag, n = value.encode(), 2, len(value.encode())
        else:
            many = np.atleast_1d(np.asarray(value, ">f8"))
            raw, tag, n = many.tobytes(), 6, len(many)
        return name(key) + struct.pack(">ii", tag, n) + raw + b"\0" * (-len(raw) % 4)

    def notes(found: dict | None) -> bytes:
        return listed(ATTRIBUTES, [attribute(k, v) for k, v in (found or {}).items()])

    places = list(dims)

    def made(begins: dict[str, int]) -> bytes:
        parts = []
        for key, (own, tag, size, found) in variables.items():
            places_of = struct.pack(f">{len(own) + 1}i", len(own), *(places.index(d) for d in own))
            parts.append(name(key) + places_of + notes(found) + struct.pack(">iiq", tag, min(size, 2**31 - 4), begins.get(key, 0)))
        return b"CDF\x02" + struct.pack(">i", 0) + listed(DIMENSIONS, [name(d) + struct.pack(">i", n) for d, n in dims.items()]) + notes(attributes) + listed(VARIABLES, parts)

    at, begins = len(made({})), {}
    for key, (_, _, size, _) in variables.items():
        begins[key], at = at, at + size
    return made(begins)


def _body(key: str, dims: dict[str, int], own: tuple[str, ...], array) -> tuple[int, bytes]:
    """Tag and bytes of an array."""
    array = np.asarray(array)
    code = array.dtype.str[1:]
    if code in ("i8", "u8", "u4"):
        array, code = array.astype("f8"), "f8"
    if array.shape != tuple(dims[d] for d in own):
        raise ValueError(f"{key} has shape {array.shape}, its dimensions {own} differ")
    raw = np.ascontiguousarray(array.astype(f">{code}" if code != "S1" else "S1")).tobytes()
    return TAGS[code], raw + b"\0" * (-len(raw) % 4)


def encode(dims: dict[str, int], variables: dict[str, tuple[tuple[str, ...], np.ndarray, dict]], attributes: dict | None = None) -> bytes:
    """A CDF-2 file of variables ``name -> (dims, values, attributes)``; integers of 64 bits become
    doubles, since the format has none."""
    bodies = {key: _body(key, dims, own, array) for key, (own, array, _) in variables.items()}
    front = _front(dims, {key: (own, bodies[key][0], len(bodies[key][1]), found) for key, (own, _, found) in variables.items()}, attributes)
    return front + b"".join(raw for _, raw in bodies.values())


def write(spark: SparkSession, path: str, dims: dict[str, int], variables: dict[str, tuple[tuple[str, ...], np.ndarray | Rows, dict]], attributes: dict | None = None) -> None:
    """``encode`` to a file by any path, for variables of any size: those given as ``Rows`` are sorted
    and encoded by Spark in pieces, which are joined as streams, so that none of their values are
    results of the driver. Missing values become ``_FillValue``, where there is one, or NaN."""
    told, bodies, folders = {}, [], []
    try:
        for key, (own, given, found) in variables.items():
            if not isinstance(given, Rows):
                tag, raw = _body(key, dims, own, given)
                told[key] = own, tag, len(raw), found
                bodies.append(raw)
                continue
            kind = {"tinyint": "i1", "smallint": "i2", "int": "i4", "float": "f4"}.get(dict(given.table.dtypes)[given.value], "f8")
            size = int(np.prod([dims[d] for d in own], dtype=np.int64)) * np.dtype(kind).itemsize
            told[key] = own, TAGS[kind], size + -size % 4, found
            folders.append(scratch(spark, "pieces"))
            _write_pieces(given, f">{kind}", found.get("_FillValue"), folders[-1])
            bodies += [(key, folders[-1], size), b"\0" * (-size % 4)]
        write_joined(spark, path, [_front(dims, told, attributes), *bodies])
    finally:
        for folder in folders:
            remove(spark, folder)


def _write_pieces(rows: Rows, kind: str, fill: float | None, folder: str) -> None:
    """Spark's text files of lines that are a length in eight bytes and so many bytes of values."""

    def run(batches):
        held, size = [], 0
        line = lambda: pa.RecordBatch.from_arrays([pa.array([struct.pack(">q", size) + b"".join(held)], pa.binary())], names=["content"])
        for b in batches:
            held.append(b.column(0).to_numpy(zero_copy_only=False).astype(kind).tobytes())
            size += len(held[-1])
            if size >= PIECE_BYTES:
                yield line()
                held, size = [], 0
        if size:
            yield line()

    value = F.col(rows.value)
    if fill is not None:
        value = F.coalesce(value, F.lit(fill).cast(rows.table.schema[rows.value].dataType))
    pieces = rows.table.orderBy(*rows.order).select(value.alias("value")).mapInArrow(run, "content binary")
    pieces.select(F.col("content").cast("string").alias("value")).write.options(lineSep="\n", compression="none").text(folder)


def read_header(spark: SparkSession, path: str) -> Header:
    """Header of one file; a bounded piece of it comes to the driver."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, HEADER_BYTES).alias("c")).first()
    if head is None:
        raise FileNotFoundError(path)
    return header(bytes(head.c))


def read_variables(spark: SparkSession, path: str, names: list[str], head: Header | None = None) -> DataFrame:
    """One row for each element: a long column for each dimension of the variables (``<name>_index``
    where a variable that is read has its name), and one for each variable (doubles, or longs for
    whole numbers). All must have the dimensions of the first, in
    its order, or some of them. ``path`` may be a pattern; then ``file`` counts the files in
    order of their names. Missing values are NULL."""
    files = matching(spark, path)
    if not files:
        raise FileNotFoundError(path)
    head = head or read_header(spark, files[0])
    if lacking := [n for n in names if n not in head.variables]:
        raise ValueError(f"{path} has no variables {lacking}")
    dims = head.variables[names[0]].dims
    whole = {n: head.variables[n].kind.kind in "iu" and not {"_FillValue", "missing_value", "scale_factor", "add_offset"} & set(head.variables[n].attributes) for n in names}
    columns = ["file", *(f"{d}_index" if d in names else d for d in dims), *names]
    schema = ", ".join(f"`{c}` {'long' if c not in whole or whole[c] else 'double'}" for c in columns)
    order = {f: i for i, f in enumerate(files)}

    def rows(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1)):
                raw = raw.as_buffer()
                own = header(raw[:HEADER_BYTES].to_pybytes())
                shape = own.variables[names[0]].shape
                stored = {n: _stored(raw, own, n) for n in names}
                total = int(np.prod(shape, dtype=np.int64))
                for at in range(0, total, 65_536):
                    place = dict(zip(dims, np.unravel_index(np.arange(at, min(at + 65_536, total)), shape)))
                    made = [pa.array(np.full(min(65_536, total - at), order[name])), *(pa.array(x.astype(np.int64)) for x in place.values())]
                    for n in names:
                        v = own.variables[n]
                        x = np.broadcast_to(_decoded(stored[n][tuple(place[d] for d in v.dims)], v), len(made[0]))
                        made.append(pa.array(x.astype(np.int64)) if whole[n] else pa.array(x.astype(np.float64), mask=np.isnan(x.astype(np.float64))))
                    yield pa.RecordBatch.from_arrays(made, names=columns)

    return _contents(spark, files).mapInArrow(rows, schema)


def _contents(spark: SparkSession, files: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(files).select("path", "content")


def open_series(spark: SparkSession, pattern: str, variable: str, time: str = "time", point: str | None = None) -> DataFrame:
    """``(time, [level,] point_id, value)`` of a variable over the files of a series, read as one: the
    time axis runs on from file to file in order of their names, counted from 0, unless the files
    have a variable of its name, whose values are then taken. The last dimension is the points, one
    between is the levels."""
    files = matching(spark, pattern)
    if not files:
        raise FileNotFoundError(pattern)
    head = read_header(spark, files[0])
    dims = head.variables[variable].dims
    named = time in head.variables
    rows = read_variables(spark, pattern, [variable, *([time] if named else [])], head)
    if not named and time in dims:
        starts = np.append(0, np.cumsum(_sizes(spark, files, time))).tolist()[:-1]
        rows = rows.withColumn(time, F.get(F.array(*(F.lit(s) for s in starts)), F.col("file")) + F.col(time))
    rest = [d for d in dims if d != time]
    at = [F.col(time).alias("time")] if named or time in dims else []
    levels = [F.col(rest[-2]).cast("int").alias("level")] if len(rest) > 1 else []
    return rows.select(*at, *levels, F.col(point or rest[-1]).alias("point_id"), F.col(variable).cast("double").alias("value"))


def _sizes(spark: SparkSession, files: list[str], dim: str) -> list[int]:
    """The size of a dimension in each of the files, from their headers."""

    def run(batches):
        for b in batches:
            found = [header(raw.as_buffer().to_pybytes()).dims[dim] for raw in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], names=["path", "n"])

    heads = _contents(spark, files).withColumn("content", F.substring("content", 1, HEADER_BYTES))
    sizes = {r.path: r.n for r in heads.mapInArrow(run, "path string, n long").collect()}
    return [sizes[f] for f in files]


def export_grid(gridded: DataFrame, folder: str, keys: list[str] = (), value: str = "value", name: str = "value") -> list[str]:
    """Write a gridded table ``(keys..., i_lat, i_lon, lon, lat, value)`` as classic netCDF, one file
    for each combination of keys; returns their paths. A task holds one grid at a time, and files
    pass through the driver one after another, since only it writes by any path."""
    spark, keys = gridded.sparkSession, list(keys)

    def make(key: tuple, table: pa.Table) -> pa.Table:
        i, j = table["i_lat"].to_numpy(), table["i_lon"].to_numpy()
        ni, nj = int(i.max()) + 1, int(j.max()) + 1
        lat, lon, field = np.full(ni, np.nan), np.full(nj, np.nan), np.full((ni, nj), np.nan)
        lat[i], lon[j] = table["lat"].to_numpy(), table["lon"].to_numpy()
        field[i, j] = table["__v"].to_numpy(zero_copy_only=False)
        raw = encode({"lat": ni, "lon": nj}, {"lat": (("lat",), lat, {"units": "degrees_north"}), "lon": (("lon",), lon, {"units": "degrees_east"}), name: (("lat", "lon"), field, {})}, {k: str(v.as_py()) for k, v in zip(keys, key)})
        tag = "_".join(str(v.as_py()) for v in key) or "all"
        return pa.table({"tag": pa.array([tag]), "content": pa.array([raw], pa.binary())})

    ready = gridded.select(*keys, "i_lat", "i_lon", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"), F.col(value).cast("double").alias("__v"))
    made = ready.groupBy(*(keys or [F.lit(0).alias("all")])).applyInArrow(make, "tag string, content binary")
    paths = []
    for row in made.toLocalIterator():
        path = f"{folder}/{name}_{row.tag}.nc"
        write_bytes(spark, path, bytes(row.content))
        paths.append(path)
    return sorted(paths)
