"""Classic netCDF: headers, values, series and exports."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.sources import files, netcdf


def text(s):
    return struct.pack(">i", len(s)) + s.encode() + b"\0" * (-len(s) % 4)


def records_file():
    """A CDF-1 file by hand: an unlimited time with a short and a double variable on it."""
    dims = struct.pack(">ii", 10, 2) + text("time") + struct.pack(">i", 0) + text("x") + struct.pack(">i", 3)
    unit = struct.pack(">ii", 12, 2) + text("units") + struct.pack(">ii", 2, 3) + b"day\0" + text("scale_factor") + struct.pack(">iid", 6, 1, 0.5)
    none = struct.pack(">ii", 0, 0)

    def body(a, b):
        one = text("a") + struct.pack(">iii", 2, 0, 1) + unit + struct.pack(">iii", 3, 8, a)
        two = text("t") + struct.pack(">ii", 1, 0) + none + struct.pack(">iii", 6, 8, b)
        return b"CDF\x01" + struct.pack(">i", 2) + dims + none + struct.pack(">ii", 11, 2) + one + two

    at = len(body(0, 0))
    rows = b"".join(struct.pack(">hhhxxd", 3 * t, 3 * t + 1, 3 * t + 2, 100.0 + t) for t in range(2))
    return body(at, at + 8) + rows


def test_records_and_packed_values():
    raw = records_file()
    head = netcdf.header(raw)
    assert head.dims == {"time": 2, "x": 3} and head.record_bytes == 16 and head.variables["a"].attributes == {"units": "day", "scale_factor": 0.5}
    assert netcdf.values(raw, head, "a").tolist() == [[0.0, 0.5, 1.0], [1.5, 2.0, 2.5]]
    assert netcdf.values(raw, head, "t").tolist() == [100.0, 101.0]


def test_written_files_are_read_back():
    arrays = {"f": np.arange(6.0).reshape(2, 3), "i": np.array([1, 2, 3], "i4"), "b": np.array([1, 0], "i1"), "big": np.array([2**40, 1], "i8")}
    dims = {"f": ("y", "x"), "i": ("x",), "b": ("y",), "big": ("y",)}
    raw = netcdf.encode({"y": 2, "x": 3}, {k: (dims[k], v, {"units": "m", "level": 2.5}) for k, v in arrays.items()}, {"title": "odd"})
    head = netcdf.header(raw)
    assert head.attributes == {"title": "odd"} and head.variables["f"].attributes == {"units": "m", "level": 2.5}
    for k, v in arrays.items():
        assert np.array_equal(netcdf.values(raw, head, k), v)
    with pytest.raises(ValueError, match="shape"):
        netcdf.encode({"y": 2}, {"f": (("y",), np.zeros(3), {})})


def test_other_formats_are_told():
    with pytest.raises(ValueError, match="netCDF-4"):
        netcdf.header(b"\x89HDF\r\n")
    with pytest.raises(ValueError, match="not a netCDF"):
        netcdf.header(b"PAR1abcd")


def test_tables_and_series(spark, tmp_path):
    for k in range(2):
        files.write_bytes(spark, f"{tmp_path}/s_{k}.nc", records_file())
    rows = netcdf.read_variables(spark, f"{tmp_path}/s_0.nc", ["a", "t"]).orderBy("time", "x").collect()
    assert [(r.time, r.x, r.a, r.t) for r in rows][3:] == [(1, 0, 1.5, 101.0), (1, 1, 2.0, 101.0), (1, 2, 2.5, 101.0)]
    series = netcdf.open_series(spark, f"{tmp_path}/s_*.nc", "a").orderBy("time", "point_id").collect()
    assert [r.time for r in series] == [t for t in range(4) for _ in range(3)] and [r.value for r in series] == [0, 0.5, 1, 1.5, 2, 2.5] * 2
    raw = netcdf.encode({"time": 1, "x": 2}, {"time": (("time",), np.array([7.5]), {}), "v": (("time", "x"), np.array([[1.0, -9.0]]), {"missing_value": -9.0})})
    files.write_bytes(spark, f"{tmp_path}/n.nc", raw)
    named = netcdf.open_series(spark, f"{tmp_path}/n.nc", "v").orderBy("point_id").collect()
    assert [(r.time, r.point_id, r.value) for r in named] == [(7.5, 0, 1.0), (7.5, 1, None)]
    with pytest.raises(ValueError, match="no variables"):
        netcdf.read_variables(spark, f"{tmp_path}/n.nc", ["w"])
    with pytest.raises(FileNotFoundError):
        netcdf.open_series(spark, f"{tmp_path}/none_*.nc", "v")


def test_files_by_any_path(spark, tmp_path):
    files.write_bytes(spark, f"file://{tmp_path}/a/b.bin", b"abc")
    assert files.exists(spark, f"{tmp_path}/a/b.bin") and files.is_folder(spark, f"{tmp_path}/a") and not files.is_folder(spark, f"{tmp_path}/a/b.bin")
    assert len(files.matching(spark, f"{tmp_path}/a/*.bin")) == 1 and files.matching(spark, f"{tmp_path}/none/*") == []
    assert files.scratch(spark, "x") != files.scratch(spark, "x")


def test_export_without_keys(spark, tmp_path):
    grid = spark.createDataFrame([(0, 0, 1.0, 2.0, 5.0), (0, 1, 3.0, 2.0, None)], "i_lat int, i_lon int, lon double, lat double, value double")
    (path,) = netcdf.export_grid(grid, str(tmp_path))
    got = netcdf.read_variables(spark, path, ["value"]).select("lat", "lon", F.col("value")).orderBy("lon").collect()
    assert [tuple(r) for r in got] == [(0, 0, 5.0), (0, 1, None)]


def test_tables_are_written_as_arrays_are(spark, tmp_path):
    rows = spark.range(0, 60_000, 1, 7).select(F.col("id").alias("at"), (F.col("id") * 7919 % 60_000).alias("other"), F.when(F.col("id") % 9 != 0, F.col("id") * 257.25).alias("v"), (F.col("id") * 10).cast("int").alias("n"), (F.col("id") % 11).cast("tinyint").alias("b"))
    at = np.arange(60_000)
    v = np.where(at % 9 != 0, at * 257.25, -1.0)
    by_other = np.empty(60_000)
    by_other[at * 7919 % 60_000] = v
    dims, few = {"y": 2, "x": 30_000, "z": 60_000, "one": 1}, (("one",), np.array([2.0]), {})
    arrays = {"v": (("y", "x"), v.reshape(2, -1), {"_FillValue": -1.0}), "few": few, "o": (("z",), by_other, {"_FillValue": -1.0}), "n": (("z",), (at * 10).astype("i4"), {}), "b": (("z",), (at % 11).astype("i1"), {})}
    tables = {k: (arrays[k][0], netcdf.Rows(rows, (order,), name), arrays[k][2]) for k, order, name in (("v", "at", "v"), ("o", "other", "v"), ("n", "at", "n"), ("b", "at", "b"))}
    netcdf.write(spark, f"{tmp_path}/a.nc", dims, {k: tables.get(k, few) for k in arrays}, {"title": "odd"})
    assert (tmp_path / "a.nc").read_bytes() == netcdf.encode(dims, arrays, {"title": "odd"})
    for n in (59_999, 60_001):
        with pytest.raises(ValueError, match="values than its dimensions"):
            netcdf.write(spark, f"{tmp_path}/b.nc", {"z": n}, {"n": (("z",), netcdf.Rows(rows, ("at",), "n"), {})})


def test_times_run_on_over_files_of_unlike_length(spark, tmp_path):
    for k, n in enumerate((1, 1, 3)):
        raw = netcdf.encode({"time": n, "x": 2}, {"v": (("time", "x"), np.full((n, 2), float(k)), {})})
        files.write_bytes(spark, f"{tmp_path}/t_{k}.nc", raw)
    rows = netcdf.open_series(spark, f"{tmp_path}/t_*.nc", "v").where("point_id = 1").orderBy("time").collect()
    assert [(r.time, r.value) for r in rows] == [(0, 0.0), (1, 1.0), (2, 2.0), (3, 2.0), (4, 2.0)]


@pytest.mark.parametrize("name", ["series_of_files", "netcdf_mesh", "netcdf_area_by_level", "reduced_netcdf"])
def test_written_values_do_not_come_to_the_driver(spark, sf_dir, monkeypatch, name):
    from halocline.plans import catalogue

    points, got = spark.read.parquet(f"{sf_dir}/customer.parquet").count(), []
    kind = type(spark.range(1))
    for method in ("toArrow", "collect", "toPandas"):
        real = getattr(kind, method)

        def counted(self, *a, real=real, **b):
            out = real(self, *a, **b)
            got.append(len(out))
            return out

        monkeypatch.setattr(kind, method, counted)
    catalogue.QUERIES[name](spark, sf_dir)
    assert max(got) < min(points, 50)
