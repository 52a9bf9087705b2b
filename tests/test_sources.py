import math

import pytest
from pyspark.sql import functions as F

from halocline.sources import healpix, load
from halocline.sources.mesh import open_dataset
from halocline.streaming.ice import windowed_reduction


@pytest.fixture
def text_mesh(tmp_path):
    (tmp_path / "nod2d.out").write_text("4\n1 0.0 0.0 0\n2 1.0 0.0 0\n3 0.5 1.0 0\n4 1.5 1.0 0\n")
    (tmp_path / "elem2d.out").write_text("2\n1 2 3\n2 4 3\n")
    (tmp_path / "aux3d.out").write_text("3\n0.0\n10.0\n100.0\n")
    return str(tmp_path)


def test_text_mesh(spark, text_mesh):
    mesh = load.load_mesh(spark, text_mesh)
    assert mesh.kind == "fesom"
    assert [(r.n0, r.n1, r.n2) for r in mesh.elements.orderBy("elem_id").collect()] == [(0, 1, 2), (1, 3, 2)]
    assert [(r.depth, r.thickness) for r in mesh.levels.orderBy("level").collect()] == [(5, 10), (55, 90)]
    assert mesh.points.where("area > 0").count() == 4
    field = spark.createDataFrame([(0, 0, 1.0)], "level int, point_id long, value double")
    assert open_dataset(field, mesh).first().depth == 5
    with pytest.raises(ValueError, match="Either mesh or mesh_path"):
        open_dataset(field)


def test_nodes_only(spark, tmp_path):
    (tmp_path / "nod2d.out").write_text("3\n1 270.0 0.0 0\n2 10.0 0.0 0\n3 5.0 10.0 0\n")
    points = load.load_mesh(spark, str(tmp_path), "fesom").points
    assert points.orderBy("point_id").first().lon == -90
    assert points.agg(F.sum("area")).first()[0] == pytest.approx(4 * math.pi * 6_371_000.0**2)


def test_dispatch_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="Could not auto-detect"):
        load.load_mesh(spark, str(tmp_path / "what.bin"))
    for bad in ((100, "fesom"), ("x", "healpix"), (192, "auto")):
        with pytest.raises(ValueError):
            load.load_mesh(spark, *bad)
    with pytest.raises(FileNotFoundError):
        load.load_mesh(spark, str(tmp_path), "fesom")


def test_columnar_mesh(spark, tmp_path):
    nodes = spark.createDataFrame([(0, 350.0, 0.0, 2.0), (1, 1.0, 1.0, 3.0), (2, 2.0, 0.0, 4.0)], "point_id long, longitude double, latitude double, nod_area double")
    elems = spark.createDataFrame([(0, [1, 2, 3])], "elem_id long, face_nodes array<long>")
    mesh = load.load_columnar_mesh(nodes, elems)
    assert [r.lon for r in mesh.points.orderBy("point_id").collect()] == [-10, 1, 2]
    assert tuple(mesh.elements.first())[1:] == (0, 1, 2)
    nodes.write.parquet(str(tmp_path / "nodes.parquet"))
    assert load.load_mesh(spark, str(tmp_path)).points.count() == 3
    deep = spark.createDataFrame([(0, 0, 5.0), (1, 0, 0.0)], "level int, point_id long, area double")
    mesh = load.load_columnar_mesh(nodes.drop("nod_area"), None, None, deep)
    assert mesh.points.orderBy("point_id").first().area == 5
    assert mesh.area3d.where("level = 1").first().area is None


def test_structured_mesh(spark):
    rows = [(j, i, 10.0 * i, 10.0 * j, int((j, i) != (0, 1)), 2.0, 3.0) for j in range(2) for i in range(3)]
    mesh = load.load_structured(spark.createDataFrame(rows, "j long, i long, glamt double, gphit double, tmask int, e1t double, e2t double"))
    got = mesh.points.orderBy("point_id").collect()
    assert [(r.point_id, r.flat_idx, r.area) for r in got] == [(0, 0, 6), (1, 2, 6), (2, 3, 6), (3, 4, 6), (4, 5, 6)]


def test_prefixed_mesh(spark):
    grid = spark.createDataFrame([(0, 1.0, 1.0, 190.0, 45.0), (1, 2.0, 2.0, 10.0, 10.0), (2, None, None, 200.0, -30.0), (3, None, None, -170.0, 60.0)], "point_id long, `A1.lon` double, `A1.lat` double, `A2.lon` double, `A2.lat` double")
    area = spark.createDataFrame([(i, float(i + 1)) for i in range(4)], "point_id long, `A2.srf` double")
    mesh = load.load_prefixed(grid, area)
    assert [(r.lon, r.lat, r.area) for r in mesh.points.orderBy("point_id").collect()] == [(-170, 45, 1), (10, 10, 2), (-160, -30, 3), (-170, 60, 4)]
    assert mesh.extra["prefix"] == "A2"
    with pytest.raises(ValueError):
        load.load_prefixed(grid, area.withColumnRenamed("A2.srf", "A9.srf"))


def test_healpix(spark):
    for nside in (1, 2, 8):
        n = 12 * nside * nside
        ring, nest = (healpix.healpix_mesh(spark, n, nest=k).points for k in (False, True))
        keys = lambda p: sorted((round(r.lat, 6), round(r.lon, 6) % 360) for r in p.collect())
        assert keys(ring) == keys(nest) and len(set(keys(ring))) == n
        assert ring.agg(F.sum("area")).first()[0] == pytest.approx(4 * math.pi * 6_371_000.0**2)
        assert ring.agg(F.sum("lat")).first()[0] == pytest.approx(0, abs=1e-6)
    with pytest.raises(ValueError):
        healpix.npoints_to_nside(13)
    assert healpix.resolution_to_nside(1.0) == 64 and healpix.nside_to_npoints(64) == 49152


def test_streaming_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 00:{m:02d}:00", m % 3, float(m)) for m in range(60)], "t string, point_id long, value double")
    rows = rows.select(F.to_timestamp("t").alias("ts"), "point_id", "value")
    mesh = spark.createDataFrame([(i, float(i + 1)) for i in range(3)], "point_id long, area double")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    want = sorted(map(tuple, windowed_reduction(rows, mesh, window="10 minutes").collect()))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_reduction(stream, mesh, window="10 minutes").writeStream.format("memory").queryName("ice_windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("select * from ice_windows").collect())) == want and len(want) == 6
