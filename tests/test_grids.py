import math

import pytest
from pyspark.sql import functions as F

from halocline.operators import grids, shaping
from halocline.sources.mesh import Mesh, find_coordinates, lonlat_mesh, mesh_from_df, validate_mesh, with_metadata

R = 6_371_000.0


def test_regular_grid(spark):
    first = grids.regular_grid(spark, 10).orderBy("cell_id").first()
    assert (first.lon, first.lat) == (-175, -85)
    first = grids.regular_grid(spark, 10, center="node").orderBy("cell_id").first()
    assert (first.lon, first.lat) == (-180, -90)
    g = grids.regular_grid(spark, 1.0, (0, 30), (40, 60))
    assert g.count() == 600 and g.agg(F.max("i_lat"), F.max("i_lon")).first() == (19, 29)
    assert grids.regular_grid(spark, (4, 2)).count() == 8


def test_areas_cover_the_globe(spark):
    total = lonlat_mesh(spark, 5.0).points.agg(F.sum("area")).first()[0]
    assert total == pytest.approx(4 * math.pi * R**2)
    g = grids.regular_grid(spark, 2.0).withColumn("a", grids.grid_cell_area(F.col("lat"), 2.0, 2.0))
    north, south = g.agg(F.sum(F.when(F.col("lat") > 0, F.col("a"))), F.sum(F.when(F.col("lat") < 0, F.col("a")))).first()
    assert north == pytest.approx(south)
    assert north + south == pytest.approx(4 * math.pi * R**2, rel=0.01)


def test_estimated_area_sums_to_the_globe(spark):
    df = spark.createDataFrame([(i, float(i * 30 - 180), float(i * 10 - 60)) for i in range(12)], "point_id long, lon double, lat double")
    assert mesh_from_df(df).points.agg(F.sum("area")).first()[0] == pytest.approx(4 * math.pi * R**2)


def test_vertical_metrics(spark):
    rows = grids.vertical_metrics(spark.createDataFrame([(0, 0.0), (1, 10.0), (2, 100.0)], "level int, depth double")).orderBy("level").collect()
    assert [(r.depth, r.thickness, r.depth_top, r.depth_bottom) for r in rows] == [(5, 10, 0, 10), (55, 90, 10, 100)]


def test_polar_bounds():
    lon, lat = grids.expand_bounds_for_polar((-10, 10), (70, 90), 2.0)
    assert lon == (-20, 20) and lat == (60, 90)


def test_coordinate_names():
    assert find_coordinates(["NAV_LAT", "Lon", "x"]) == ("Lon", "NAV_LAT")
    assert find_coordinates(["a"]) == (None, None)


def test_validate_mesh(spark):
    p = spark.createDataFrame([(0, 200.0, 95.0, 0.0)], "point_id long, lon double, lat double, area double")
    e = spark.createDataFrame([(0, -1, 0, 7)], "elem_id long, n0 long, n1 long, n2 long")
    said = validate_mesh(Mesh(p, elements=e))
    for part in ("1 points have a longitude", "1 points lie beyond a pole", "1 points have a non-positive", "1 triangles have a negative", "beyond the 1 points"):
        assert any(part in m for m in said)
    assert validate_mesh(Mesh(p.drop("area")))[0] == "the mesh has no column area"
    with pytest.raises(ValueError, match="breaks its conventions"):
        validate_mesh(Mesh(p), strict=True)
    assert validate_mesh(lonlat_mesh(spark, 30.0)) == []
    assert with_metadata(Mesh(p), "x", source="s").kind == "x"


def test_shaping(spark):
    lon = spark.createDataFrame([(0, 1.0), (1, 2.0)], "i int, lon double")
    lat = spark.createDataFrame([(0, 5.0), (1, 6.0), (2, 7.0)], "j int, lat double")
    with pytest.warns(UserWarning, match="Creating meshgrid"):
        assert shaping.prepare_coordinates(lon, lat).count() == 6
    lon2, lat2 = lon.withColumn("j", F.lit(0)), spark.createDataFrame([(0, 0, 3.0), (0, 1, 3.0)], "j int, i int, lat double")
    with pytest.warns(UserWarning, match="Raveling 2D lon/lat"):
        assert shaping.prepare_coordinates(lon2, lat2).count() == 2
    with pytest.raises(ValueError, match="both be 1D or both be 2D"):
        shaping.prepare_coordinates(lon2, lat)
    data = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "j int, i int, value double")
    with pytest.warns(UserWarning, match="Raveling 2D arrays"):
        assert shaping.prepare_input(data, lon2, lat2).count() == 2
    with pytest.raises(ValueError, match="Incompatible"):
        shaping.prepare_input(spark.range(1).withColumnRenamed("id", "q"), lon, lat)
