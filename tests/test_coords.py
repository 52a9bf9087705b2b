import math

import pytest
from pyspark.sql import functions as F

from halocline.functions import coords

R = 6_371_000.0


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_cartesian_round_trip(spark):
    rows = spark.createDataFrame([(0.0, 0.0), (90.0, 0.0), (-120.5, 33.0), (10.0, -89.0)], "lon double, lat double")
    x, y, z = coords.lonlat_to_cartesian("lon", "lat", radius=3.0)
    lon, lat = coords.cartesian_to_lonlat(x, y, z)
    for r in rows.select("lon", "lat", lon.alias("a"), lat.alias("b"), (x * x + y * y + z * z).alias("n")).collect():
        assert (r.a, r.b) == pytest.approx((r.lon, r.lat), abs=1e-9)
        assert r.n == pytest.approx(9.0)


def test_origin_has_no_latitude(spark):
    assert one(spark, coords.cartesian_to_lonlat(0.0, 0.0, 0.0)[1]) == (None,)


def test_chords():
    assert coords.meters_to_chord(math.pi * R / 2) == pytest.approx(math.sqrt(2))
    assert coords.chord_to_meters(coords.meters_to_chord(123_456.0)) == pytest.approx(123_456.0)


def test_great_circle(spark):
    d = coords.great_circle_distance
    quarter, half, same = one(spark, d(0.0, 0.0, 0.0, 90.0), d(0.0, 0.0, 180.0, 0.0), d(5.0, 5.0, 5.0, 5.0))
    assert quarter == pytest.approx(math.pi * R / 2)
    assert half == pytest.approx(math.pi * R)
    assert same == 0
    assert one(spark, d(-74.006, 40.7128, -0.1278, 51.5074))[0] == pytest.approx(5_570_000, rel=0.02)


def test_normalize_lon(spark):
    given = [0, 90, 180, 270, 360, -90, -180]
    got = one(spark, *(coords.normalize_lon(float(v)).alias(f"c{i}") for i, v in enumerate(given)))
    assert got == (0, 90, -180, -90, 0, -90, -180)
    got = one(spark, *(coords.normalize_lon(float(v), "0360").alias(f"c{i}") for i, v in enumerate([0, 90, -90, -180, 180, 270])))
    assert got == (0, 90, 270, 180, 180, 270)
    with pytest.raises(ValueError):
        coords.normalize_lon(1.0, "other")


def test_ensure_lon_keeps_exact_180(spark):
    df = spark.createDataFrame([(180.0,), (0.0,)], "lon double")
    assert sorted(r.lon for r in coords.ensure_lon_pm180(df).collect()) == [0, 180]
    df = spark.createDataFrame([(180.0,), (270.0,)], "lon double")
    assert sorted(r.lon for r in coords.ensure_lon_pm180(df).collect()) == [-180, -90]
    other = spark.range(1)
    assert coords.ensure_lon_pm180(other) is other


def test_path_ends_and_middle(spark):
    rows = coords.great_circle_path(spark, (0.0, 0.0), (90.0, 0.0), 3).orderBy("i").collect()
    assert [round(r.lon, 9) for r in rows] == [0, 45, 90]
    assert all(abs(r.lat) < 1e-9 for r in rows)


def test_element_center_across_the_date_line(spark):
    lon, lat = coords.element_center([F.lit(179.0), F.lit(-179.0), F.lit(179.0)], [F.lit(0.0), F.lit(3.0), F.lit(0.0)])
    a, b = one(spark, lon, lat)
    assert a == pytest.approx(179 + 2 / 3)
    assert b == pytest.approx(1.0)


def test_triangle_area_is_plane(spark):
    lons, lats = [F.lit(0.0), F.lit(90.0), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(90.0)]
    assert one(spark, coords.triangle_area(lons, lats))[0] == pytest.approx(math.sqrt(3) / 2 * R * R)
