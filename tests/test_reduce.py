import math

import pytest
from pyspark.sql import functions as F

from halocline.operators import reduce

NAN = float("nan")


def mesh(spark, areas, lats=None):
    lats = lats or [0.0] * len(areas)
    return spark.createDataFrame([(i, 0.0, float(b), float(a)) for i, (a, b) in enumerate(zip(areas, lats))], "point_id long, lon double, lat double, area double")


def surface(spark, name, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"point_id long, {name} double")


def volume(spark, levels, name="value", time=None):
    rows = [(lv, p, None if v is None else float(v)) for lv, row in enumerate(levels) for p, v in enumerate(row)]
    return spark.createDataFrame(rows, f"level int, point_id long, {name} double")


def axis(spark, depths, thickness):
    return spark.createDataFrame([(i, float(d), float(t)) for i, (d, t) in enumerate(zip(depths, thickness))], "level int, depth double, thickness double")


def value(df):
    return df.first()[-1]


@pytest.mark.parametrize(
    "c, expected",
    [([0.0, 0.5, 0.8, 1.0], 2.3e6), ([0.5, None, 0.5, 1.0], 2e6), ([0.5, NAN, 0.5, 1.0], 2e6), ([1.5, -0.5, 0.5, 0.5], 2e6), ([None] * 4, 0.0)],
)
def test_ice_area(spark, c, expected):
    assert value(reduce.ice_area(surface(spark, "concentration", c), mesh(spark, [1e6] * 4))) == pytest.approx(expected)


def test_ice_area_mask_and_hemispheres(spark):
    m, f = mesh(spark, [1.0] * 3, [10, -10, 0]), surface(spark, "concentration", [1.0, 1.0, 1.0])
    assert value(reduce.ice_area(f, m, mask=F.col("point_id") < 2)) == 2
    assert value(reduce.ice_area(f, m, mask=m.where("point_id = 2"))) == 1
    assert value(reduce.ice_area_nh(f, m)) == 1 and value(reduce.ice_area_sh(f, m)) == 1
    with pytest.raises(ValueError):
        reduce.ice_area(f, m, hemisphere="east")


def test_ice_volume(spark):
    m = mesh(spark, [1e6] * 4)
    assert value(reduce.ice_volume(surface(spark, "thickness", [0.0, 1.0, 2.0, 3.0]), m)) == pytest.approx(6e6)
    both = surface(spark, "thickness", [2.0] * 4).join(surface(spark, "concentration", [0.5, 0.5, 1.0, 0.0]), "point_id")
    assert value(reduce.ice_volume(both, m, concentration="concentration")) == pytest.approx(4e6)
    assert value(reduce.ice_volume(surface(spark, "thickness", [-1.0, NAN, None, 1.0]), m)) == pytest.approx(1e6)


def test_ice_extent_is_inclusive_and_ignores_nan(spark):
    m = mesh(spark, [1e6] * 5)
    assert value(reduce.ice_extent(surface(spark, "concentration", [0.0, 0.10, 0.15, 0.20, 1.0]), m)) == pytest.approx(3e6)
    assert value(reduce.ice_extent(surface(spark, "concentration", [NAN, NAN, None, 0.1, 1.0]), m)) == pytest.approx(1e6)


def test_surface_mean(spark):
    m = mesh(spark, [3e6, 1e6])
    assert value(reduce.surface_mean(surface(spark, "value", [10.0, 20.0]), m)) == pytest.approx(12.5)
    assert value(reduce.surface_mean(surface(spark, "value", [10.0, NAN]), m)) == pytest.approx(10)
    assert value(reduce.surface_mean(surface(spark, "value", [None, NAN]), m)) is None
    assert value(reduce.surface_mean(surface(spark, "value", [1.0, 2.0]), m, mask=F.lit(False))) is None


def test_volume_mean(spark):
    m = mesh(spark, [1.0, 1.0])
    assert value(reduce.volume_mean(volume(spark, [[10, 10], [20, 20]]), m, axis(spark, [15, 35], [30, 10]))) == pytest.approx(12.5)
    three = volume(spark, [[10, 10], [20, 20], [30, 30]])
    assert value(reduce.volume_mean(three, m, axis(spark, [50, 150, 300], [100, 100, 200]), depth_max=200)) == pytest.approx(15)
    with pytest.raises(ValueError, match="depth array required"):
        reduce.volume_mean(three, m, axis(spark, [1, 2, 3], [1, 1, 1]).drop("depth"), depth_max=2)


def test_level_check():
    with pytest.warns(UserWarning, match="one more vertical level"):
        assert reduce.check_levels(3, 4) == 3
    with pytest.raises(ValueError, match="levels"):
        reduce.check_levels(3, 6)


def test_levels_of_all_tables_are_held_together(spark):
    m, z = mesh(spark, [1.0, 1.0]), axis(spark, [15, 35], [30, 10])
    data = volume(spark, [[10, 10], [20, 20]])
    area = volume(spark, [[3, 1], [1, 3], [9, 9]]).withColumnRenamed("value", "area")
    with pytest.warns(UserWarning, match="one more vertical level"):
        assert value(reduce.volume_mean(data, m, z, area3d=area)) == pytest.approx(12.5)
    with pytest.warns(UserWarning, match="one more vertical level"):
        reduce.hovmoller(data.withColumn("time", F.lit(1)), m, z, area3d=area)
    with pytest.raises(ValueError, match="levels"):
        reduce.volume_mean(data, m, z, area3d=area.where("level = 0"))
    with pytest.raises(ValueError, match="levels"):
        reduce.volume_mean(data, m, z, thickness3d=area.withColumnRenamed("area", "thickness"))
    with pytest.raises(Exception, match="depth axis has no level 1"):  # found in the pass itself
        reduce.volume_mean(data, m, z.where("level = 0")).collect()


def test_heat_content(spark):
    m, z = mesh(spark, [1e6, 1e6]), axis(spark, [50, 150], [100, 100])
    rc = 1025.0 * 3990.0
    f = volume(spark, [[10, 10], [10, 10]], "temperature")
    assert value(reduce.heat_content(f, m, z)) == pytest.approx(rc * 10 * 4e8)
    f = volume(spark, [[10, 10], [10, None]], "temperature")
    assert value(reduce.heat_content(f, m, z)) == pytest.approx(rc * 10 * 3e8)
    f = volume(spark, [[10, 20], [10, 20]], "temperature")
    got = {r.point_id: r.heat_content for r in reduce.heat_content(f, m, z, output="map").collect()}
    assert got == pytest.approx({0: rc * 2000, 1: rc * 4000})
    got = {r.point_id: r.heat_content for r in reduce.heat_content(f, m, z, output="map", mask=F.col("point_id") == 0).collect()}
    assert got == pytest.approx({0: rc * 2000, 1: 0.0})
    with pytest.raises(ValueError, match="output must be 'total' or 'map'"):
        reduce.heat_content(f, m, z, output="x")


def test_hovmoller_depth(spark):
    m, z = mesh(spark, [3.0, 1.0]), axis(spark, [5, 15], [10, 10])
    f = volume(spark, [[10, 30], [20, 40]]).withColumn("time", F.lit(0))
    got = reduce.hovmoller(f, m, z).orderBy("y").collect()
    assert [(r.y, r.value) for r in got] == [(5, 15), (15, 25)]
    inf = f.withColumn("value", F.when(F.col("level") == 0, float("inf")).otherwise(F.col("value")))
    assert [r.value for r in reduce.hovmoller(inf, m, z).orderBy("y").collect()] == [None, 25]
    with pytest.raises(ValueError, match="Invalid mode"):
        reduce.hovmoller(f, m, z, mode="x")
    with pytest.raises(ValueError, match="depth array required"):
        reduce.hovmoller(f, m)


def test_hovmoller_latitude(spark):
    m = mesh(spark, [1.0, 3.0, 1.0], [90, 89, -89])
    f = surface(spark, "value", [1.0, 2.0, 7.0]).withColumn("time", F.lit(0))
    got = reduce.hovmoller(f, m, mode="latitude").orderBy("y").collect()
    assert len(got) == 36
    assert got[0].value == 7 and got[-1].value == pytest.approx(1.75) and got[10].value is None
    got = reduce.hovmoller(f, m, mode="latitude", lat_bins=[-90, -45, 0, 45, 90]).orderBy("y").collect()
    assert [r.y for r in got] == [-67.5, -22.5, 22.5, 67.5]
    with pytest.raises(ValueError, match="lat array required"):
        reduce.hovmoller(f, m.drop("lat"), mode="latitude")


def test_uneven_bins_clamp(spark):
    edges = [-60.0, 0.0, 10.0]
    got = spark.createDataFrame([(-80.0,), (-60.0,), (0.0,), (9.0,), (50.0,), (None,), (NAN,)], "lat double").select(reduce.latitude_bin(F.col("lat"), edges)).collect()
    assert [r[0] for r in got] == [0, 0, 1, 1, 1, None, None]


def test_anomaly(spark):
    f = spark.createDataFrame([(0, 5.0, 1.0), (1, 5.0, 4.0), (0, 9.0, 2.0), (1, 9.0, 1.0)], "time int, y double, value double")
    got = {(r.time, r.y): r.value for r in reduce.hovmoller_anomaly(f).collect()}
    assert got == {(0, 5.0): 0, (1, 5.0): 3, (0, 9.0): 0, (1, 9.0): -1}
    assert reduce.hovmoller_anomaly(f, mode="latitude") is f
    assert math.isclose(got[(1, 5.0)], 3)
