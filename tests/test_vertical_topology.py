import pytest
from pyspark.sql import functions as F

from halocline.operators import topology, vertical


def levels(spark, depths):
    return spark.createDataFrame([(i, float(d)) for i, d in enumerate(depths)], "level int, depth double")


def columns(spark, rows):
    return spark.createDataFrame([(lv, p, None if v is None else float(v)) for lv, row in enumerate(rows) for p, v in enumerate(row)], "level int, point_id long, value double")


def test_closest_depth(spark):
    z = levels(spark, [0, 10, 25, 50, 100, 200, 500, 1000])
    assert vertical.closest_depth(z, 60) == (3, 50.0)
    assert vertical.closest_depth(z, 90) == (4, 100.0)
    assert vertical.closest_depth(z, 5) == (0, 0.0)


def test_interpolation(spark):
    f, z = columns(spark, [[10, 20], [20, 40]]), levels(spark, [0, 100])
    got = {(r.point_id, r.depth): r.value for r in vertical.interpolate_to_depth(f, z, [25, 50, 75]).collect()}
    assert got == {(0, 25.0): 12.5, (0, 50.0): 15, (0, 75.0): 17.5, (1, 25.0): 25, (1, 50.0): 30, (1, 75.0): 35}


def test_decreasing_axis_and_unknown_values(spark):
    z = levels(spark, [100, 50, 0])
    got = vertical.interpolate_to_depth(columns(spark, [[20, 30], [15, 25], [10, 20]]), z, 25.0).orderBy("point_id").collect()
    assert [r.value for r in got] == [12.5, 22.5]
    got = vertical.interpolate_to_depth(columns(spark, [[None, 30], [15, None], [10, 20]]), z, 50.0).orderBy("point_id").collect()
    assert [r.value for r in got] == [15, None]


def test_extrapolation_warns_and_levels_must_match(spark):
    f, z = columns(spark, [[10], [20]]), levels(spark, [0, 100])
    with pytest.warns(UserWarning, match="Extrapolation"):
        assert vertical.interpolate_to_depth(f, z, 200).first().value == 30
    with pytest.raises(ValueError, match="levels"):
        vertical.interpolate_to_depth(f, levels(spark, [0, 1, 2]), 1)


@pytest.fixture(scope="module")
def elements(spark):
    return spark.createDataFrame([(0, 0, 1, 2), (1, 1, 3, 2)], "elem_id long, n0 long, n1 long, n2 long")


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.5, 1.0), (3, 1.5, 1.0), (4, 9.0, 9.0)], "point_id long, lon double, lat double")


def test_node_to_element(spark, elements):
    f = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0), (3, 4.0)], "point_id long, value double")
    run = lambda m, g=f: [r.value for r in topology.node_to_element(g, elements, method=m).orderBy("elem_id").collect()]
    assert run("mean") == [2, 3] and run("median") == [2, 3] and run("min") == [1, 2] and run("max") == [3, 4]
    assert run("max", f.withColumn("value", F.when(F.col("point_id") > 0, F.col("value")))) == [None, 4]
    with pytest.raises(ValueError):
        topology.node_to_element(f, elements, method="mode")


def test_element_to_node(spark, elements, nodes):
    f = spark.createDataFrame([(0, 1.0), (1, 3.0)], "elem_id long, value double")
    run = lambda m, g=f: [r.value for r in topology.element_to_node(g, elements, nodes, method=m).orderBy("point_id").collect()]
    assert run("mean") == [1, 2, 2, 3, 0] and run("sum") == [1, 4, 4, 3, 0]
    assert run("sum", f.withColumn("value", F.when(F.col("elem_id") > 0, F.col("value")))) == [None, None, None, 3, 0]
    keyed = f.withColumn("t", F.lit(1)).unionByName(f.withColumn("t", F.lit(2)))
    assert topology.element_to_node(keyed, elements, nodes, ["t"]).count() == 10


def test_areas_and_centers(spark, elements, nodes):
    areas = {r.elem_id: r.area for r in topology.triangle_areas(elements, nodes).collect()}
    got = {r.point_id: r.area for r in topology.cluster_area(elements, nodes).collect()}
    assert got == pytest.approx({0: areas[0] / 3, 1: (areas[0] + areas[1]) / 3, 2: (areas[0] + areas[1]) / 3, 3: areas[1] / 3, 4: 0.0})
    at = topology.element_centers(elements, nodes)
    assert at.orderBy("elem_id").first().lon_tri == pytest.approx(0.5)
    assert topology.element_centers(at, nodes) is at
    with pytest.raises(ValueError):
        topology.element_centers(elements.drop("n2"), nodes)


def test_mask_by_depth(spark):
    f = columns(spark, [[1, 2], [3, 4]])
    area = columns(spark, [[1, 1], [None, 1]]).withColumnRenamed("value", "area")
    got = {(r.level, r.point_id): r.value for r in topology.mask_by_depth(f, area).collect()}
    assert got == {(0, 0): 1, (0, 1): 2, (1, 0): None, (1, 1): 4}
    with pytest.raises(Exception, match="does not match nod_area_nans shape"):  # when it runs
        topology.mask_by_depth(f, area.where("level = 0")).collect()
