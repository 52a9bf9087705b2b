import math
import random

import pytest
from pyspark.sql import functions as F

from halocline.operators import regrid, sections, spatial
from halocline.plans import projections


@pytest.fixture(scope="module")
def nine(spark):
    return spark.createDataFrame([(j * 3 + i, float(i), float(j), 1.0) for j in range(3) for i in range(3)], "point_id long, lon double, lat double, area double")


def queries(spark, at):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(at)], "query_id long, lon double, lat double")


def xyz(lon, lat):
    a, b = math.radians(lon), math.radians(lat)
    return math.cos(b) * math.cos(a), math.cos(b) * math.sin(a), math.sin(b)


def test_nearest_on_a_small_grid(spark, nine):
    got = spatial.find_nearest(queries(spark, [(0.1, 0.1), (1, 1), (0, 0), (2, 2)]), nine).orderBy("query_id").collect()
    assert [r.point_id for r in got] == [0, 4, 0, 8]
    assert got[1].distance == 0


def test_k_beyond_the_mesh_gives_all(spark, nine):
    assert spatial.find_nearest(queries(spark, [(0, 0)]), nine, 20).count() == 9


def test_nearest_equals_brute_force(spark):
    rng = random.Random(3)
    pts = [(i, rng.uniform(-180, 180), math.degrees(math.asin(rng.uniform(-1, 1)))) for i in range(300)]
    at = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(40)] + [(180.0, 0.0), (-180.0, 0.0), (0.0, 90.0), (0.0, -90.0)]
    got = spatial.find_nearest(queries(spark, at), spark.createDataFrame(pts, "point_id long, lon double, lat double"), 3)
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.point_id)
    for q, (lon, lat) in enumerate(at):
        want = sorted((math.dist(xyz(lon, lat), xyz(a, b)), i) for i, a, b in pts)[:3]
        assert found[q] == [i for _, i in want]


def test_bbox_and_polygon(spark, nine):
    assert spatial.subset_by_bbox(nine, 0, 1, 0, 1).count() == 4
    assert spatial.subset_by_bbox(nine, 1, 0, 0, 1).count() == 0
    inside = spatial.points_in_polygon(nine, [0.5, 1.5, 1.5, 0.5], [0.5, 0.5, 1.5, 1.5]).where("inside").collect()
    assert [r.point_id for r in inside] == [4]


def test_regions(spark):
    at = queries(spark, [(-145, 0), (-170, 0), (-125, 4.9), (170, 0), (-175, 0), (180, 0), (-145, 5)])
    got = {n: [r.query_id for r in at.where(spatial.region_mask(F.col("lon"), F.col("lat"), n)).orderBy("query_id").collect()] for n in spatial.REGIONS}
    assert got == {"Nino 3.4": [0, 2], "Nino 3": [0, 2], "Nino 4": [1, 3, 4]}
    assert spatial.list_available_regions() == ["Nino 3.4", "Nino 3", "Nino 4"]
    with pytest.raises(ValueError, match="Available regions"):
        spatial.region_mask(F.col("lon"), F.col("lat"), "Atlantis")
    with pytest.raises(FileNotFoundError):
        spatial.load_geojson("MOCBasins")


def test_regrid_and_fill(spark, nine):
    field = nine.select("point_id", F.col("point_id").cast("double").alias("value"))
    out, made = regrid.regrid(field, nine, resolution=1.0, lon_bounds=(-0.5, 3.5), lat_bounds=(-0.5, 2.5), fill_value=-1.0)
    got = {(r.i_lat, r.i_lon): r.value for r in out.collect()}
    assert made.shape == (3, 4)
    assert [got[(j, i)] for j in range(3) for i in range(3)] == list(range(9))
    assert got[(0, 3)] == -1
    timed = field.withColumn("t", F.lit(1)).unionByName(field.withColumn("t", F.lit(2)))
    assert made(timed, ["t"]).count() == 24
    with pytest.raises(ValueError, match="lon and lat coordinates are required"):
        regrid.regrid(field, None)


def test_cache(spark, nine, tmp_path):
    cache = regrid.WeightsCache(1, str(tmp_path))
    a = cache.get_or_create(nine, resolution=45.0)
    assert cache.get_or_create(nine, resolution=45.0) is a
    cache.get_or_create(nine, resolution=90.0)
    assert len(cache) == 1
    assert cache.get_or_create(nine, resolution=45.0).weights.count() == a.shape[0] * a.shape[1]
    moved = nine.withColumn("lon", F.col("lon") + 1e-9)
    assert cache.key(nine) != cache.key(moved)
    cache.clear()
    assert len(cache) == 0


def test_transect(spark, nine):
    levels = spark.createDataFrame([(0, 10.0)], "level int, depth double")
    field = nine.select("point_id", F.col("point_id").cast("double").alias("value"))
    rows = sections.transect(field, nine, levels, (0.0, 0.0), (2.0, 0.0), 3).orderBy("i").collect()
    assert [r.value for r in rows] == [0, 1, 2]
    assert rows[-1].distance_km == pytest.approx(222, rel=1e-3)
    for bad in ((None, levels, (0, 0), (1, 1)), (nine, None, (0, 0), (1, 1)), (nine, levels, None, (1, 1))):
        with pytest.raises(ValueError):
            sections.transect(field, *bad)


def test_scales(spark):
    got = spark.range(1).select(*(sections.y_scale(F.lit(v), s) for v, s in ((4.0, "sqrt"), (-4.0, "sqrt"), (5.0, "symlog"), (100.0, "symlog"), (3.0, "linear")))).first()
    assert tuple(got) == (2, 0, 5, 20, 3)
    with pytest.raises(ValueError, match="exponent must be between 0 and 1"):
        sections.y_scale(F.lit(1.0), "power", 1.0)


def test_projections():
    assert projections.projection_name("NPStere") == "NorthPolarStereo"
    assert projections.is_global("rob") and not projections.is_global("pc")
    assert projections.data_bounds("np") == ((-180, 180), (0, 90))
    assert projections.data_bounds("sp", (0, 10, -80, -60)) == ((-180, 180), (-90, -40))
    assert projections.data_bounds("pc", (-178, 10, 0, 88)) == ((-180, 15), (-5, 90))
    with pytest.raises(ValueError):
        projections.projection_name("nowhere")
