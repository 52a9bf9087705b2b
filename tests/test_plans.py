"""What the plans of the main queries read, join and shuffle."""

import re

import pytest

from halocline.operators import grids, regrid, sections, spatial
from halocline.plans import catalogue, derive
from pyspark.sql import functions as F


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["ice_by_hemisphere", "volume_mean", "heat_content_total", "hovmoller_depth", "hovmoller_latitude", "element_to_node_mean", "cluster_area"])
def test_no_cross_products_or_python(spark, sf_dir, name):
    text = plan(catalogue.QUERIES[name](spark, sf_dir))
    assert not re.search("CartesianProduct|Python|Pandas|Arrow", text)


def test_scans_read_only_what_is_needed(spark, sf_dir):
    text = plan(catalogue.QUERIES["ice_by_hemisphere"](spark, sf_dir))
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", text):
        assert not re.search("l_extendedprice|l_comment|c_name|c_acctbal", schema)


def test_filters_reach_the_scan(spark, sf_dir):
    points = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("point_id"), F.col("c_acctbal").alias("lon"), F.col("c_acctbal").alias("lat"))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(c_acctbal,-60", plan(spatial.subset_by_bbox(points, -60, 20, -60, 20)))


def test_reductions_aggregate_before_the_exchange(spark, sf_dir):
    text = plan(catalogue.QUERIES["surface_mean"](spark, sf_dir))
    assert "partial_sum" in text


@pytest.fixture(scope="module")
def mesh(spark, sf_dir, tmp_path_factory):
    """The derived points as a written table, so that plans hold nothing of how they are made."""
    path = str(tmp_path_factory.mktemp("plans") / "points.parquet")
    derive.points(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def test_neighbours_are_an_equi_join(spark, mesh):
    queries = grids.regular_grid(spark, 30.0).select(F.col("cell_id").alias("query_id"), "lon", "lat")
    for df in (spatial.find_nearest(queries, mesh, 3), spatial.nearest_within(queries, mesh, 0.08), regrid.build(mesh, 30.0, influence_radius=500_000.0).weights):
        text = plan(df)
        assert not re.search("NestedLoopJoin|CartesianProduct|SortAggregate", text)
    assert plan(spatial.nearest_within(queries, mesh, 0.08)).count("WindowGroupLimit") >= 1
    assert grids.regular_grid(spark, 30.0).count() == 72


def test_transect_joins_on_keys(spark, sf_dir, mesh):
    levels = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").alias("level"), F.col("r_regionkey").cast("double").alias("depth"))
    field = mesh.select("point_id", (F.col("point_id") % 3).alias("level"), F.col("lat").alias("value"))
    text = plan(sections.transect(field, mesh, levels, (-30.0, 10.0), (40.0, 55.0), 20))
    assert not re.search("NestedLoopJoin|CartesianProduct", text)


def test_one_level_is_filtered_in_the_scan(spark, sf_dir):
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(l_linenumber,1\)", plan(derive.ice(spark, sf_dir)))


def test_cells_without_a_source_are_not_joined(spark, mesh):
    made = regrid.build(mesh, 30.0, influence_radius=300_000.0)
    field = mesh.select(F.lit(1).alias("time"), "point_id", F.col("lat").alias("value"))
    assert "Union" in plan(made(field, ["time"])) and made(field, ["time"]).count() == 72
