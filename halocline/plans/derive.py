"""Meshes and fields derived from the supplied tables, as DataFrames and as the same SQL.

``customer`` becomes the points of a spiral mesh, ``lineitem`` a field by year, level and point,
``orders`` a surface field, ``part`` triangles. Every seventeenth value is NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURN = 137.50776405
LEVELS = [(0, 2.5, 5.0), (1, 10.0, 10.0), (2, 25.0, 20.0), (3, 60.0, 50.0), (4, 150.0, 130.0), (5, 400.0, 370.0), (6, 1000.0, 830.0)]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return F.broadcast(_read(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n")))  # one row


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("c_custkey") * F.lit(TURN)
    base = _read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").crossJoin(_size(spark, sf_dir))
    return base.select(
        F.col("c_custkey").cast("long").alias("point_id"),
        (x - 360 * F.floor(x / 360.0) - 180.0).alias("lon"),
        (-90.0 + 180.0 * (F.col("c_custkey") + 0.5) / F.col("n")).alias("lat"),
        (1e6 * (1 + F.col("c_nationkey"))).alias("area"),
    )


def levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEVELS, "level int, depth double, thickness double")


def field3d(spark: SparkSession, sf_dir: str, level: int | None = None) -> DataFrame:
    """``(time, level, point_id, value, concentration)``, of one level where it is given."""
    rows = _read(spark, sf_dir, "lineitem")
    if level is not None:  # on the column as it is stored, so that the scan filters
        rows = rows.where(F.col("l_linenumber") == level + 1)
    items = rows.select("l_shipdate", "l_linenumber", "l_partkey", "l_quantity").crossJoin(_size(spark, sf_dir))
    keyed = items.select(F.year("l_shipdate").cast("int").alias("time"), (F.col("l_linenumber") - 1).cast("int").alias("level"), (F.col("l_partkey") % F.col("n")).cast("long").alias("point_id"), "l_quantity")
    mean = F.avg("l_quantity")
    grouped = keyed.groupBy("time", "level", "point_id").agg(mean.alias("q"))
    value = F.when((F.col("point_id") + F.col("level")) % 17 != 0, F.col("q"))
    return grouped.select("time", "level", "point_id", value.alias("value"), (value / 40.0).alias("concentration"))


def ice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level 0 as ``(time, point_id, concentration, thickness)``."""
    return field3d(spark, sf_dir, 0).select("time", "point_id", "concentration", (F.col("value") - 5).alias("thickness"))


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(level, point_id, value)`` of every point and level."""
    grid = points(spark, sf_dir).crossJoin(F.broadcast(levels(spark)))
    value = F.when((F.col("point_id") + F.col("level")) % 17 != 0, F.col("area") / 1e6 + F.col("level") * 3)
    return grid.select("level", "point_id", value.cast("double").alias("value"))


def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(point_id, value)``."""
    return points(spark, sf_dir).select("point_id", F.when(F.col("point_id") % 17 != 0, F.col("area") / 1e6 + F.col("point_id") % 10).alias("value"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part").select("p_partkey").crossJoin(_size(spark, sf_dir))
    corner = lambda a, b: ((F.col("p_partkey") * a + b) % F.col("n")).cast("long")
    return part.select(F.col("p_partkey").cast("long").alias("elem_id"), corner(1, 0).alias("n0"), corner(7, 1).alias("n1"), corner(13, 2).alias("n2"))


SQL = f"""
size AS (SELECT count(*) AS n FROM customer),
points AS (
  SELECT CAST(c_custkey AS BIGINT) AS point_id, x - 360 * floor(x / 360.0) - 180.0 AS lon,
         -90.0 + 180.0 * (c_custkey + 0.5) / n AS lat, 1e6 * (1 + c_nationkey) AS area
  FROM (SELECT *, c_custkey * CAST({TURN} AS DOUBLE) AS x FROM customer), size),
levels(level, depth, thickness) AS (
  SELECT CAST(a AS INTEGER), CAST(b AS DOUBLE), CAST(c AS DOUBLE) FROM (VALUES {", ".join(map(str, LEVELS))}) AS v(a, b, c)),
field3d AS (
  SELECT time, level, point_id, CASE WHEN (point_id + level) % 17 <> 0 THEN q END AS value,
         CASE WHEN (point_id + level) % 17 <> 0 THEN q END / 40.0 AS concentration
  FROM (SELECT CAST(year(l_shipdate) AS INTEGER) AS time, CAST(l_linenumber - 1 AS INTEGER) AS level,
               CAST(l_partkey % n AS BIGINT) AS point_id, avg(l_quantity) AS q
        FROM lineitem, size GROUP BY ALL)),
ice AS (SELECT time, point_id, concentration, value - 5 AS thickness FROM field3d WHERE level = 0),
profile AS (
  SELECT level, point_id, CAST(CASE WHEN (point_id + level) % 17 <> 0 THEN area / 1e6 + level * 3 END AS DOUBLE) AS value
  FROM points, levels),
surface AS (SELECT point_id, CASE WHEN point_id % 17 <> 0 THEN area / 1e6 + point_id % 10 END AS value FROM points),
elements AS (
  SELECT CAST(p_partkey AS BIGINT) AS elem_id, CAST(p_partkey % n AS BIGINT) AS n0,
         CAST((p_partkey * 7 + 1) % n AS BIGINT) AS n1, CAST((p_partkey * 13 + 2) % n AS BIGINT) AS n2
  FROM part, size),
xyz AS (
  SELECT *, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z
  FROM points)"""
