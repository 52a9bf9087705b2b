"""Regular grids, their cell areas and vertical metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import EARTH_RADIUS, POLAR_FACTOR

GLOBE = ((-180.0, 180.0), (-90.0, 90.0))


def grid_axes(resolution: float | tuple[int, int] = 1.0, lon_bounds=GLOBE[0], lat_bounds=GLOBE[1], center: str = "cell"):
    """((first, step, count) of longitude, the same of latitude). A number is a spacing in
    degrees, a pair the counts; ``cell`` places points at cell centres, anything else at nodes
    that include both bounds."""
    axes = []
    for at, (low, high) in enumerate((lon_bounds, lat_bounds)):
        n = int(resolution[at]) if isinstance(resolution, (tuple, list)) else int((high - low) / resolution)
        if center == "cell":
            step = (high - low) / n
            axes.append((low + step / 2, step, n))
        else:
            axes.append((low, (high - low) / max(1, n - 1), n))
    return axes


def regular_grid(spark: SparkSession, resolution: float | tuple[int, int] = 1.0, lon_bounds=GLOBE[0], lat_bounds=GLOBE[1], center: str = "cell") -> DataFrame:
    """``(cell_id, i_lat, i_lon, lon, lat)``, latitude-major."""
    (lon0, dlon, nlon), (lat0, dlat, nlat) = grid_axes(resolution, lon_bounds, lat_bounds, center)
    return _lattice(spark, lon0, dlon, nlon, lat0, dlat, nlat)


def _lattice(spark: SparkSession, lon0, dlon, nlon, lat0, dlat, nlat) -> DataFrame:
    cell = spark.range(nlon * nlat).withColumnRenamed("id", "cell_id")
    cell = cell.withColumns({"i_lat": F.floor(F.col("cell_id") / nlon).cast("int"), "i_lon": (F.col("cell_id") % nlon).cast("int")})
    return cell.withColumns({"lon": F.lit(lon0) + F.col("i_lon") * F.lit(dlon), "lat": F.lit(lat0) + F.col("i_lat") * F.lit(dlat)})


def grid_cell_area(lat: Column, dlon: float, dlat: float, radius: float = EARTH_RADIUS) -> Column:
    """Area of a cell by its bounding latitudes, which are not clipped at the poles."""
    half = math.radians(dlat) / 2
    return F.abs(F.sin(F.radians(lat) + half) - F.sin(F.radians(lat) - half)) * (radius**2 * math.radians(dlon))


def lonlat_cell_area(lat: Column, dlon: float, dlat: float, radius: float = EARTH_RADIUS) -> Column:
    """Area of a cell with edges clipped at the poles."""
    half, pole = math.radians(dlat) / 2, math.pi / 2
    top, bottom = F.least(F.lit(pole), F.radians(lat) + half), F.greatest(F.lit(-pole), F.radians(lat) - half)
    return F.abs(F.sin(top) - F.sin(bottom)) * (radius**2 * math.radians(dlon))


def lonlat_lattice(spark: SparkSession, resolution: float | tuple[float, float], lon_bounds=GLOBE[0], lat_bounds=GLOBE[1]) -> DataFrame:
    """``(point_id, i_lat, i_lon, lon, lat, area)`` at ``arange(low + d / 2, high, d)``."""
    dlon, dlat = resolution if isinstance(resolution, (tuple, list)) else (resolution, resolution)
    count = lambda low, high, d: max(0, math.ceil((high - low - d / 2) / d - 1e-9))
    nlon, nlat = count(*lon_bounds, dlon), count(*lat_bounds, dlat)
    grid = _lattice(spark, lon_bounds[0] + dlon / 2, dlon, nlon, lat_bounds[0] + dlat / 2, dlat, nlat)
    return grid.withColumnRenamed("cell_id", "point_id").withColumn("area", lonlat_cell_area(F.col("lat"), dlon, dlat))


def estimated_area(points: DataFrame, radius: float = EARTH_RADIUS) -> DataFrame:
    """``points`` with ``area``: an equal share of the globe weighted by cos(lat) over its mean.
    The two totals come from an aggregate of one row."""
    totals = points.agg(F.avg(F.cos(F.radians("lat"))).alias("__mean"), F.count(F.lit(1)).alias("__n"))
    area = F.lit(4 * math.pi * radius**2) / F.col("__n") * F.cos(F.radians("lat")) / F.col("__mean")
    return points.crossJoin(F.broadcast(totals)).withColumn("area", F.when(F.col("__mean") != 0, area)).drop("__mean", "__n")


def structured_area(grid: DataFrame, radius: float = EARTH_RADIUS) -> DataFrame:
    """``grid(j, i, lon, lat, ...)`` with ``area`` from neighbour spacings: central differences
    inside, one-sided at the edges, longitude steps over 180 taken the short way. Windows run
    along a row of the grid and along a column."""
    along, across = Window.partitionBy("j").orderBy("i"), Window.partitionBy("i").orderBy("j")

    def step(name: str, w) -> Column:
        before, after, here = F.lag(name).over(w), F.lead(name).over(w), F.col(name)
        central = (after - before) / 2
        return F.abs(F.coalesce(central, after - here, here - before))

    spaced = grid.withColumn("__dlon", step("lon", along)).withColumn("__dlat", step("lat", across))
    dlon = F.when(F.col("__dlon") > 180, 360 - F.col("__dlon")).otherwise(F.col("__dlon"))
    area = radius**2 * F.cos(F.radians("lat")) * F.radians(dlon) * F.radians("__dlat")
    return spaced.withColumn("area", area).drop("__dlon", "__dlat")


def expand_bounds_for_polar(lon_bounds, lat_bounds, factor: float = POLAR_FACTOR):
    """Bounds scaled about their centres and clamped to the globe."""
    out = []
    for (low, high), (least, most) in zip((lon_bounds, lat_bounds), GLOBE):
        middle, half = (low + high) / 2, (high - low) / 2 * factor
        out.append((max(least, middle - half), min(most, middle + half)))
    return tuple(out)


def vertical_metrics(interfaces: DataFrame, depth: str = "depth") -> DataFrame:
    """``interfaces(level, depth)`` -> ``levels(level, depth, depth_top, depth_bottom,
    thickness)``: one row for each layer between two interfaces. A depth axis is small, so its
    window is one partition."""
    w = Window.orderBy("level")
    paired = interfaces.select("level", F.col(depth).alias("depth_top"), F.lead(depth).over(w).alias("depth_bottom")).where("depth_bottom is not null")
    return paired.select("level", ((F.col("depth_top") + F.col("depth_bottom")) / 2).alias("depth"), "depth_top", "depth_bottom", (F.col("depth_bottom") - F.col("depth_top")).alias("thickness"))
