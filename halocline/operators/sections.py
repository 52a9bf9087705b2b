"""Transect and map tables, and axis scales: the numbers behind figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import INFLUENCE_RADIUS, KM_PER_DEGREE
from ..functions.coords import great_circle_distance, great_circle_path
from ..plans.projections import data_bounds
from .regrid import WeightsCache, build
from .spatial import find_nearest


def path_distance(path: DataFrame, haversine: bool = False) -> DataFrame:
    """``path(i, lon, lat)`` with ``distance_km`` along it. By default a degree is 111 km, east-west
    steps shrink with the cosine of the step's first latitude, and the date line is a jump. A
    path has as many rows as were asked for, so its window is one partition."""
    w = Window.orderBy("i")
    lon, lat = F.lag("lon").over(w), F.lag("lat").over(w)
    dlat, dlon = F.col("lat") - lat, (F.col("lon") - lon) * F.cos(F.radians(lat))
    step = great_circle_distance(lon, lat, F.col("lon"), F.col("lat")) / 1000.0 if haversine else F.sqrt(dlat * dlat + dlon * dlon) * KM_PER_DEGREE
    stepped = path.withColumn("__step", F.coalesce(step, F.lit(0.0)))
    return stepped.withColumn("distance_km", F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def transect(field: DataFrame, mesh: DataFrame | None, levels: DataFrame | None, start: tuple[float, float] | None, end: tuple[float, float] | None, n_points: int = 100, value: str = "value", haversine: bool = False) -> DataFrame:
    """``(i, lon, lat, distance_km, level, depth, value)``: the field of the mesh point nearest to
    each point of a great-circle path. A field without levels is one level."""
    if mesh is None or not {"lon", "lat"} <= set(mesh.columns):
        raise ValueError("lon and lat coordinates are required")
    if levels is None:
        raise ValueError("depth array is required")
    if start is None or end is None:
        raise ValueError("start and end are required")
    path = path_distance(great_circle_path(mesh.sparkSession, start, end, n_points), haversine)
    near = find_nearest(path.withColumnRenamed("i", "query_id"), mesh).select(F.col("query_id").alias("i"), "point_id")
    flat = field if "level" in field.columns else field.withColumn("level", F.lit(0))
    chosen = F.broadcast(path.join(near, "i"))  # one row per path point
    rows = chosen.join(flat.select("point_id", "level", F.col(value).alias("value")), "point_id")
    return rows.join(F.broadcast(levels.select("level", "depth")), "level", "left").select("i", "lon", "lat", "distance_km", "level", "depth", "value")


def map_table(field: DataFrame, mesh: DataFrame | None, *, projection: str = "pc", extent=None, resolution: float | tuple[int, int] = 1.0, influence_radius: float = INFLUENCE_RADIUS, value: str = "value", cache: WeightsCache | None = None) -> DataFrame:
    """``(i_lat, i_lon, lon, lat, value)`` on the grid that a map in the projection shows."""
    if mesh is None or not {"lon", "lat"} <= set(mesh.columns):
        raise ValueError("lon and lat coordinates are required")
    lon_bounds, lat_bounds = data_bounds(projection, extent)
    options = {"resolution": resolution, "influence_radius": influence_radius, "lon_bounds": lon_bounds, "lat_bounds": lat_bounds}
    made = cache.get_or_create(mesh, **options) if cache else build(mesh, **options)
    return made(field, value=value).select("i_lat", "i_lon", "lon", "lat", "value")


def y_scale(y: Column, scale: str = "linear", exponent: float = 0.4, linthresh: float = 10.0) -> Column:
    """An axis value on a scale: linear, sqrt, power or symlog (linear within ``linthresh``)."""
    if scale == "linear":
        return y
    if scale == "sqrt":
        return F.sqrt(F.greatest(y, F.lit(0.0)))
    if scale == "power":
        if not 0 < exponent < 1:
            raise ValueError(f"Power exponent must be between 0 and 1, got {exponent}")
        return F.pow(F.greatest(y, F.lit(0.0)), F.lit(exponent))
    if scale == "symlog":
        beyond = F.signum(y) * linthresh * (1 + F.log10(F.abs(y) / linthresh))
        return F.when(F.abs(y) <= linthresh, y).otherwise(beyond)
    raise ValueError(f"Unknown y_scale: {scale}")
