"""Nearest-neighbour regridding to regular grids, with a cache of weights."""

from __future__ import annotations

import hashlib
import json
from collections import OrderedDict
from dataclasses import dataclass
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import CACHE_ITEMS, INFLUENCE_RADIUS
from ..functions.coords import meters_to_chord
from ..sources.files import exists
from ..sources.mesh import find_coordinates
from .grids import GLOBE, grid_axes, regular_grid
from .shaping import prepare_coordinates
from .spatial import nearest_within


@dataclass
class Interpolator:
    """Weights ``(cell_id, i_lat, i_lon, lon, lat, point_id, chord, valid)``, one row per cell."""

    weights: DataFrame
    shape: tuple[int, int]

    def __call__(self, field: DataFrame, keys: list[str] = (), value: str = "value", fill_value: float | None = None) -> DataFrame:
        """``field(keys..., point_id, value)`` on the grid, every cell for every key; cells
        without a source point within the radius have the fill value. An unknown source value
        stays unknown."""
        keys, cell = list(keys), ["cell_id", "i_lat", "i_lon", "lon", "lat"]
        cells = self.weights if not keys else field.select(*keys).distinct().crossJoin(self.weights)
        # Only cells with a source are joined: the others would all meet under a null point.
        own = field.select(*keys, "point_id", F.col(value).cast("double").alias("value"))
        reached = cells.where("valid").join(own, [*keys, "point_id"], "left").select(*keys, *cell, "value")
        return reached.unionByName(cells.where(~F.col("valid")).select(*keys, *cell, F.lit(fill_value).cast("double").alias("value")))


def build(mesh: DataFrame, resolution: float | tuple[int, int] = 1.0, method: str = "nearest", influence_radius: float = INFLUENCE_RADIUS, lon_bounds=GLOBE[0], lat_bounds=GLOBE[1]) -> Interpolator:
    """The nearest mesh point within the influence radius of every cell centre. Mesh points out
    of reach of the grid's latitudes are filtered before the join."""
    if method != "nearest":
        raise ValueError(f"Unknown method: {method}")
    chord = meters_to_chord(influence_radius)
    grid = regular_grid(mesh.sparkSession, resolution, lon_bounds, lat_bounds)
    margin = 2 * 57.29577951308232 * influence_radius / 6_371_000.0 + 1e-9
    near = mesh.where(F.col("lat").between(lat_bounds[0] - margin, lat_bounds[1] + margin))
    found = nearest_within(grid.select(F.col("cell_id").alias("query_id"), "lon", "lat"), near, chord)
    weights = grid.join(found.withColumnRenamed("query_id", "cell_id"), "cell_id", "left").withColumn("valid", F.col("point_id").isNotNull())
    (_, _, nlon), (_, _, nlat) = grid_axes(resolution, lon_bounds, lat_bounds)
    return Interpolator(weights, (nlat, nlon))


def regrid(field: DataFrame, mesh: DataFrame | None = None, keys: list[str] = (), *, lon: DataFrame | None = None, lat: DataFrame | None = None, resolution: float | tuple[int, int] = 1.0, method: str = "nearest", influence_radius: float = INFLUENCE_RADIUS, fill_value: float | None = None, lon_bounds=GLOBE[0], lat_bounds=GLOBE[1], value: str = "value") -> tuple[DataFrame, Interpolator]:
    """Regrid a field; returns the gridded table and the interpolator for further fields.

    The field is ``(keys..., point_id, value)`` with a ``mesh(point_id, lon, lat)``; or it stands on
    a grid, ``(keys..., j, i, value)``, with its coordinates as two axes ``lon(i, lon)`` and
    ``lat(j, lat)``, as 2-D tables ``(j, i, lon)`` and ``(j, i, lat)``, as one table ``(j, i, lon,
    lat)`` in the mesh's place, or as its own columns of the known names. Points of a grid are
    numbered ``j * width + i``.
    """
    gridded = {"j", "i"} <= set(field.columns) and "point_id" not in field.columns
    if gridded:
        field, mesh = _on_points(field, mesh, lon, lat, list(keys), value)
    elif mesh is None and lon is not None and lat is not None:
        mesh = prepare_coordinates(lon, lat)
    if mesh is None or not {"point_id", "lon", "lat"} <= set(mesh.columns):
        raise ValueError("lon and lat coordinates are required")
    made = build(mesh, resolution, method, influence_radius, lon_bounds, lat_bounds)
    return made(field, keys, value, fill_value), made


def _on_points(field: DataFrame, mesh: DataFrame | None, lon: DataFrame | None, lat: DataFrame | None, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """A field on a grid as one by point, and the points of that grid."""
    own = find_coordinates(field.columns)
    if lon is not None and lat is not None:
        at = prepare_coordinates(lon, lat)
    elif mesh is not None and {"j", "i", "lon", "lat"} <= set(mesh.columns):
        at = mesh.select("j", "i", "lon", "lat")
    elif None not in own:
        at = field.select("j", "i", F.col(own[0]).alias("lon"), F.col(own[1]).alias("lat")).distinct()
    else:
        raise ValueError("lon and lat coordinates are required")
    width = (at.agg(F.max("i")).first()[0] or 0) + 1
    number = (F.col("j") * F.lit(width) + F.col("i")).cast("long").alias("point_id")
    return field.select(*keys, number, value), at.select(number, "lon", "lat")


class WeightsCache:
    """Least-recently-used weights, persisted in memory; with ``path`` also as parquet."""

    def __init__(self, max_items: int = CACHE_ITEMS, path: str | None = None) -> None:
        self.max_items, self.path, self.items, self.lock = max_items, path, OrderedDict(), Lock()

    @staticmethod
    def key(mesh: DataFrame, **options) -> str:
        """Exact key: a sum of hashes over all points, their number and the options."""
        total = mesh.agg(F.sum(F.xxhash64("point_id", "lon", "lat").cast("decimal(38,0)")).alias("h"), F.count(F.lit(1)).alias("n")).first()
        return hashlib.sha256(json.dumps([str(total.h), total.n, sorted(options.items())], default=str).encode()).hexdigest()[:16]

    def get_or_create(self, mesh: DataFrame, **options) -> Interpolator:
        key = self.key(mesh, **options)
        with self.lock:
            if key in self.items:
                self.items.move_to_end(key)
                return self.items[key]
            stored = f"{self.path}/{key}" if self.path else None
            (_, _, nlon), (_, _, nlat) = grid_axes(options.get("resolution", 1.0), options.get("lon_bounds", GLOBE[0]), options.get("lat_bounds", GLOBE[1]))
            if stored and exists(mesh.sparkSession, stored):
                made = Interpolator(mesh.sparkSession.read.parquet(stored), (nlat, nlon))
            else:
                made = build(mesh, **options)
                if stored:
                    made.weights.write.mode("overwrite").parquet(stored)
                    made = Interpolator(mesh.sparkSession.read.parquet(stored), made.shape)
            made.weights.persist()
            self.items[key] = made
            while len(self.items) > self.max_items:
                self.items.popitem(last=False)[1].weights.unpersist()
            return made

    def clear(self) -> None:
        with self.lock:
            for made in self.items.values():
                made.weights.unpersist()
            self.items.clear()

    def __len__(self) -> int:
        return len(self.items)


_caches: dict[str, WeightsCache] = {}


def get_cache(spark: SparkSession) -> WeightsCache:
    return _caches.setdefault(spark.sparkContext.applicationId, WeightsCache())


def set_cache_options(spark: SparkSession, max_items: int = CACHE_ITEMS, path: str | None = None) -> WeightsCache:
    """A new cache for the session."""
    clear_cache(spark)
    _caches[spark.sparkContext.applicationId] = WeightsCache(max_items, path)
    return get_cache(spark)


def clear_cache(spark: SparkSession) -> None:
    get_cache(spark).clear()
