"""The mesh: one DataFrame per dimension beside its metadata."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import LAT_NAMES, LON_NAMES
from ..functions.coords import normalize_lon
from ..operators.grids import estimated_area, lonlat_lattice

VERSION = "1"


@dataclass(frozen=True)
class Mesh:
    """``points(point_id, lon, lat, area, ...)`` and, where known, ``elements(elem_id, n0, n1, n2)``,
    ``levels(level, depth, depth_top, depth_bottom, thickness)`` and ``area3d(level, point_id,
    area)``."""

    points: DataFrame
    kind: str = "custom"
    version: str = VERSION
    source: str | None = None
    elements: DataFrame | None = None
    levels: DataFrame | None = None
    area3d: DataFrame | None = None
    extra: dict = field(default_factory=dict)


def with_metadata(mesh: Mesh, kind: str, version: str = VERSION, source: str | None = None, **extra) -> Mesh:
    return replace(mesh, kind=kind, version=version, source=source, extra={**mesh.extra, **extra})


def is_mesh(x) -> bool:
    return isinstance(x, Mesh)


def mesh_kind(x) -> str | None:
    return x.kind if is_mesh(x) else None


def find_coordinates(columns: list[str]) -> tuple[str | None, str | None]:
    """Longitude and latitude columns by the known names, in order of priority, in any case."""
    lower = {c.lower(): c for c in reversed(columns)}
    pick = lambda names: next((lower[n] for n in names if n in lower), None)
    return pick(LON_NAMES), pick(LAT_NAMES)


def lonlat_mesh(spark: SparkSession, resolution: float | tuple[float, float] = 1.0, lon_bounds=(-180.0, 180.0), lat_bounds=(-90.0, 90.0)) -> Mesh:
    """Cell centres of a regular lon-lat grid with their areas."""
    return Mesh(lonlat_lattice(spark, resolution, lon_bounds, lat_bounds), "lonlat")


def mesh_from_df(df: DataFrame, lon: str | None = None, lat: str | None = None, area: str | None = None, point_id: str = "point_id") -> Mesh:
    """A mesh from a table of points; coordinates are found by name if not given, longitudes are
    wrapped to [-180, 180), and without an area column areas are estimated."""
    found = find_coordinates(df.columns)
    lon, lat = lon or found[0], lat or found[1]
    if lon is None or lat is None:
        raise ValueError("lon and lat coordinates are required")
    points = df.select(F.col(point_id).cast("long").alias("point_id"), normalize_lon(F.col(lon)).alias("lon"), F.col(lat).cast("double").alias("lat"), *([F.col(area).cast("double").alias("area")] if area else []))
    return Mesh(points if area else estimated_area(points))


#: What a mesh must meet, each as (columns, what breaks it, how that is told after the count).
POINT_RULES = [
    (("lon",), "not lon between -180 and 180", "points have a longitude beyond 180 degrees"),
    (("lat",), "not lat between -90 and 90", "points lie beyond a pole"),
    (("area",), "not area > 0", "points have a non-positive area"),
]
ELEMENT_RULES = [
    ("least(n0, n1, n2) < 0", "triangles have a negative vertex"),
    ("greatest(n0, n1, n2) >= {n}", "triangles have a vertex beyond the {n} points"),
]


def validate_mesh(mesh: Mesh, strict: bool = False) -> list[str]:
    """How often a mesh breaks each rule, from one aggregate over points and one over elements;
    unknown values break none. With ``strict`` a broken rule raises."""
    there = set(mesh.points.columns)
    found = [f"the mesh has no column {c}" for c in ("lon", "lat", "area") if c not in there]
    rules = [(test, told) for columns, test, told in POINT_RULES if there.issuperset(columns)]
    row = mesh.points.agg(F.count(F.lit(1)), *(F.count_if(F.expr(test)) for test, _ in rules)).first()
    found += [f"{n} {told}" for n, (_, told) in zip(row[1:], rules) if n]
    if mesh.elements is not None:
        rules = [(test.format(n=row[0]), told.format(n=row[0])) for test, told in ELEMENT_RULES]
        found += [f"{n} {told}" for n, (_, told) in zip(mesh.elements.agg(*(F.count_if(F.expr(test)) for test, _ in rules)).first(), rules) if n]
    if strict and found:
        raise ValueError("the mesh breaks its conventions: " + "; ".join(found))
    return found


def open_dataset(data: DataFrame, mesh: Mesh | None = None, mesh_path: str | None = None) -> DataFrame:
    """A field with its mesh's lon and lat by point, and depth by level where there are levels."""
    if mesh is None:
        if mesh_path is None:
            raise ValueError("Either mesh or mesh_path must be given")
        from .load import load_mesh

        mesh = load_mesh(data.sparkSession, mesh_path)
    out = data.join(mesh.points.select("point_id", "lon", "lat"), "point_id")
    if mesh.levels is not None and "level" in data.columns:
        out = out.join(F.broadcast(mesh.levels.select("level", "depth")), "level", "left")
    return out
