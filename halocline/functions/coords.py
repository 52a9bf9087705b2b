"""Coordinate algebra on the sphere as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import CYCLIC_DEGREES, EARTH_RADIUS


def _double(x: Column | float | str) -> Column:
    return (F.col(x) if isinstance(x, str) else F.lit(x) if isinstance(x, (int, float)) else x).cast("double")


def lonlat_to_cartesian(lon, lat, radius: float = 1.0) -> tuple[Column, Column, Column]:
    """x, y and z of points given in degrees."""
    a, b = F.radians(_double(lon)), F.radians(_double(lat))
    return radius * F.cos(b) * F.cos(a), radius * F.cos(b) * F.sin(a), radius * F.sin(b)


def cartesian_to_lonlat(x, y, z) -> tuple[Column, Column]:
    """Longitude and latitude in degrees; NULL at the origin."""
    x, y, z = _double(x), _double(y), _double(z)
    norm = F.sqrt(x * x + y * y + z * z)
    return F.degrees(F.atan2(y, x)), F.when(norm > 0, F.degrees(F.asin(z / norm)))


def meters_to_chord(meters, radius: float = EARTH_RADIUS):
    """Unit-sphere chord of a distance along the surface; a number for a number."""
    if isinstance(meters, (int, float)):
        return 2.0 * math.sin(meters / (2.0 * radius))
    return 2.0 * F.sin(_double(meters) / (2.0 * radius))


def chord_to_meters(chord, radius: float = EARTH_RADIUS):
    """Distance along the surface of a unit-sphere chord; a number for a number."""
    if isinstance(chord, (int, float)):
        return 2.0 * radius * math.asin(min(1.0, chord / 2.0))
    return 2.0 * radius * F.asin(F.least(F.lit(1.0), _double(chord) / 2.0))


def great_circle_distance(lon1, lat1, lon2, lat2, radius: float = EARTH_RADIUS) -> Column:
    """Haversine distance."""
    lon1, lat1, lon2, lat2 = (F.radians(_double(v)) for v in (lon1, lat1, lon2, lat2))
    a = F.pow(F.sin((lat2 - lat1) / 2), F.lit(2.0)) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), F.lit(2.0))
    return 2.0 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


haversine_distance = great_circle_distance


def normalize_lon(lon, convention: str = "pm180") -> Column:
    """Longitude in [-180, 180) (``pm180``) or [0, 360) (``0360``)."""
    lon = _double(lon)
    if convention == "pm180":
        return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0
    if convention == "0360":
        return F.pmod(lon, F.lit(360.0))
    raise ValueError(f"Unknown longitude convention: {convention}")


def ensure_lon_pm180(df: DataFrame, lon: str = "lon") -> DataFrame:
    """``df`` with longitudes wrapped if any lies outside [-180, 180]; otherwise as it is, so an
    exact 180 stays. Without the column nothing happens."""
    if lon not in df.columns:
        return df
    low, high = df.agg(F.min(lon), F.max(lon)).first()
    return df if low is None or (low >= -180 and high <= 180) else df.withColumn(lon, normalize_lon(lon))


def great_circle_path(spark: SparkSession, start: tuple[float, float], end: tuple[float, float], n_points: int = 100) -> DataFrame:
    """``(i, lon, lat)``: points at equal steps of the chord from start to end, on the sphere.
    Antipodal ends have no middle: NULL there."""

    def xyz(lon: float, lat: float):
        a, b = math.radians(lon), math.radians(lat)
        return math.cos(b) * math.cos(a), math.cos(b) * math.sin(a), math.sin(b)

    t = F.col("id") / F.lit(float(max(1, n_points - 1)))
    x, y, z = (F.lit(p) * (1 - t) + F.lit(q) * t for p, q in zip(xyz(*start), xyz(*end)))
    lon, lat = cartesian_to_lonlat(x, y, z)
    return spark.range(n_points).select(F.col("id").alias("i"), lon.alias("lon"), lat.alias("lat"))


def element_center(lons: list[Column], lats: list[Column]) -> tuple[Column, Column]:
    """Mean of three vertices. If one is more than 100 degrees from the mean longitude, the
    triangle crosses the date line: negative longitudes are shifted by 360 for the mean, which
    is wrapped back beyond 180."""
    mean = (lons[0] + lons[1] + lons[2]) / 3.0
    cyclic = F.greatest(*(F.abs(v - mean) for v in lons)) > CYCLIC_DEGREES
    a, b, c = (F.when(v < 0, v + 360.0).otherwise(v) for v in lons)
    shifted = (a + b + c) / 3.0
    return F.when(cyclic, F.when(shifted > 180, shifted - 360.0).otherwise(shifted)).otherwise(mean), (lats[0] + lats[1] + lats[2]) / 3.0


def triangle_area(lons: list[Column], lats: list[Column], radius: float = EARTH_RADIUS) -> Column:
    """Area of the plane triangle through three points on the sphere."""
    (ax, ay, az), (bx, by, bz), (cx, cy, cz) = (lonlat_to_cartesian(a, b) for a, b in zip(lons, lats))
    ux, uy, uz, vx, vy, vz = bx - ax, by - ay, bz - az, cx - ax, cy - ay, cz - az
    px, py, pz = uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx
    return 0.5 * F.sqrt(px * px + py * py + pz * pz) * radius**2
