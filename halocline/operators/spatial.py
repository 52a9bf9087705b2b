"""Spatial predicates and nearest-neighbour joins.

Neighbours are searched on the unit sphere, where the poles and the date line need no special
case. Points are keyed by a cube of edge ``h``; a query looks into its own cube and the 26
around it, which holds every point within a chord of ``h``. The join is an equi-join on the
cube, distances are compared squared, and ties go to the smaller point_id.
"""

from __future__ import annotations

import json
import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import chord_to_meters, lonlat_to_cartesian

# The three equatorial Pacific index regions, as lists of outer rings.
REGIONS = {
    "Nino 3.4": [[(-170.0, 5.0), (-170.0, -5.0), (-120.0, -5.0), (-120.0, 5.0), (-170.0, 5.0)]],
    "Nino 3": [[(-150.0, 5.0), (-150.0, -5.0), (-90.0, -5.0), (-90.0, 5.0), (-150.0, 5.0)]],
    "Nino 4": [
        [(160.0, 5.0), (160.0, -5.0), (180.0, -5.0), (180.0, 5.0), (160.0, 5.0)],
        [(-180.0, 5.0), (-180.0, -5.0), (-150.0, -5.0), (-150.0, 5.0), (-180.0, 5.0)],
    ],
}

#: Candidates for a query from which a search approaches its radius from smaller cubes.
MANY = 64


def in_bbox(lon: Column, lat: Column, lon_min: float, lon_max: float, lat_min: float, lat_max: float) -> Column:
    """Inclusive box; one with lon_min > lon_max holds nothing."""
    return lon.between(lon_min, lon_max) & lat.between(lat_min, lat_max)


def subset_by_bbox(points: DataFrame, lon_min: float, lon_max: float, lat_min: float, lat_max: float) -> DataFrame:
    return points.where(in_bbox(F.col("lon"), F.col("lat"), lon_min, lon_max, lat_min, lat_max))


def in_ring(lon: Column, lat: Column, ring: list[tuple[float, float]], boundary: bool = False) -> Column:
    """Even-odd rule in the lon/lat plane. Points on an edge count as ``boundary`` says."""
    ring = ring if ring[0] == ring[-1] else [*ring, ring[0]]
    crossings, on_edge = F.lit(0), F.lit(False)
    for (x0, y0), (x1, y1) in zip(ring, ring[1:]):
        if y0 != y1:
            spans = (lat > min(y0, y1)) & (lat <= max(y0, y1))
            at = F.lit(x0) + (lat - y0) * ((x1 - x0) / (y1 - y0))
            crossings = crossings + F.when(spans & (lon < at), 1).otherwise(0)
        cross = (lon - x0) * (y1 - y0) - (lat - y0) * (x1 - x0)
        on_edge = on_edge | ((cross == 0) & lon.between(min(x0, x1), max(x0, x1)) & lat.between(min(y0, y1), max(y0, y1)))
    inside = crossings % 2 == 1
    box = in_bbox(lon, lat, min(p[0] for p in ring), max(p[0] for p in ring), min(p[1] for p in ring), max(p[1] for p in ring))
    return box & F.when(on_edge, F.lit(boundary)).otherwise(inside)


def points_in_polygon(points: DataFrame, poly_lon: list[float], poly_lat: list[float]) -> DataFrame:
    """``points`` with ``inside``."""
    return points.withColumn("inside", in_ring(F.col("lon"), F.col("lat"), list(zip(poly_lon, poly_lat))))


def load_geojson(name: str) -> dict:
    """A GeoJSON document: the built-in ``NinoRegions``, or a file by path."""
    if name == "NinoRegions":
        made = [{"type": "Feature", "properties": {"name": k}, "geometry": {"type": "MultiPolygon", "coordinates": [[[list(p) for p in r]] for r in rings]}} for k, rings in REGIONS.items()]
        return {"type": "FeatureCollection", "features": made}
    path = Path(name)
    if not path.is_file():
        raise FileNotFoundError(f"No GeoJSON named {name!r}: only NinoRegions is built in, others are given by path")
    return json.loads(path.read_text())


def _name(feature: dict) -> str:
    props = feature.get("properties", {})
    return next((props[k] for k in ("name", "NAME", "Name") if props.get(k)), "")


def list_available_regions(geojson_name: str = "NinoRegions") -> list[str]:
    return [_name(f) for f in load_geojson(geojson_name)["features"]]


def region_mask(lon: Column, lat: Column, region: str, geojson_name: str = "NinoRegions") -> Column:
    """Whether points lie strictly inside any feature of that name; a hole is outside."""
    features = load_geojson(geojson_name)["features"]
    chosen = [f["geometry"] for f in features if _name(f) == region]
    if not chosen:
        raise ValueError(f"Region {region!r} not found. Available regions: {[_name(f) for f in features]}")
    found = F.lit(False)
    for geometry in chosen:
        for rings in geometry["coordinates"] if geometry["type"] == "MultiPolygon" else [geometry["coordinates"]]:
            inside = in_ring(lon, lat, [tuple(p[:2]) for p in rings[0]])
            for hole in rings[1:]:
                inside = inside & ~in_ring(lon, lat, [tuple(p[:2]) for p in hole], boundary=True)
            found = found | inside
    return found


def get_region_mask(points: DataFrame, region: str, geojson_name: str = "NinoRegions") -> DataFrame:
    """``points`` with ``inside``."""
    return points.withColumn("inside", region_mask(F.col("lon"), F.col("lat"), region, geojson_name))


def _cubed(df: DataFrame, h: float, spread: bool) -> DataFrame:
    x, y, z = lonlat_to_cartesian(F.col("lon"), F.col("lat"))
    df = df.withColumns({"__x": x, "__y": y, "__z": z})
    side = int(2 / h) + 6  # cubes along an axis, with a margin for the neighbours
    at = [F.floor(F.col(c) / h).cast("long") + side // 2 for c in ("__x", "__y", "__z")]
    key = lambda i, j, k: (i * side + j) * side + k
    if not spread:
        return df.withColumn("__cube", key(*at))
    steps = F.array(*(F.lit(d) for d in range(-1, 2)))
    for name, column in zip(("__i", "__j", "__k"), at):
        df = df.withColumn("__d", F.explode(steps)).withColumn(name, column + F.col("__d")).drop("__d")
    return df.withColumn("__cube", key(F.col("__i"), F.col("__j"), F.col("__k"))).drop("__i", "__j", "__k")


def _candidates(queries: DataFrame, points: DataFrame, h: float) -> DataFrame:
    """``(query_id, point_id, d2)`` of all pairs in neighbouring cubes."""
    q = _cubed(queries.select("query_id", "lon", "lat"), h, True).select("query_id", "__cube", *(F.col(f"__{c}").alias(f"__q{c}") for c in "xyz"))
    p = _cubed(points.select("point_id", "lon", "lat"), h, False).select("point_id", "__cube", "__x", "__y", "__z")
    d2 = sum(((F.col(f"__{c}") - F.col(f"__q{c}")) * (F.col(f"__{c}") - F.col(f"__q{c}")) for c in "xyz"), F.lit(0.0))
    return q.join(p, "__cube").select("query_id", "point_id", d2.alias("d2"))


def _best(candidates: DataFrame, k: int) -> DataFrame:
    """The k candidates of each query with the least d2, ties to the smaller point_id, with
    ``rank`` from 0; written so that Spark limits the ranks before and after the exchange."""
    order = Window.partitionBy("query_id").orderBy("d2", "point_id")
    ranked = candidates.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= k)
    return ranked.withColumn("rank", F.col("__place") - 1).drop("__place")


def _crowding(points: DataFrame, h: float) -> float:
    """How many points a point's cube of edge ``h`` holds, on the mean over the points: a refined
    mesh crowds a few cubes."""
    per = _cubed(points.select("point_id", "lon", "lat"), h, False).groupBy("__cube").count()
    row = per.agg(F.sum("count").alias("n"), F.sum(F.col("count").cast("double") * F.col("count")).alias("square")).first()
    return row.square / row.n


def _search(queries: DataFrame, points: DataFrame, k: int, n: int, reach: float) -> DataFrame:
    """``(query_id, rank, point_id, d2)`` of the k nearest of the ``n`` points within a chord of
    ``reach`` (at most 2, which is the whole sphere).

    Cubes start at the size that the crowded parts need, where their queries are done with a
    bounded number of candidates; each pass doubles the edge for the queries that are left.
    """
    h, most, parts, done = 1.5 * math.sqrt(4 * math.pi * k / n), 8.0 * k, None, []
    if (crowd := _crowding(points, min(h, 2.0))) > most:
        h *= math.sqrt(most / crowd)
    pending = queries.select("query_id", "lon", "lat")
    while True:
        h = min(h, reach)
        ranked = _best(_candidates(pending, points, h).where(F.col("d2") <= h * h), k) if h < 2.0 else _best(_candidates(pending, points, h), k)
        last = h >= reach
        if not last:
            found = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
            ranked = ranked.withColumn("__n", found).where(F.col("__n") >= min(k, n)).drop("__n").persist()
        parts = ranked if parts is None else parts.unionByName(ranked)
        if last:
            break
        pending = pending.join(ranked.where("rank = 0").select("query_id"), "query_id", "left_anti").persist()
        done.append(pending)
        if pending.limit(1).count() == 0:
            break
        h *= 2
    for frame in done[:-1]:  # the last pass may still read the last one
        frame.unpersist()
    return parts


def nearest_within(queries: DataFrame, points: DataFrame, max_chord: float) -> DataFrame:
    """``queries(query_id, lon, lat)`` -> ``(query_id, point_id, chord)`` of the nearest point at
    most ``max_chord`` away; queries without one are left out. One pass if the radius is of the
    order of the spacing of the points, else it is approached from smaller cubes."""
    h, n = max(max_chord, 1e-6), points.count()
    if n * 9 * h * h / (4 * math.pi) > MANY:
        best = _search(queries, points, 1, n, h)
    else:
        best = _best(_candidates(queries, points, h), 1)
    return best.where(F.col("d2") <= max_chord * max_chord).select("query_id", "point_id", F.sqrt("d2").alias("chord"))


def find_nearest(queries: DataFrame, points: DataFrame, k: int = 1) -> DataFrame:
    """``queries(query_id, lon, lat)`` -> ``(query_id, rank, point_id, distance)``: the k nearest
    points (all, if there are fewer) by rank from 0, distance in metres along the surface."""
    n = points.count()
    if n == 0:
        return queries.select("query_id", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("point_id"), F.lit(None).cast("double").alias("distance")).where(F.lit(False))
    return _search(queries, points, max(1, k), n, 2.0).select("query_id", "rank", "point_id", chord_to_meters(F.sqrt("d2")).alias("distance"))
