"""Triangle meshes: element centres, areas, transfers between nodes and elements.

``elements(elem_id, n0, n1, n2)`` has 0-based point_ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coords import element_center, triangle_area
from ..functions.missing import known

_VERTICES = ("n0", "n1", "n2")


def with_vertices(elements: DataFrame, nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Elements with ``<column><v>`` of their three vertices: one exchange of the exploded
    vertices and one back by element, instead of three joins."""
    corner = F.posexplode(F.array(*_VERTICES)).alias("v", "point_id")
    joined = elements.select("elem_id", corner).join(nodes.select("point_id", *columns), "point_id", "left")
    picks = [F.max(F.when(F.col("v") == i, F.col(c))).alias(f"{c}{i}") for c in columns for i in range(3)]
    return elements.join(joined.groupBy("elem_id").agg(*picks), "elem_id")


def element_centers(elements: DataFrame, points: DataFrame) -> DataFrame:
    """``elements`` with ``lon_tri`` and ``lat_tri``; unchanged if they are there."""
    if {"lon_tri", "lat_tri"} <= set(elements.columns):
        return elements
    if not set(_VERTICES) <= set(elements.columns):
        raise ValueError("triangles are required for element centers")
    at = with_vertices(elements, points, ["lon", "lat"])
    lon, lat = element_center([F.col(f"lon{i}") for i in range(3)], [F.col(f"lat{i}") for i in range(3)])
    return at.select(*elements.columns, lon.alias("lon_tri"), lat.alias("lat_tri"))


def triangle_areas(elements: DataFrame, points: DataFrame) -> DataFrame:
    """``(elem_id, area)``."""
    at = with_vertices(elements, points, ["lon", "lat"])
    return at.select("elem_id", triangle_area([F.col(f"lon{i}") for i in range(3)], [F.col(f"lat{i}") for i in range(3)]).alias("area"))


def cluster_area(elements: DataFrame, points: DataFrame) -> DataFrame:
    """``points`` with ``area``: a third of the areas of the triangles around a node, 0 without
    one. A node that a degenerate triangle repeats counts once."""
    areas = elements.join(triangle_areas(elements, points), "elem_id")
    share = areas.select(F.explode(F.array_distinct(F.array(*_VERTICES))).alias("point_id"), (F.col("area") / 3.0).alias("__share"))
    summed = share.groupBy("point_id").agg(F.sum("__share").alias("__area"))
    return points.drop("area").join(summed, "point_id", "left").withColumn("area", F.coalesce("__area", F.lit(0.0))).drop("__area")


def node_to_element(field: DataFrame, elements: DataFrame, keys: list[str] = (), method: str = "mean", value: str = "value") -> DataFrame:
    """``(keys..., elem_id, value)`` from ``field(keys..., point_id, value)``; an unknown vertex
    makes the element unknown."""
    if method not in ("mean", "median", "min", "max"):
        raise ValueError(f"Unknown method: {method}")
    corners = elements.select("elem_id", F.posexplode(F.array(*_VERTICES)).alias("v", "point_id"))
    rows = corners.join(field.select(*keys, "point_id", known(F.col(value)).alias("x")), "point_id")
    all_known = F.count("x") == 3
    low, high, total = F.min("x"), F.max("x"), F.sum("x")
    by_vertex = [F.max(F.when(F.col("v") == i, F.col("x"))) for i in range(3)]
    result = {"mean": total / 3.0, "median": F.get(F.array_sort(F.array(*by_vertex)), F.lit(1)), "min": low, "max": high}[method]
    return rows.groupBy(*keys, "elem_id").agg(F.when(all_known, result).alias("value"))


def element_to_node(field: DataFrame, elements: DataFrame, points: DataFrame, keys: list[str] = (), method: str = "mean", value: str = "value") -> DataFrame:
    """``(keys..., point_id, value)`` from ``field(keys..., elem_id, value)``: mean or sum over the
    elements around each node, 0 without one; an unknown element makes its nodes unknown."""
    if method not in ("mean", "sum"):
        raise ValueError(f"Unknown method: {method}")
    corners = elements.select("elem_id", F.explode(F.array(*_VERTICES)).alias("point_id"))
    rows = corners.join(field.select(*keys, "elem_id", known(F.col(value)).alias("x")), "elem_id")
    total = F.when(F.count("x") == F.count(F.lit(1)), F.sum("x"))
    made = rows.groupBy(*keys, "point_id").agg((total if method == "sum" else total / F.count(F.lit(1))).alias("__v"), F.lit(True).alias("__hit"))
    frame = points.select("point_id")
    if keys:
        frame = field.select(*keys).distinct().crossJoin(frame)
    return frame.join(made, [*keys, "point_id"], "left").select(*keys, "point_id", F.when(F.col("__hit"), F.col("__v")).otherwise(0.0).alias("value"))


def mask_by_depth(field: DataFrame, area3d: DataFrame, value: str = "value") -> DataFrame:
    """``field(level, point_id, value, ...)`` with NULL where ``area3d(level, point_id, area)`` has
    no area, that is below the bottom. A row whose level and point ``area3d`` lacks is an error,
    found in the same pass."""
    wet = area3d.select("level", "point_id", known(F.col("area")).alias("__area"), F.lit(True).alias("__there"))
    told = F.concat(F.lit("data shape does not match nod_area_nans shape: no level "), F.col("level").cast("string"), F.lit(", point "), F.col("point_id").cast("string"))
    joined = field.join(wet, ["level", "point_id"], "left").where(F.coalesce("__there", F.raise_error(told).cast("boolean")))
    return joined.withColumn(value, F.when(F.col("__area").isNotNull(), F.col(value).cast("double"))).drop("__area", "__there")
