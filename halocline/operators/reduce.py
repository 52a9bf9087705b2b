"""Weighted reductions over points and levels: sea ice, means, heat content, Hovmoeller.

A field is long: ``keys..., [level,] point_id, value``. A mesh has ``point_id, lon, lat, area``.
Every reduction is one join with the mesh and one hash aggregate on the keys, so Spark combines
partially before the exchange and only one row per key and task is shuffled. Masks are
``point_id`` tables applied as semi-joins, or boolean columns.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CP_SEAWATER, EXTENT_THRESHOLD, LATITUDE_EDGES, RHO_SEAWATER
from ..functions.missing import known, ratio


def _clip(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def masked(df: DataFrame, mask: DataFrame | Column | None) -> DataFrame:
    """Rows of points that the mask includes."""
    if mask is None:
        return df
    return df.where(mask) if isinstance(mask, Column) else df.join(mask.select("point_id").distinct(), "point_id", "left_semi")


def _hemisphere(name: str | None) -> Column | None:
    if name is None:
        return None
    if name not in ("north", "south"):
        raise ValueError(f"Unknown hemisphere: {name}")
    return F.col("lat") > 0 if name == "north" else F.col("lat") < 0


def _total(df: DataFrame, keys: list[str], term: Column, name: str, empty: float | None = 0.0) -> DataFrame:
    total = F.sum(term)
    return df.groupBy(*keys).agg((total if empty is None else F.coalesce(total, F.lit(empty))).alias(name))


def _on_mesh(field: DataFrame, mesh: DataFrame, mask, hemisphere: str | None) -> DataFrame:
    rows = masked(field.join(mesh.select("point_id", "lat", "area") if "lat" in mesh.columns else mesh.select("point_id", "area"), "point_id"), mask)
    side = _hemisphere(hemisphere)
    return rows if side is None else rows.where(side)


def ice_area(field: DataFrame, mesh: DataFrame, keys: list[str] = (), *, concentration: str = "concentration", mask=None, hemisphere: str | None = None) -> DataFrame:
    """Sum of concentration (clipped to 0..1) times area by key; 0 if nothing is known."""
    return _total(_on_mesh(field, mesh, mask, hemisphere), list(keys), _clip(known(F.col(concentration))) * F.col("area"), "ice_area")


def ice_volume(field: DataFrame, mesh: DataFrame, keys: list[str] = (), *, thickness: str = "thickness", concentration: str | None = None, mask=None, hemisphere: str | None = None) -> DataFrame:
    """Sum of thickness (at least 0), times concentration if named, times area by key."""
    h = F.greatest(known(F.col(thickness)), F.lit(0.0))
    h = F.when(known(F.col(thickness)).isNotNull(), h)
    c = F.lit(1.0)
    if concentration:
        c = F.when(known(F.col(concentration)).isNotNull(), _clip(known(F.col(concentration))))
    return _total(_on_mesh(field, mesh, mask, hemisphere), list(keys), h * c * F.col("area"), "ice_volume")


def ice_extent(field: DataFrame, mesh: DataFrame, keys: list[str] = (), *, concentration: str = "concentration", threshold: float = EXTENT_THRESHOLD, mask=None, hemisphere: str | None = None) -> DataFrame:
    """Area where the concentration reaches the threshold, by key."""
    return _total(_on_mesh(field, mesh, mask, hemisphere), list(keys), F.when(known(F.col(concentration)) >= threshold, F.col("area")), "ice_extent")


def ice_area_nh(field, mesh, keys=(), **kw):
    return ice_area(field, mesh, keys, hemisphere="north", **kw)


def ice_area_sh(field, mesh, keys=(), **kw):
    return ice_area(field, mesh, keys, hemisphere="south", **kw)


def ice_volume_nh(field, mesh, keys=(), **kw):
    return ice_volume(field, mesh, keys, hemisphere="north", **kw)


def ice_volume_sh(field, mesh, keys=(), **kw):
    return ice_volume(field, mesh, keys, hemisphere="south", **kw)


def ice_extent_nh(field, mesh, keys=(), **kw):
    return ice_extent(field, mesh, keys, hemisphere="north", **kw)


def ice_extent_sh(field, mesh, keys=(), **kw):
    return ice_extent(field, mesh, keys, hemisphere="south", **kw)


def ice_summary(field: DataFrame, mesh: DataFrame, keys: list[str] = (), *, concentration: str = "concentration", thickness: str = "thickness", threshold: float = EXTENT_THRESHOLD) -> DataFrame:
    """Area, volume and extent of both hemispheres in one pass over the field."""
    c, h, a = known(F.col(concentration)), known(F.col(thickness)), F.col("area")
    floor = F.when(h.isNotNull(), F.greatest(h, F.lit(0.0)))
    part = F.when(c.isNotNull(), _clip(c))
    terms = {"area": part * a, "volume": floor * part * a, "extent": F.when(c >= threshold, a)}
    sums = [F.coalesce(F.sum(F.when(_hemisphere(side), term)), F.lit(0.0)).alias(f"{name}_{short}") for side, short in (("north", "nh"), ("south", "sh")) for name, term in terms.items()]
    return _on_mesh(field, mesh, None, None).groupBy(*keys).agg(*sums)


def surface_mean(field: DataFrame, mesh: DataFrame, keys: list[str] = (), *, value: str = "value", mask=None) -> DataFrame:
    """Area-weighted mean of the known values by key; NULL without weight."""
    x, a = known(F.col(value)), F.col("area")
    rows = _on_mesh(field, mesh, mask, None)
    return rows.groupBy(*keys).agg(ratio(F.sum(x * a), F.sum(F.when(x.isNotNull(), a))).alias("mean"))


def check_levels(n_data: int, n_area: int) -> int:
    """How many levels of a per-level area to use: one extra is dropped with a warning."""
    if n_area == n_data + 1:
        warnings.warn("area has one more vertical level than data; the last is dropped", UserWarning, stacklevel=4)
        return n_data
    if n_area != n_data:
        raise ValueError(f"area has {n_area} levels, data has {n_data} levels")
    return n_data


def _check_axes(levels: DataFrame, area3d: DataFrame | None, thickness3d: DataFrame | None = None) -> None:
    """Holds the tables by level and point, which are as large as the mesh and not as the data,
    against the depth axis."""
    if area3d is None and thickness3d is None:
        return
    own = levels.select("level").distinct().count()
    if area3d is not None:
        check_levels(own, area3d.select("level").distinct().count())
    if thickness3d is not None and (given := thickness3d.select("level").distinct().count()) != own:
        raise ValueError(f"thickness has {given} levels, data has {own} levels")


def _on_levels(field: DataFrame, axis: DataFrame, keep: str | None = None) -> DataFrame:
    """``field`` joined with ``axis(level, ...)``; with ``keep`` only the rows where that column of the
    axis is true. A depth axis has tens of rows whatever the data, so it is broadcast. A row whose
    level the axis lacks is an error, found in the same pass: one condition tells both, since a
    second one on the axis would make the join an inner one, which passes over such rows."""
    told = F.concat(F.lit("the depth axis has no level "), F.col("level").cast("string"), F.lit(", the data levels have"))
    rows = field.join(F.broadcast(axis.withColumn("__level", F.lit(True))), "level", "left")
    kept = rows.where(F.when(F.col("__level").isNull(), F.raise_error(told).cast("boolean")).otherwise(F.col(keep) if keep else F.lit(True)))
    return kept.drop("__level", *([keep] if keep else []))


def _volume(field: DataFrame, mesh: DataFrame, levels: DataFrame, depth_min, depth_max, mask, area3d, thickness3d) -> DataFrame:
    _check_axes(levels, area3d, thickness3d)
    rows = _on_levels(field, _in_range(levels, depth_min, depth_max), "__in")
    if thickness3d is not None:
        rows = rows.drop("thickness").join(thickness3d.select("level", "point_id", "thickness"), ["level", "point_id"])
    if area3d is not None:
        rows = rows.join(area3d.select("level", "point_id", "area"), ["level", "point_id"])
    else:
        rows = rows.join(mesh.select("point_id", "area"), "point_id")
    return masked(rows, mask)


def volume_mean(field: DataFrame, mesh: DataFrame, levels: DataFrame, keys: list[str] = (), *, value: str = "value", depth_min=None, depth_max=None, mask=None, area3d: DataFrame | None = None, thickness3d: DataFrame | None = None) -> DataFrame:
    """Mean of the known values weighted by area and thickness; whole layers whose centre lies
    in the depth range (inclusive). ``area3d`` and ``thickness3d`` (level, point_id, ...) take
    the place of the mesh's and the levels'."""
    x, w = known(F.col(value)), F.col("thickness") * F.col("area")
    rows = _volume(field, mesh, levels, depth_min, depth_max, mask, area3d, thickness3d)
    return rows.groupBy(*keys).agg(ratio(F.sum(x * w), F.sum(F.when(x.isNotNull(), w))).alias("mean"))


def heat_content(field: DataFrame, mesh: DataFrame, levels: DataFrame, keys: list[str] = (), *, temperature: str = "temperature", depth_min=None, depth_max=None, reference_temp: float = 0.0, mask=None, rho: float = RHO_SEAWATER, cp: float = CP_SEAWATER, output: str = "total", area3d: DataFrame | None = None, thickness3d: DataFrame | None = None) -> DataFrame:
    """Ocean heat content: ``total`` in J by key (0 if nothing is known), or ``map`` in J/m2 by
    key and point, where area is not used and points outside the mask are 0."""
    if output not in ("total", "map"):
        raise ValueError("output must be 'total' or 'map'")
    warm = known(F.col(temperature)) - reference_temp
    if output == "total":
        rows = _volume(field, mesh, levels, depth_min, depth_max, mask, area3d, thickness3d)
        return rows.groupBy(*keys).agg((F.coalesce(F.sum(warm * F.col("thickness") * F.col("area")), F.lit(0.0)) * (rho * cp)).alias("heat_content"))
    _check_axes(levels, None, thickness3d)
    inside = _on_levels(field, _in_range(levels, depth_min, depth_max))
    if thickness3d is not None:
        inside = inside.drop("thickness").join(thickness3d.select("level", "point_id", "thickness"), ["level", "point_id"], "left")
        inside = inside.withColumn("thickness", F.when(F.col("__in"), F.col("thickness")))
    term = warm * F.when(F.col("__in"), F.col("thickness"))
    columns = inside.groupBy(*keys, "point_id").agg((F.coalesce(F.sum(term), F.lit(0.0)) * (rho * cp)).alias("heat_content"))
    if mask is None:
        return columns
    if isinstance(mask, Column):
        chosen = mesh.where(mask).select("point_id", F.lit(True).alias("__mask"))
    else:
        chosen = mask.select("point_id").distinct().withColumn("__mask", F.lit(True))
    return columns.join(chosen, "point_id", "left").withColumn("heat_content", F.when(F.col("__mask"), F.col("heat_content")).otherwise(0.0)).drop("__mask").select(*keys, "point_id", "heat_content")


def _in_range(levels: DataFrame, depth_min, depth_max) -> DataFrame:
    if (depth_min is not None or depth_max is not None) and "depth" not in levels.columns:
        raise ValueError("depth array required when depth_min or depth_max is given")
    keep = F.lit(True)
    if depth_min is not None:
        keep = keep & (F.col("depth") >= depth_min)
    if depth_max is not None:
        keep = keep & (F.col("depth") <= depth_max)
    return levels.select("level", *(["thickness"] if "thickness" in levels.columns else []), keep.alias("__in"))


def latitude_bin(lat: Column, edges: list[float]) -> Column:
    """Left-closed bin of a latitude; outside the edges the first or the last. NULL without one."""
    steps = {round(b - a, 12) for a, b in zip(edges, edges[1:])}
    n = len(edges) - 1
    if len(steps) == 1:
        raw = F.floor((lat - edges[0]) / (edges[1] - edges[0]))
    else:
        raw = sum(((lat >= e).cast("int") for e in edges[1:]), (lat >= edges[0]).cast("int")) - 1
    return F.when(lat.isNotNull() & ~F.isnan(lat), F.least(F.greatest(raw, F.lit(0)), F.lit(n - 1)).cast("int"))


def hovmoller(field: DataFrame, mesh: DataFrame, levels: DataFrame | None = None, *, time: str = "time", value: str = "value", mode: str = "depth", lat_bins: list[float] | None = None, mask=None, area3d: DataFrame | None = None) -> DataFrame:
    """``(time, y, value)``: area-weighted means by time and depth, or by time and latitude bin
    (y is its centre). Infinite values are missing. Every time has every level or bin; those
    without weight are NULL. In latitude mode several levels are first averaged unweighted."""
    if mode not in ("depth", "latitude"):
        raise ValueError(f"Invalid mode: {mode}")
    x = known(F.col(value), finite=True)
    spark = field.sparkSession
    if mode == "depth":
        if levels is None:
            raise ValueError("depth array required for depth mode")
        at = field.withColumn("level", F.lit(0)) if "level" not in field.columns else field
        _check_axes(levels, area3d)
        at = _on_levels(at, levels.select("level"))
        area = area3d.select("level", "point_id", "area") if area3d is not None else mesh.select("point_id", "area")
        rows = masked(at.join(area, ["level", "point_id"] if area3d is not None else "point_id"), mask)
        means = rows.groupBy(time, "level").agg(ratio(F.sum(x * F.col("area")), F.sum(F.when(x.isNotNull(), F.col("area")))).alias("__mean"))
        frame = field.select(time).distinct().crossJoin(F.broadcast(levels.select("level", F.col("depth").cast("double").alias("y"))))
        return frame.join(means, [time, "level"], "left").select(time, "y", F.col("__mean").alias("value"))
    if "lat" not in mesh.columns:
        raise ValueError("lat array required for latitude mode")
    edges = [float(e) for e in (lat_bins or LATITUDE_EDGES)]
    flat = field.withColumn("__x", x)
    flat = flat.groupBy(time, "point_id").agg(F.avg("__x").alias("__x")) if "level" in field.columns else flat.select(time, "point_id", "__x")
    banded = masked(mesh.select("point_id", "area", latitude_bin(F.col("lat"), edges).alias("__bin")), mask).where("__bin is not null")
    rows = flat.join(banded, "point_id")
    means = rows.groupBy(time, "__bin").agg(ratio(F.sum(F.col("__x") * F.col("area")), F.sum(F.when(F.col("__x").isNotNull(), F.col("area")))).alias("__mean"))
    bins = spark.createDataFrame([(i, (a + b) / 2) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "__bin int, y double")
    frame = field.select(time).distinct().crossJoin(F.broadcast(bins))
    return frame.join(means, [time, "__bin"], "left").select(time, "y", F.col("__mean").alias("value"))


def hovmoller_anomaly(result: DataFrame, *, time: str = "time", mode: str = "depth") -> DataFrame:
    """Differences from the first time of each depth; latitude results are returned as they are."""
    if mode != "depth":
        return result
    first = F.first("value").over(Window.partitionBy("y").orderBy(time))
    return result.withColumn("value", F.col("value") - first)
