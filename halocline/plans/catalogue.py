"""Named queries over the supplied tables, each with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coords
from ..operators import grids, reduce, regrid, sections, shaping, spatial, topology, vertical
from ..sources import files, healpix, load, netcdf
from ..sources.mesh import Mesh, find_coordinates, is_mesh, lonlat_mesh, mesh_from_df, mesh_kind, open_dataset, validate_mesh, with_metadata
from ..streaming.ice import windowed_reduction
from . import derive, projections

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
R = 6_371_000.0


def register(sql: str, shared: bool = True):
    """Adds a query under its function's name; sql may use the tables of ``derive.SQL``."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"WITH {derive.SQL}{sql if sql.lstrip().startswith(',') else ' ' + sql}" if shared else sql
        return f

    return add


def _rounded(df: DataFrame, digits: int = 6, **scale: float) -> DataFrame:
    """Floating columns rounded, after division by a scale where one is given."""
    return df.select(*(F.round(F.col(n) / scale.get(n, 1.0), digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes))


_CLIP = "least(greatest(concentration, 0), 1)"


@register(f"""SELECT time,
  round(coalesce(sum(CASE WHEN lat > 0 AND concentration IS NOT NULL THEN {_CLIP} * area END), 0) / 1e6, 6) AS area_nh,
  round(coalesce(sum(CASE WHEN lat > 0 AND concentration IS NOT NULL THEN greatest(thickness, 0) * {_CLIP} * area END), 0) / 1e6, 6) AS volume_nh,
  round(coalesce(sum(CASE WHEN lat > 0 AND concentration >= 0.15 THEN area END), 0) / 1e6, 6) AS extent_nh,
  round(coalesce(sum(CASE WHEN lat < 0 AND concentration IS NOT NULL THEN {_CLIP} * area END), 0) / 1e6, 6) AS area_sh,
  round(coalesce(sum(CASE WHEN lat < 0 AND concentration IS NOT NULL THEN greatest(thickness, 0) * {_CLIP} * area END), 0) / 1e6, 6) AS volume_sh,
  round(coalesce(sum(CASE WHEN lat < 0 AND concentration >= 0.15 THEN area END), 0) / 1e6, 6) AS extent_sh
  FROM ice JOIN points USING (point_id) GROUP BY time""")
def ice_by_hemisphere(spark, d):
    names = [f"{a}_{b}" for b in ("nh", "sh") for a in ("area", "volume", "extent")]
    return _rounded(reduce.ice_summary(derive.ice(spark, d), derive.points(spark, d), ["time"]), **dict.fromkeys(names, 1e6))


@register(f"SELECT time, round(coalesce(sum(CASE WHEN concentration IS NOT NULL THEN {_CLIP} * area END), 0) / 1e6, 6) AS ice_area FROM ice JOIN points USING (point_id) WHERE lon > 0 GROUP BY time")
def ice_area_masked(spark, d):
    return _rounded(reduce.ice_area(derive.ice(spark, d), derive.points(spark, d), ["time"], mask=derive.points(spark, d).where("lon > 0")), ice_area=1e6)


@register(f"SELECT time, round(coalesce(sum(CASE WHEN lat > 0 AND concentration IS NOT NULL THEN {_CLIP} * area END), 0) / 1e6, 6) AS ice_area FROM ice JOIN points USING (point_id) WHERE lat > 0 GROUP BY time")
def ice_area_nh(spark, d):
    return _rounded(reduce.ice_area_nh(derive.ice(spark, d), derive.points(spark, d), ["time"]), ice_area=1e6)


@register(f"SELECT time, round(coalesce(sum(CASE WHEN concentration IS NOT NULL THEN {_CLIP} * area END), 0) / 1e6, 6) AS ice_area FROM ice JOIN points USING (point_id) WHERE lat < 0 GROUP BY time")
def ice_area_sh(spark, d):
    return _rounded(reduce.ice_area_sh(derive.ice(spark, d), derive.points(spark, d), ["time"]), ice_area=1e6)


@register("SELECT time, round(coalesce(sum(greatest(thickness, 0) * area), 0) / 1e6, 6) AS ice_volume FROM ice JOIN points USING (point_id) WHERE thickness IS NOT NULL GROUP BY time")
def ice_volume_effective(spark, d):
    return _rounded(reduce.ice_volume(derive.ice(spark, d), derive.points(spark, d), ["time"]), ice_volume=1e6)


@register(f"SELECT time, round(coalesce(sum(CASE WHEN thickness IS NOT NULL THEN greatest(thickness, 0) * {_CLIP} * area END), 0) / 1e6, 6) AS ice_volume FROM ice JOIN points USING (point_id) WHERE lat > 0 GROUP BY time")
def ice_volume_nh(spark, d):
    return _rounded(reduce.ice_volume_nh(derive.ice(spark, d), derive.points(spark, d), ["time"], concentration="concentration"), ice_volume=1e6)


@register(f"SELECT time, round(coalesce(sum(CASE WHEN thickness IS NOT NULL THEN greatest(thickness, 0) * {_CLIP} * area END), 0) / 1e6, 6) AS ice_volume FROM ice JOIN points USING (point_id) WHERE lat < 0 GROUP BY time")
def ice_volume_sh(spark, d):
    return _rounded(reduce.ice_volume_sh(derive.ice(spark, d), derive.points(spark, d), ["time"], concentration="concentration"), ice_volume=1e6)


@register("SELECT time, round(coalesce(sum(CASE WHEN concentration >= 0.5 THEN area END), 0) / 1e6, 6) AS ice_extent FROM ice JOIN points USING (point_id) GROUP BY time")
def ice_extent_threshold(spark, d):
    return _rounded(reduce.ice_extent(derive.ice(spark, d), derive.points(spark, d), ["time"], threshold=0.5), ice_extent=1e6)


@register("SELECT time, round(coalesce(sum(CASE WHEN concentration >= 0.15 THEN area END), 0) / 1e6, 6) AS ice_extent FROM ice JOIN points USING (point_id) WHERE lat > 0 GROUP BY time")
def ice_extent_nh(spark, d):
    return _rounded(reduce.ice_extent_nh(derive.ice(spark, d), derive.points(spark, d), ["time"]), ice_extent=1e6)


@register("SELECT time, round(coalesce(sum(CASE WHEN concentration >= 0.15 THEN area END), 0) / 1e6, 6) AS ice_extent FROM ice JOIN points USING (point_id) WHERE lat < 0 GROUP BY time")
def ice_extent_sh(spark, d):
    return _rounded(reduce.ice_extent_sh(derive.ice(spark, d), derive.points(spark, d), ["time"]), ice_extent=1e6)


@register("""SELECT o_orderstatus AS status, round(sum(o_totalprice * area) / sum(area), 4) AS mean
  FROM orders JOIN points ON point_id = o_custkey GROUP BY o_orderstatus""")
def surface_mean(spark, d):
    field = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("point_id"), F.col("o_totalprice").alias("value"))
    return _rounded(reduce.surface_mean(field, derive.points(spark, d), ["status"]), 4)


@register("""SELECT time, round(sum(value * thickness * area) / sum(CASE WHEN value IS NOT NULL THEN thickness * area END), 6) AS mean
  FROM field3d JOIN levels USING (level) JOIN points USING (point_id) WHERE depth BETWEEN 10 AND 400 GROUP BY time""")
def volume_mean(spark, d):
    return _rounded(reduce.volume_mean(derive.field3d(spark, d), derive.points(spark, d), derive.levels(spark), ["time"], depth_min=10, depth_max=400))


_AREA3D = "(SELECT level, point_id, CASE WHEN point_id % 7 <> level THEN area END AS area FROM points, levels)"


def _area3d(spark, d):
    grid = derive.points(spark, d).crossJoin(F.broadcast(derive.levels(spark)))
    return grid.select("level", "point_id", F.when(F.col("point_id") % 7 != F.col("level"), F.col("area")).alias("area"))


@register(f"""SELECT time, round(sum(value * thickness * area) / sum(CASE WHEN value IS NOT NULL THEN thickness * area END), 6) AS mean
  FROM field3d JOIN levels USING (level) JOIN {_AREA3D} a USING (level, point_id) GROUP BY time""")
def volume_mean_area3d(spark, d):
    return _rounded(reduce.volume_mean(derive.field3d(spark, d), derive.points(spark, d), derive.levels(spark), ["time"], area3d=_area3d(spark, d)))


@register("""SELECT time, round(coalesce(sum((value - 2) * thickness * area), 0) * 1025 * 3990 / 1e15, 6) AS heat_content
  FROM field3d JOIN levels USING (level) JOIN points USING (point_id) WHERE depth <= 150 GROUP BY time""")
def heat_content_total(spark, d):
    return _rounded(reduce.heat_content(derive.field3d(spark, d), derive.points(spark, d), derive.levels(spark), ["time"], temperature="value", depth_max=150, reference_temp=2.0), heat_content=1e15)


@register("""SELECT time, point_id, CASE WHEN lat > 0 THEN round(coalesce(sum(CASE WHEN depth <= 700 THEN value * thickness END), 0) * 1025 * 3990 / 314159265.0, 4) ELSE 0.0 END AS heat_content
  FROM field3d JOIN levels USING (level) JOIN points USING (point_id) GROUP BY time, point_id, lat""")
def heat_content_map(spark, d):
    mesh = derive.points(spark, d)
    return _rounded(reduce.heat_content(derive.field3d(spark, d), mesh, derive.levels(spark), ["time"], temperature="value", depth_max=700, output="map", mask=F.col("lat") > 0), 4, heat_content=314159265.0)


_HOV_DEPTH = """SELECT t.time, l.depth AS y, sum(value * area) / sum(CASE WHEN value IS NOT NULL THEN area END) AS value
  FROM (SELECT DISTINCT time FROM field3d) t CROSS JOIN levels l LEFT JOIN field3d f ON f.time = t.time AND f.level = l.level
  LEFT JOIN points USING (point_id) GROUP BY t.time, l.depth"""


@register(f"SELECT time, y, round(value, 6) AS value FROM ({_HOV_DEPTH})")
def hovmoller_depth(spark, d):
    return _rounded(reduce.hovmoller(derive.field3d(spark, d), derive.points(spark, d), derive.levels(spark)))


@register(f"SELECT time, y, round(value - first_value(value) OVER (PARTITION BY y ORDER BY time), 6) AS value FROM ({_HOV_DEPTH})")
def hovmoller_depth_anomaly(spark, d):
    return _rounded(reduce.hovmoller_anomaly(reduce.hovmoller(derive.field3d(spark, d), derive.points(spark, d), derive.levels(spark))))


def _hov_lat(bins: str, bin_of: str) -> str:
    return f"""SELECT t.time, b.y, round(sum(v * area) / sum(CASE WHEN v IS NOT NULL THEN area END), 6) AS value
  FROM (SELECT DISTINCT time FROM field3d) t CROSS JOIN ({bins}) b
  LEFT JOIN (SELECT time, v, area, {bin_of} AS bin FROM (SELECT time, point_id, avg(value) AS v FROM field3d GROUP BY ALL) JOIN points USING (point_id)) f
  ON f.time = t.time AND f.bin = b.bin GROUP BY t.time, b.y"""


@register(_hov_lat("SELECT range AS bin, -87.5 + 5e0 * range AS y FROM range(36)", "least(greatest(floor((lat + 90) / 5), 0), 35)"))
def hovmoller_latitude(spark, d):
    return _rounded(reduce.hovmoller(derive.field3d(spark, d), derive.points(spark, d), mode="latitude"))


@register(_hov_lat("SELECT * FROM (VALUES (0, -45e0), (1, -5e0), (2, 4e1)) v(bin, y)", "CASE WHEN lat < -30 THEN 0 WHEN lat < 20 THEN 1 ELSE 2 END"))
def hovmoller_latitude_uneven(spark, d):
    return _rounded(reduce.hovmoller(derive.field3d(spark, d), derive.points(spark, d), mode="latitude", lat_bins=[-60, -30, 20, 60]))


@register("SELECT point_id, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z, round(lon, 6) AS lon, round(lat, 6) AS lat FROM xyz")
def cartesian_round_trip(spark, d):
    x, y, z = coords.lonlat_to_cartesian("lon", "lat")
    at = derive.points(spark, d).select("point_id", x.alias("x"), y.alias("y"), z.alias("z"))
    lon, lat = coords.cartesian_to_lonlat("x", "y", "z")
    return at.select("point_id", *(F.round(c, 9).alias(c) for c in "xyz"), F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


@register("""SELECT point_id, round(2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - 45.0) / 2), 2) + cos(radians(45.0)) * cos(radians(lat)) * pow(sin(radians(lon - 10.0) / 2), 2)))), 2) AS metres,
  round(2 * sin(point_id * 1000.0 / (2 * 6371000.0)), 9) AS chord, round(2 * 6371000.0 * asin(point_id / 2000000.0), 3) AS along FROM points""")
def great_circle(spark, d):
    p = derive.points(spark, d)
    far = coords.great_circle_distance(10.0, 45.0, "lon", "lat")
    return p.select("point_id", F.round(far, 2).alias("metres"), F.round(coords.meters_to_chord(F.col("point_id") * 1000.0), 9).alias("chord"), F.round(coords.chord_to_meters(F.col("point_id") / 1000000.0), 3).alias("along"))


_PATH = """SELECT range AS i, degrees(atan2(y, x)) AS lon, degrees(asin(z / sqrt(x * x + y * y + z * z))) AS lat FROM (
  SELECT range, (1 - t) * ax + t * bx AS x, (1 - t) * ay + t * by_ AS y, (1 - t) * az + t * bz AS z FROM (
  SELECT range, range / 49.0 AS t, cos(radians(10.0)) * cos(radians(-30.0)) AS ax, cos(radians(10.0)) * sin(radians(-30.0)) AS ay, sin(radians(10.0)) AS az,
  cos(radians(55.0)) * cos(radians(40.0)) AS bx, cos(radians(55.0)) * sin(radians(40.0)) AS by_, sin(radians(55.0)) AS bz FROM range(50)))"""
_DISTANCE = f"""SELECT i, lon, lat, sum(step) OVER (ORDER BY i) AS distance_km FROM (
  SELECT *, coalesce(sqrt(pow(lat - lag(lat) OVER w, 2) + pow((lon - lag(lon) OVER w) * cos(radians(lag(lat) OVER w)), 2)) * 111, 0) AS step FROM ({_PATH}) WINDOW w AS (ORDER BY i))"""


@register(f"SELECT i, round(lon, 6) AS lon, round(lat, 6) AS lat, round(distance_km, 6) AS distance_km FROM ({_DISTANCE})", shared=False)
def path_distance(spark, d):
    return _rounded(sections.path_distance(coords.great_circle_path(spark, (-30.0, 10.0), (40.0, 55.0), 50)))


@register("""SELECT c_custkey AS id, round(a - 360 * floor(a / 360.0) - 180, 6) AS pm180, round(b - 360 * floor(b / 360.0), 6) AS east
  FROM (SELECT c_custkey, c_custkey * 7.25 - 900 + 180 AS a, c_custkey * 7.25 - 900 AS b FROM customer)""", shared=False)
def normalize_lon(spark, d):
    x = F.col("c_custkey") * 7.25 - 900
    return _rounded(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), coords.normalize_lon(x).alias("pm180"), coords.normalize_lon(x, "0360").alias("east")))


@register(f"""SELECT j * 72 + i AS cell_id, CAST(j AS INTEGER) AS i_lat, CAST(i AS INTEGER) AS i_lon, -177.5 + 5e0 * i AS lon, -87.5 + 5e0 * j AS lat,
  round(abs(sin(radians(-87.5 + 5.0 * j) + radians(2.5)) - sin(radians(-87.5 + 5.0 * j) - radians(2.5))) * radians(5.0) * {R} * {R} / 1e6, 4) AS area
  FROM (SELECT range AS j FROM range(36)), (SELECT range AS i FROM range(72))""", shared=False)
def regular_grid(spark, d):
    g = grids.regular_grid(spark, 5.0)
    return g.withColumn("area", F.round(grids.grid_cell_area(F.col("lat"), 5.0, 5.0) / 1e6, 4))


@register(f"""SELECT CAST(j AS INTEGER) AS i_lat, CAST(i AS INTEGER) AS i_lon, -178.0 + 4e0 * i AS lon, -88.0 + 4e0 * j AS lat,
  round(abs(sin(radians(-86.0 + 4 * j)) - sin(radians(-90.0 + 4 * j))) * radians(4.0) * {R} * {R} / 1e6, 4) AS area
  FROM (SELECT range AS j FROM range(45)), (SELECT range AS i FROM range(90))""", shared=False)
def lonlat_grid(spark, d):
    p = lonlat_mesh(spark, 4.0).points
    return p.select("i_lat", "i_lon", "lon", "lat", F.round(F.col("area") / 1e6, 4).alias("area"))


@register(f"SELECT point_id, round(4 * pi() * {R} * {R} / count(*) OVER () * cos(radians(lat)) / avg(cos(radians(lat))) OVER () / 1e6, 3) AS area FROM points")
def estimated_area(spark, d):
    mesh = mesh_from_df(derive.points(spark, d).select("point_id", "lon", "lat"))
    return mesh.points.select("point_id", F.round(F.col("area") / 1e6, 3).alias("area"))


_STRUCTURED = "(SELECT a.range AS j, b.range AS i, b.range * 1e1 - 175 + a.range * 5e-1 AS lon, a.range * 8e0 - 80 AS lat, CASE WHEN (a.range * 36 + b.range) % 5 = 0 THEN 0 ELSE 1 END AS tmask FROM range(21) a, range(36) b)"


def _structured(spark):
    g = spark.range(21 * 36).select(F.floor(F.col("id") / 36).alias("j"), (F.col("id") % 36).alias("i"))
    return g.select("j", "i", (F.col("i") * 10.0 - 175 + F.col("j") * 0.5).alias("lon"), (F.col("j") * 8.0 - 80).alias("lat"), F.when((F.col("j") * 36 + F.col("i")) % 5 == 0, 0).otherwise(1).alias("tmask"))


@register(f"""SELECT row_number() OVER (ORDER BY j, i) - 1 AS point_id, j * 36 + i AS flat_idx, round(lon - 360 * floor((lon + 180) / 360), 6) AS lon, lat, round({R} * {R} * cos(radians(lat)) * radians(dlon) * radians(dlat) / 1e6, 4) AS area FROM (
  SELECT *, abs(coalesce((lead(lon) OVER r - lag(lon) OVER r) / 2, lead(lon) OVER r - lon, lon - lag(lon) OVER r)) AS dlon,
  abs(coalesce((lead(lat) OVER c - lag(lat) OVER c) / 2, lead(lat) OVER c - lat, lat - lag(lat) OVER c)) AS dlat
  FROM {_STRUCTURED} WINDOW r AS (PARTITION BY j ORDER BY i), c AS (PARTITION BY i ORDER BY j)) WHERE tmask > 0""", shared=False)
def structured_mesh(spark, d):
    p = load.load_structured(_structured(spark)).points
    return p.select("point_id", "flat_idx", F.round("lon", 6).alias("lon"), "lat", F.round(F.col("area") / 1e6, 4).alias("area"))


@register(f"SELECT j, i, j * 36 + i AS flat_idx, CASE WHEN tmask > 0 THEN lat * 2 END AS value FROM {_STRUCTURED}", shared=False)
def flatten_unflatten(spark, d):
    g = _structured(spark)
    values = load.flatten_structured(g, "tmask").select("flat_idx", (F.col("lat") * 2).alias("value"))
    return load.unflatten(values, g).select("j", "i", "flat_idx", "value")


@register("SELECT level, (depth + lead(depth) OVER w) / 2 AS depth, depth AS depth_top, lead(depth) OVER w AS depth_bottom, lead(depth) OVER w - depth AS thickness FROM levels WINDOW w AS (ORDER BY level) QUALIFY depth_bottom IS NOT NULL")
def vertical_metrics(spark, d):
    return grids.vertical_metrics(derive.levels(spark).select("level", "depth"))


@register("SELECT point_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM points WHERE lon BETWEEN -60 AND 20 AND lat BETWEEN -10 AND 50")
def bbox(spark, d):
    return _rounded(spatial.subset_by_bbox(derive.points(spark, d), -60, 20, -10, 50).select("point_id", "lon", "lat"))


@register("SELECT point_id, (abs(lon) + abs(lat) < 50) AS inside FROM points")
def polygon(spark, d):
    return spatial.points_in_polygon(derive.points(spark, d), [50, 0, -50, 0], [0, 50, 0, -50]).select("point_id", "inside")


@register("""SELECT point_id, lon > -170 AND lon < -120 AND abs(lat) < 5 AS nino34, lon > -150 AND lon < -90 AND abs(lat) < 5 AS nino3,
  ((lon > 160 AND lon < 180) OR (lon > -180 AND lon < -150)) AND abs(lat) < 5 AS nino4 FROM points""")
def region_masks(spark, d):
    at = F.col("lon"), F.col("lat")
    return derive.points(spark, d).select("point_id", *(spatial.region_mask(*at, n).alias(a) for n, a in (("Nino 3.4", "nino34"), ("Nino 3", "nino3"), ("Nino 4", "nino4"))))


def _grid_sql(step: float) -> str:
    n, m = int(360 / step), int(180 / step)
    return f"""grid AS (SELECT j * {n} + i AS cell_id, CAST(j AS INTEGER) AS i_lat, CAST(i AS INTEGER) AS i_lon, lon, lat, cos(radians(lat)) * cos(radians(lon)) AS gx, cos(radians(lat)) * sin(radians(lon)) AS gy, sin(radians(lat)) AS gz
    FROM (SELECT a.range AS j, b.range AS i, {-180 + step / 2} + CAST({step} AS DOUBLE) * b.range AS lon, {-90 + step / 2} + CAST({step} AS DOUBLE) * a.range AS lat FROM range({m}) a, range({n}) b))"""


def _pairs(degrees: float) -> str:
    """Cells and points within so many degrees of latitude, which is no nearer than they are."""
    return f"(SELECT cell_id, point_id, pow(gx - x, 2) + pow(gy - y, 2) + pow(gz - z, 2) AS d2 FROM grid JOIN xyz ON xyz.lat BETWEEN grid.lat - {degrees} AND grid.lat + {degrees})"


def _nearest(radius: float) -> str:
    """The nearest point of each cell that has one within a radius in metres."""
    reach = f"pow(2 * sin({radius} / (2 * {R})), 2)"
    return f"(SELECT cell_id, arg_min(point_id, d2) AS point_id FROM {_pairs(radius / 111_000 + 0.1)} WHERE d2 <= {reach} GROUP BY cell_id)"


@register(f""", {_grid_sql(30.0)} SELECT cell_id AS query_id, CAST(rn - 1 AS INTEGER) AS rank, point_id, round(2 * {R} * asin(least(1.0, sqrt(d2) / 2)), 0) AS distance
  FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY round(d2, 12), point_id) AS rn FROM {_pairs(180)}) WHERE rn <= 3""")
def find_nearest(spark, d):
    q = grids.regular_grid(spark, 30.0).select(F.col("cell_id").alias("query_id"), "lon", "lat")
    return spatial.find_nearest(q, derive.points(spark, d), 3).withColumn("distance", F.round("distance", 0))


@register(f""", {_grid_sql(5.0)} SELECT grid.cell_id, i_lat, i_lon, grid.lon, grid.lat, value FROM grid
  LEFT JOIN {_nearest(400_000.0)} USING (cell_id) LEFT JOIN surface USING (point_id)""")
def regrid_nearest(spark, d):
    return regrid.regrid(derive.surface(spark, d), derive.points(spark, d), resolution=5.0, influence_radius=400_000.0)[0]


_COARSE = "SELECT b.range AS i, a.range AS j, b.range * 2e1 - 170 + a.range * 1e-3 AS lon, a.range * 2e1 - 80 + b.range * 1e-4 AS lat, CAST((a.range * 18 + b.range) % 7 AS DOUBLE) AS value FROM range(9) a, range(18) b"


def _coarse(spark):
    g = spark.range(162).select(F.floor(F.col("id") / 18).alias("j"), (F.col("id") % 18).alias("i"), (F.col("id") % 7).cast("double").alias("value"))
    return g.withColumns({"lon": F.col("i") * 20.0 - 170 + F.col("j") * 0.001, "lat": F.col("j") * 20.0 - 80 + F.col("i") * 0.0001})


@register(f"""WITH {_grid_sql(15.0)}, coarse AS ({_COARSE}), c AS (SELECT *, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM coarse)
  SELECT cell_id, i_lat, i_lon, grid.lon, grid.lat, coalesce(value, -1) AS value FROM grid LEFT JOIN (SELECT cell_id, arg_min(value, d2) AS value
  FROM (SELECT cell_id, value, pow(gx - x, 2) + pow(gy - y, 2) + pow(gz - z, 2) AS d2 FROM grid, c) WHERE d2 <= pow(2 * sin(1500000.0 / (2 * {R})), 2) GROUP BY cell_id) USING (cell_id)""", shared=False)
def regrid_2d_coordinates(spark, d):
    g = _coarse(spark)
    return regrid.regrid(g.select("j", "i", "value"), g, resolution=15.0, influence_radius=1_500_000.0, fill_value=-1.0)[0]


@register(f"""WITH {_grid_sql(30.0)}, axes AS (SELECT b.range AS i, a.range AS j, b.range * 2.1e1 - 171 AS lon, a.range * 1.9e1 - 77 AS lat FROM range(9) a, range(17) b),
  c AS (SELECT *, cos(radians(lat)) * cos(radians(lon)) AS x, cos(radians(lat)) * sin(radians(lon)) AS y, sin(radians(lat)) AS z FROM axes)
  SELECT level, cell_id, i_lat, i_lon, grid.lon, grid.lat, round(CASE WHEN p IS NOT NULL THEN level * 1e3 + p END, 6) AS value FROM (SELECT CAST(range AS INTEGER) AS level FROM range(3)) CROSS JOIN grid
  LEFT JOIN (SELECT cell_id, arg_min(j * 17 + i, d2) AS p FROM (SELECT cell_id, i, j, pow(gx - x, 2) + pow(gy - y, 2) + pow(gz - z, 2) AS d2 FROM grid, c) WHERE d2 <= pow(2 * sin(900000.0 / (2 * {R})), 2) GROUP BY cell_id) USING (cell_id)""", shared=False)
def regrid_axes_by_level(spark, d):
    import warnings

    lon, lat = (spark.range(n).select(F.col("id").alias(k), (F.col("id") * step + first).alias(name)) for n, k, step, first, name in ((17, "i", 21.0, -171.0, "lon"), (9, "j", 19.0, -77.0, "lat")))
    field = spark.range(3 * 9 * 17).select(F.floor(F.col("id") / 153).cast("int").alias("level"), F.floor(F.col("id") % 153 / 17).alias("j"), (F.col("id") % 17).alias("i"))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return _rounded(regrid.regrid(field.withColumn("value", F.col("level") * 1000.0 + F.col("j") * 17 + F.col("i")), keys=["level"], lon=lon, lat=lat, resolution=30.0, influence_radius=900_000.0)[0])


@register(f""", {_grid_sql(15.0)} SELECT time, cell_id, value, point_id IS NOT NULL AS valid FROM (SELECT DISTINCT time FROM ice) CROSS JOIN grid
  LEFT JOIN {_nearest(600_000.0)} USING (cell_id) LEFT JOIN (SELECT time, point_id, concentration AS value FROM ice) USING (time, point_id)""")
def regrid_by_time(spark, d):
    made = regrid.build(derive.points(spark, d), 15.0, influence_radius=600_000.0)
    gridded = made(derive.ice(spark, d), ["time"], "concentration")
    return gridded.join(made.weights.select("cell_id", "valid"), "cell_id").select("time", "cell_id", "value", "valid")


@register(f""", {_grid_sql(20.0)} SELECT (SELECT count(*) FROM {_nearest(700_000.0)}) AS valid, (SELECT count(*) FROM {_nearest(900_000.0)}) AS wider, 2 AS held, 2 AS held_again, true AS same_key, true AS other_key, true AS kept_on_disk, 0 AS after_clear""")
def weights_cache(spark, d):
    mesh, near, wide = derive.points(spark, d), {"resolution": 20.0, "influence_radius": 700_000.0}, {"resolution": 20.0, "influence_radius": 900_000.0}
    folder = files.scratch(spark, "weights")
    cache = regrid.set_cache_options(spark, 2, folder)
    third = cache.get_or_create(mesh, resolution=30.0, influence_radius=700_000.0)  # put out by the other two
    first, second = cache.get_or_create(mesh, **near), cache.get_or_create(mesh, **wide)
    counts = [int(x.weights.where("valid").count()) for x in (first, second)]
    held, again = len(cache), cache.get_or_create(mesh, **near)
    key = cache.key(mesh, **near)
    row = (*counts, held, len(cache), again is first and third is not first, key != cache.key(mesh, **wide) and key != cache.key(mesh.limit(5), **near), files.exists(spark, f"{folder}/{key}"))
    regrid.clear_cache(spark)
    return spark.createDataFrame([(*row, len(regrid.get_cache(spark)))], "valid long, wider long, held int, held_again int, same_key boolean, other_key boolean, kept_on_disk boolean, after_clear int")


@register(f""", {_grid_sql(10.0)} SELECT CAST(i_lat - 9 AS INTEGER) AS i_lat, i_lon, grid.lon, grid.lat, value FROM grid
  LEFT JOIN {_nearest(900_000.0)} USING (cell_id) LEFT JOIN surface USING (point_id) WHERE grid.lat > 0""")
def map_north_polar(spark, d):
    return sections.map_table(derive.surface(spark, d), derive.points(spark, d), projection="np", resolution=10.0, influence_radius=900_000.0)


@register(f""", path AS ({_DISTANCE}), near AS (SELECT i, arg_min(point_id, pow(cos(radians(p.lat)) * cos(radians(p.lon)) - x, 2) + pow(cos(radians(p.lat)) * sin(radians(p.lon)) - y, 2) + pow(sin(radians(p.lat)) - z, 2)) AS point_id FROM path p, xyz GROUP BY i)
  SELECT i, round(lon, 6) AS lon, round(lat, 6) AS lat, round(distance_km, 6) AS distance_km, level, depth, value FROM path JOIN near USING (i) JOIN profile USING (point_id) JOIN levels USING (level)""")
def transect(spark, d):
    t = sections.transect(derive.profile(spark, d), derive.points(spark, d), derive.levels(spark), (-30.0, 10.0), (40.0, 55.0), 50)
    return t.select("i", *(F.round(c, 6).alias(c) for c in ("lon", "lat", "distance_km")), "level", "depth", "value")


_TARGETS = [0.0, 5.0, 17.5, 42.5, 105.0, 700.0, 1200.0]


@register(f"""SELECT target, b.level AS level, b.depth AS depth FROM (SELECT target, min({{'d': abs(depth - target), 'level': level, 'depth': depth}}) AS b
  FROM levels, (SELECT CAST(unnest({_TARGETS}) AS DOUBLE) AS target) GROUP BY target)""")
def closest_depth(spark, d):
    return vertical.closest_depths(derive.levels(spark), spark.createDataFrame([(t,) for t in _TARGETS], "target double"))


@register("""SELECT p.point_id, t.depth, round(a.value + (b.value - a.value) * (t.depth - t.d0) / (t.d1 - t.d0), 6) AS value FROM points p,
  (SELECT * FROM (VALUES (175e-1, 1, 2, 10.0, 25.0), (60.0, 2, 3, 25.0, 60.0), (1.0, 0, 1, 2.5, 10.0), (1200.0, 5, 6, 400.0, 1000.0)) v(depth, lo, hi, d0, d1)) t
  JOIN profile a ON a.point_id = p.point_id AND a.level = t.lo JOIN profile b ON b.point_id = p.point_id AND b.level = t.hi""")
def interpolate_to_depth(spark, d):
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # two targets are extrapolated on purpose
        return _rounded(vertical.interpolate_to_depth(derive.profile(spark, d), derive.levels(spark), [17.5, 60.0, 1.0, 1200.0]))


_CORNERS = "elements e JOIN xyz a ON a.point_id = n0 JOIN xyz b ON b.point_id = n1 JOIN xyz c ON c.point_id = n2"
_TRIANGLE = f"0.5 * sqrt(pow((b.y - a.y) * (c.z - a.z) - (b.z - a.z) * (c.y - a.y), 2) + pow((b.z - a.z) * (c.x - a.x) - (b.x - a.x) * (c.z - a.z), 2) + pow((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x), 2)) * {R} * {R}"


@register(f"""SELECT elem_id, round(CASE WHEN far THEN CASE WHEN s > 180 THEN s - 360 ELSE s END ELSE m END, 6) AS lon_tri, round(lat, 6) AS lat_tri FROM (
  SELECT elem_id, (a.lon + b.lon + c.lon) / 3.0 AS m, (a.lat + b.lat + c.lat) / 3.0 AS lat,
  greatest(abs(a.lon - (a.lon + b.lon + c.lon) / 3.0), abs(b.lon - (a.lon + b.lon + c.lon) / 3.0), abs(c.lon - (a.lon + b.lon + c.lon) / 3.0)) > 100 AS far,
  (a.lon + CASE WHEN a.lon < 0 THEN 360 ELSE 0 END + b.lon + CASE WHEN b.lon < 0 THEN 360 ELSE 0 END + c.lon + CASE WHEN c.lon < 0 THEN 360 ELSE 0 END) / 3.0 AS s FROM {_CORNERS})""")
def element_centers(spark, d):
    e = topology.element_centers(derive.elements(spark, d), derive.points(spark, d))
    return _rounded(e.select("elem_id", "lon_tri", "lat_tri"))


@register(f"SELECT elem_id, round({_TRIANGLE} / 1e6, 3) AS area FROM {_CORNERS}")
def triangle_areas(spark, d):
    return _rounded(topology.triangle_areas(derive.elements(spark, d), derive.points(spark, d)), 3, area=1e6)


@register(f"""SELECT p.point_id, round(coalesce(sum(t.area), 0) / 1e6, 3) AS area FROM points p LEFT JOIN (
  SELECT DISTINCT elem_id, unnest([n0, n1, n2]) AS point_id, {_TRIANGLE} / 3.0 AS area FROM {_CORNERS}) t USING (point_id) GROUP BY p.point_id""")
def cluster_area(spark, d):
    return _rounded(topology.cluster_area(derive.elements(spark, d), derive.points(spark, d)).select("point_id", "area"), 3, area=1e6)


def _node_sql(method: str, expr: str) -> None:
    sql = f"SELECT elem_id, round({expr}, 6) AS value FROM elements LEFT JOIN surface a ON a.point_id = n0 LEFT JOIN surface b ON b.point_id = n1 LEFT JOIN surface c ON c.point_id = n2"

    def run(spark, d):
        return _rounded(topology.node_to_element(derive.surface(spark, d), derive.elements(spark, d), method=method))

    run.__name__ = f"node_to_element_{method}"
    register(sql)(run)


_ALL = "a.value + b.value + c.value"
_node_sql("mean", f"({_ALL}) / 3.0")
_node_sql("median", f"{_ALL} - least(a.value, b.value, c.value) - greatest(a.value, b.value, c.value)")
_node_sql("min", f"CASE WHEN {_ALL} IS NOT NULL THEN least(a.value, b.value, c.value) END")
_node_sql("max", f"CASE WHEN {_ALL} IS NOT NULL THEN greatest(a.value, b.value, c.value) END")

_ELEMENT_FIELD = "(SELECT elem_id, CASE WHEN elem_id % 23 <> 0 THEN CAST(elem_id % 11 AS DOUBLE) END AS v, unnest([n0, n1, n2]) AS point_id FROM elements)"


def _element_field(spark, d):
    return derive.elements(spark, d).select("elem_id", F.when(F.col("elem_id") % 23 != 0, (F.col("elem_id") % 11).cast("double")).alias("value"))


@register(f"SELECT p.point_id, round(CASE WHEN count(elem_id) = 0 THEN 0.0 WHEN count(v) = count(elem_id) THEN avg(v) END, 6) AS value FROM points p LEFT JOIN {_ELEMENT_FIELD} USING (point_id) GROUP BY p.point_id")
def element_to_node_mean(spark, d):
    return _rounded(topology.element_to_node(_element_field(spark, d), derive.elements(spark, d), derive.points(spark, d)))


@register(f"SELECT p.point_id, round(CASE WHEN count(elem_id) = 0 THEN 0.0 WHEN count(v) = count(elem_id) THEN sum(v) END, 6) AS value FROM points p LEFT JOIN {_ELEMENT_FIELD} USING (point_id) GROUP BY p.point_id")
def element_to_node_sum(spark, d):
    return _rounded(topology.element_to_node(_element_field(spark, d), derive.elements(spark, d), derive.points(spark, d), method="sum"))


@register("SELECT level, point_id, CASE WHEN point_id % 7 <> level THEN value END AS value FROM profile")
def mask_by_depth(spark, d):
    return topology.mask_by_depth(derive.profile(spark, d), _area3d(spark, d)).select("level", "point_id", "value")


@register("SELECT point_id, level, depth, round(lon, 6) AS lon, round(lat, 6) AS lat, value FROM profile JOIN points USING (point_id) JOIN levels USING (level)")
def open_dataset_query(spark, d):
    mesh = Mesh(derive.points(spark, d), levels=derive.levels(spark))
    return open_dataset(derive.profile(spark, d), mesh).select("point_id", "level", "depth", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "value")


@register("""SELECT n || told AS message FROM (
  SELECT count(*) AS n, ' points have a non-positive area' AS told FROM points WHERE area - 1e6 <= 0
  UNION ALL SELECT count(*), ' triangles have a vertex beyond the ' || (SELECT n FROM size) || ' points' FROM elements WHERE greatest(n0, n1, n2) + 5 >= (SELECT n FROM size)) WHERE n > 0""")
def validate_mesh_query(spark, d):
    bad = derive.points(spark, d).withColumn("area", F.col("area") - 1e6)
    shifted = derive.elements(spark, d).select("elem_id", "n0", "n1", (F.greatest("n0", "n1", "n2") + 5).alias("n2"))
    return spark.createDataFrame([(m,) for m in validate_mesh(Mesh(bad, elements=shifted))], "message string")


_RING = """SELECT range AS point_id, CASE WHEN range < 24 THEN 1 - pow(floor((1 + sqrt(1.0 + 2 * range)) / 2), 2) / 48
  WHEN range < 168 THEN (8 - (floor((range - 24) / 16) + 4)) / 6.0 ELSE pow(floor((1 + sqrt(1.0 + 2 * (191 - range))) / 2), 2) / 48 - 1 END AS z FROM range(192)"""


@register(f"SELECT point_id, round(degrees(asin(z)), 6) AS lat, round(4 * pi() * {R} * {R} / 192 / 1e6, 3) AS area FROM ({_RING})", shared=False)
def healpix_ring(spark, d):
    return _rounded(healpix.healpix_mesh(spark, 192, nest=False).points.select("point_id", "lat", "area"), area=1e6).withColumn("area", F.round("area", 3))


@register(f"SELECT round(degrees(asin(z)), 6) AS lat, count(*) AS n FROM ({_RING}) GROUP BY 1", shared=False)
def healpix_nested_rings(spark, d):
    return healpix.healpix_mesh(spark, 192).points.groupBy(F.round("lat", 6).alias("lat")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT j, i, lon, lat FROM (SELECT range AS j, range * 1e1 - 85 AS lat FROM range(18)), (SELECT range AS i, range * 1e1 - 175 AS lon FROM range(36))", shared=False)
def meshgrid(spark, d):
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return shaping.meshgrid(spark.range(36).select(F.col("id").alias("i"), (F.col("id") * 10.0 - 175).alias("lon")), spark.range(18).select(F.col("id").alias("j"), (F.col("id") * 10.0 - 85).alias("lat")))


@register("SELECT point_id, round(sqrt(greatest(v, 0)), 6) AS root, round(pow(greatest(v, 0), 0.4), 6) AS power, round(CASE WHEN abs(v) <= 10 THEN v ELSE sign(v) * 10 * (1 + log10(abs(v) / 10)) END, 6) AS symlog FROM (SELECT point_id, point_id - 100.0 AS v FROM points)")
def axis_scales(spark, d):
    v = F.col("point_id") - 100.0
    return _rounded(derive.points(spark, d).select("point_id", sections.y_scale(v, "sqrt").alias("root"), sections.y_scale(v, "power").alias("power"), sections.y_scale(v, "symlog").alias("symlog")))


@register("""SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, round(sum(value * area) / sum(CASE WHEN value IS NOT NULL THEN area END), 6) AS mean,
  round(coalesce(sum(CASE WHEN value >= 0.15 THEN area END), 0) / 1e6, 6) AS extent, count(value) AS n FROM (SELECT ts, user_id % n AS point_id, value FROM events, size) JOIN points USING (point_id) GROUP BY 1""")
def windowed_events(spark, d):
    n = derive._size(spark, d)
    rows = spark.read.parquet(f"{d}/events.parquet").crossJoin(n).select("ts", (F.col("user_id") % F.col("n")).alias("point_id"), "value")
    return _rounded(windowed_reduction(rows, derive.points(spark, d), window="1 day").select("window_start", "mean", "extent", "n"), extent=1e6)


# Sources: files are written from the derived tables to the shared folder, then read.


def _text(df: DataFrame, path: str, head: str | None = None) -> None:
    """Lines of ``df(at, line)`` in order, in one file, below a first line with their number."""
    rows = df.select(F.col("at").cast("long").alias("at"), "line")
    first = rows.agg(F.lit(-1).cast("long").alias("at"), F.count(F.lit(1)).cast("string").alias("line"))
    rows.unionByName(first).repartition(1).sortWithinPartitions("at").select("line").write.text(path)


def _text_mesh(spark, d) -> str:
    folder, p, e = files.scratch(spark, "mesh"), derive.points(spark, d), derive.elements(spark, d)
    _text(p.select(F.col("point_id").alias("at"), F.concat_ws(" ", F.col("point_id") + 1, "lon", "lat", F.lit(0)).alias("line")), f"{folder}/nod2d.out")
    _text(e.select(F.col("elem_id").alias("at"), F.concat_ws("  ", F.col("n0") + 1, F.col("n1") + 1, F.col("n2") + 1).alias("line")), f"{folder}/elem2d.out")
    _text(derive.levels(spark).select(F.col("level").alias("at"), F.concat(F.lit("-"), F.col("depth")).alias("line")), f"{folder}/aux3d.out")
    return folder


_CLUSTER = f"""SELECT p.point_id, round(p.lon, 6) AS lon, round(p.lat, 6) AS lat, round(coalesce(sum(t.area), 0) / 1e6, 3) AS area FROM points p LEFT JOIN (
  SELECT DISTINCT elem_id, unnest([n0, n1, n2]) AS point_id, {_TRIANGLE} / 3.0 AS area FROM {_CORNERS}) t USING (point_id) GROUP BY ALL"""


def _mesh_points(mesh: Mesh) -> DataFrame:
    p = mesh.points
    return p.select("point_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round(F.col("area") / 1e6, 3).alias("area"))


@register(f"SELECT p.point_id, lon, lat, area, 'fesom' AS kind FROM ({_CLUSTER}) p")
def text_mesh(spark, d):
    path = _text_mesh(spark, d)
    mesh = load.load_mesh(spark, path)  # the kind is found from the files
    assert load.detect_mesh_type(spark, path) == mesh.kind
    return _mesh_points(mesh).withColumn("kind", F.lit(mesh.kind))


@register("SELECT level, (depth + below) / 2 AS depth, below - depth AS thickness FROM (SELECT level, depth, lead(depth) OVER (ORDER BY level) AS below FROM levels) WHERE below IS NOT NULL")
def text_mesh_levels(spark, d):
    return load.load_text_mesh(spark, _text_mesh(spark, d)).levels.select("level", "depth", "thickness")


def _netcdf(spark, name: str, *what) -> str:
    path = f"{files.scratch(spark, 'netcdf')}/{name}"
    netcdf.write(spark, path, *what)
    return path


def _by_point(table: DataFrame, *columns: str) -> list:
    """Columns as variables of a netCDF file, in order of ``point_id``."""
    return [netcdf.Rows(table, ("point_id",), c) for c in columns]


@register("SELECT point_id, round(lon, 6) AS lon, round(lat, 6) AS lat, round(area / 1e6, 3) AS area, (SELECT count(*) FROM elements) AS n_elements, (SELECT CAST(sum(n0 + n1 + n2) AS BIGINT) FROM elements) AS corners, 6 AS n_levels FROM points")
def netcdf_mesh(spark, d):
    import numpy as np

    p, e = derive.points(spark, d), derive.elements(spark, d)
    lon, lat, area = _by_point(p, "lon", "lat", "area")
    corners = e.select("elem_id", F.posexplode(F.array(*(F.col(c) + 1 for c in ("n0", "n1", "n2")))).alias("corner", "node")).withColumn("node", F.col("node").cast("int"))
    depth = np.array([-x[1] for x in derive.LEVELS])
    path = _netcdf(spark, "fesom.mesh.diag.nc", {"nod2": p.count(), "elem": e.count(), "n3": 3, "nz": len(depth)}, {"lon": (("nod2",), lon, {}), "lat": (("nod2",), lat, {}), "nod_area": (("nod2",), area, {}), "face_nodes": (("n3", "elem"), netcdf.Rows(corners, ("corner", "elem_id"), "node"), {"start_index": 1.0}), "nz": (("nz",), depth, {"units": "m"})})
    mesh = load.load_mesh(spark, path)
    totals = mesh.elements.agg(F.count(F.lit(1)).alias("n_elements"), F.sum(F.col("n0") + F.col("n1") + F.col("n2")).alias("corners"))
    return _mesh_points(mesh).crossJoin(F.broadcast(totals)).withColumn("n_levels", F.lit(mesh.levels.count()).cast("int"))


@register("SELECT level, point_id, CASE WHEN point_id % 7 <> level THEN area END AS area FROM points, levels")
def netcdf_area_by_level(spark, d):
    p = derive.points(spark, d)
    lon, lat = _by_point(p, "lon", "lat")
    wet = p.crossJoin(F.broadcast(derive.levels(spark))).select("level", "point_id", F.when(F.col("point_id") % 7 != F.col("level"), F.col("area")).otherwise(0.0).alias("area"))
    path = _netcdf(spark, "mesh.diag.nc", {"nod2": p.count(), "nl": len(derive.LEVELS)}, {"lon": (("nod2",), lon, {}), "lat": (("nod2",), lat, {}), "nod_area": (("nl", "nod2"), netcdf.Rows(wet, ("level", "point_id"), "area"), {})})
    return load.load_mesh(spark, path).area3d.select("level", "point_id", "area")


@register(ORACLES["structured_mesh"], shared=False)
def structured_netcdf(spark, d):
    table = _structured(spark).orderBy("j", "i").toArrow()  # of a fixed size
    g = {c: table[c].to_numpy() for c in table.column_names}
    dims = ("time", "y", "x")
    shape = (1, 21, 36)
    path = _netcdf(spark, "mesh_mask.nc", {"time": 1, "z": 2, "y": 21, "x": 36}, {"glamt": (dims, g["lon"].reshape(shape), {}), "gphit": (dims, g["lat"].astype("f8").reshape(shape), {}), "tmask": (("time", "z", "y", "x"), [[g["tmask"].reshape(21, 36), 0 * g["tmask"].reshape(21, 36)]], {})})
    p = load.load_mesh(spark, path).points
    return p.select("point_id", "flat_idx", F.round("lon", 6).alias("lon"), "lat", F.round(F.col("area") / 1e6, 4).alias("area"))


@register("SELECT point_id, round(lon, 6) AS lon, round(lat, 6) AS lat, area, 'A2' AS prefix FROM points")
def reduced_netcdf(spark, d):
    p = derive.points(spark, d)
    n, first = p.count(), p.orderBy("point_id").limit(2).toArrow()
    lon, lat, area, double = _by_point(p.select("point_id", F.col("lon") + 360, "lat", "area", F.col("area") * 2).toDF("point_id", "lon", "lat", "area", "double"), "lon", "lat", "area", "double")
    grid = {f"A1.{k}": (("y1", "x1"), first[k].to_numpy()[None], {}) for k in ("lon", "lat")} | {f"{a}.{k}": (("y", "x"), v, {}) for a in ("A3", "A2") for k, v in (("lon", lon), ("lat", lat))}
    grids_nc = _netcdf(spark, "grids.nc", {"y": 1, "x": n, "y1": 1, "x1": 2}, grid)
    areas_nc = _netcdf(spark, "areas.nc", {"y": 1, "x": n}, {"A2.srf": (("y", "x"), area, {}), "A3.srf": (("y", "x"), double, {})})
    mesh = load.load_mesh(spark, grids_nc, "ifs_tco", area_file=areas_nc)
    return _rounded(mesh.points.select("point_id", "lon", "lat", "area")).withColumn("prefix", F.lit(mesh.extra["prefix"]))


@register("""SELECT CAST(time AS BIGINT) AS time, level, round(sum(value * area) / sum(CASE WHEN value IS NOT NULL THEN area END), 6) AS mean FROM (SELECT t.range AS time, level, point_id, CASE WHEN value IS NOT NULL THEN value + t.range END AS value FROM profile, range(6) t) JOIN points USING (point_id) GROUP BY ALL""")
def series_of_files(spark, d):
    profile, folder = derive.profile(spark, d), files.scratch(spark, "series")
    dims = {"time": 2, "nz": len(derive.LEVELS), "nod2": derive.points(spark, d).count()}
    for part in range(3):  # two times in each file, missing values by their mark
        field = profile.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("t"), "level", "point_id", "value").withColumn("value", F.col("value") + 2 * part + F.col("t"))
        netcdf.write(spark, f"{folder}/temp_{part}.nc", dims, {"temp": (("time", "nz", "nod2"), netcdf.Rows(field, ("t", "level", "point_id"), "value"), {"_FillValue": -9e33})})
    series = netcdf.open_series(spark, f"{folder}/temp_*.nc", "temp")
    return _rounded(reduce.surface_mean(series, derive.points(spark, d), ["time", "level"]))


@register(f""", {_grid_sql(15.0)} SELECT time, CAST(i_lat AS BIGINT) AS i_lat, CAST(i_lon AS BIGINT) AS i_lon, value FROM (SELECT DISTINCT CAST(time AS VARCHAR) AS time, time AS t FROM ice) CROSS JOIN grid
  LEFT JOIN {_nearest(600_000.0)} USING (cell_id) LEFT JOIN (SELECT time AS t, point_id, concentration AS value FROM ice) USING (t, point_id)""")
def export_netcdf(spark, d):
    made = regrid.build(derive.points(spark, d), 15.0, influence_radius=600_000.0)
    paths = netcdf.export_grid(made(derive.ice(spark, d), ["time"], "concentration"), files.scratch(spark, "export"), ["time"], name="ice")
    back = netcdf.read_variables(spark, f"{paths[0].rsplit('/', 1)[0]}/ice_*.nc", ["ice"])
    time = F.get(F.array(*(F.lit(netcdf.read_header(spark, p).attributes["time"]) for p in paths)), F.col("file").cast("int"))
    return back.select(time.alias("time"), F.col("lat").alias("i_lat"), F.col("lon").alias("i_lon"), F.col("ice").alias("value"))


# Helpers that answer on the driver, and checks.


@register("SELECT point_id, round(a - 360 * floor((a + 180) / 360), 6) AS wrapped, round(lon, 6) AS kept FROM (SELECT point_id, lon, lon + 360 AS a FROM points)")
def ensure_longitudes(spark, d):
    p = derive.points(spark, d)
    wrapped = coords.ensure_lon_pm180(p.withColumn("lon", F.col("lon") + 360)).select("point_id", F.round("lon", 6).alias("wrapped"))
    return wrapped.join(coords.ensure_lon_pm180(p).select("point_id", F.round("lon", 6).alias("kept")), "point_id")


_NAMED = [(["time", "Longitude", "lat"], "Longitude", "lat"), (["x", "lon", "y"], "lon", "y"), (["nav_lat", "nav_lon"], "nav_lon", "nav_lat"), (["a", "b"], None, None)]


@register("SELECT * FROM (VALUES (0, 'Longitude', 'lat'), (1, 'lon', 'y'), (2, 'nav_lon', 'nav_lat'), (3, NULL, NULL)) v(i, lon, lat)", shared=False)
def coordinate_names(spark, d):
    return spark.createDataFrame([(i, *find_coordinates(columns)) for i, (columns, *_) in enumerate(_NAMED)], "i int, lon string, lat string")


@register("SELECT j, i, j * 10e0 - 40 AS lat, i * 20e0 - 90 AS lon, CAST(j * 10 + i AS DOUBLE) AS value FROM (SELECT range AS j FROM range(9)), (SELECT range AS i FROM range(10))", shared=False)
def prepared_input(spark, d):
    import warnings

    cells = spark.range(90).select(F.floor(F.col("id") / 10).alias("j"), (F.col("id") % 10).alias("i"), F.col("id").cast("double").alias("value"))
    lon, lat = (spark.range(n).select(F.col("id").alias(k), (F.col("id") * step + first).alias(name)) for n, k, step, first, name in ((10, "i", 20.0, -90.0, "lon"), (9, "j", 10.0, -40.0, "lat")))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return shaping.prepare_input(cells, lon, lat)


@register("""SELECT * FROM (VALUES ('PC', 'PlateCarree', false, NULL, -90e0, 90e0), ('robinson', 'Robinson', true, NULL, -90e0, 90e0), ('Moll', 'Mollweide', true, NULL, -90e0, 90e0), ('merc', 'Mercator', false, NULL, -90e0, 90e0),
  ('npstere', 'NorthPolarStereo', false, 'north', 0e0, 90e0), ('SP', 'SouthPolarStereo', false, 'south', -90e0, 0e0), ('ortho', 'Orthographic', false, NULL, -90e0, 90e0), ('lcc', 'LambertConformal', false, NULL, -90e0, 90e0)) v(alias, name, is_global, polar, south, north)""", shared=False)
def projection_facts(spark, d):
    names = ("PC", "robinson", "Moll", "merc", "npstere", "SP", "ortho", "lcc")
    rows = [(n, projections.projection_name(n), projections.is_global(n), projections.polar_side(n), *projections.data_bounds(n)[1]) for n in names]
    return spark.createDataFrame(rows, "alias string, name string, is_global boolean, polar string, south double, north double")


@register("""SELECT i, round(greatest(-180.0, (w + e) / 2 - (e - w) / 2 * 1.414), 6) AS west, round(least(180.0, (w + e) / 2 + (e - w) / 2 * 1.414), 6) AS east, round(greatest(-90.0, (s + n) / 2 - (n - s) / 2 * 1.414), 6) AS south, round(least(90.0, (s + n) / 2 + (n - s) / 2 * 1.414), 6) AS north
  FROM (VALUES (0, -30e0, 40e0, 60e0, 80e0), (1, -180e0, 180e0, -90e0, -50e0)) v(i, w, e, s, n)""", shared=False)
def polar_bounds(spark, d):
    boxes = [((-30.0, 40.0), (60.0, 80.0)), ((-180.0, 180.0), (-90.0, -50.0))]
    rows = [(i, *grids.expand_bounds_for_polar(*box)[0], *grids.expand_bounds_for_polar(*box)[1]) for i, box in enumerate(boxes)]
    return _rounded(spark.createDataFrame(rows, "i int, west double, east double, south double, north double"))


@register("SELECT * FROM (VALUES ('Nino 3.4', 1), ('Nino 3', 1), ('Nino 4', 2)) v(name, polygons)", shared=False)
def region_names(spark, d):
    features = {f["properties"]["name"]: f for f in spatial.load_geojson("NinoRegions")["features"]}
    rows = [(n, len(features[n]["geometry"]["coordinates"])) for n in spatial.list_available_regions()]
    return spark.createDataFrame(rows, "name string, polygons int")


@register("SELECT CAST(1 << range AS INTEGER) AS nside, CAST(12 * (1 << range) * (1 << range) AS BIGINT) AS npoints, CAST(1 << range AS INTEGER) AS back, range = 6 AS of_one_degree FROM range(10)", shared=False)
def healpix_sides(spark, d):
    rows = [(n, healpix.nside_to_npoints(n), healpix.npoints_to_nside(healpix.nside_to_npoints(n)), healpix.resolution_to_nside(1.0) == n) for n in (1 << i for i in range(10))]
    return spark.createDataFrame(rows, "nside int, npoints long, back int, of_one_degree boolean")


@register(f"""WITH p AS (SELECT range AS point_id, range // 16 AS face, range % 16 AS q FROM range(192)),
  xy AS (SELECT point_id, face, ((q & 1) + ((q >> 2) & 1) * 2 + 0.5) / 4 AS x, (((q >> 1) & 1) + ((q >> 3) & 1) * 2 + 0.5) / 4 AS y FROM p),
  spot AS (SELECT point_id, [2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4][face + 1] - x - y AS ring, [1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7][face + 1] AS middle, x - y AS aside FROM xy),
  sphere AS (SELECT *, CASE WHEN ring < 1 THEN ring WHEN ring > 3 THEN 4 - ring ELSE 1 END AS narrow FROM spot),
  place AS (SELECT point_id, CASE WHEN ring < 1 THEN 1 - narrow * narrow / 3 WHEN ring > 3 THEN narrow * narrow / 3 - 1 ELSE (2 - ring) * 2 / 3 END AS z, (middle * narrow + aside) / narrow * 45 AS phi FROM sphere)
  SELECT point_id, round(phi - 360 * floor((phi + 180) / 360), 6) AS lon, round(degrees(asin(z)), 6) AS lat FROM place""", shared=False)
def healpix_nested(spark, d):
    return _rounded(healpix.healpix_mesh(spark, 192).points.select("point_id", "lon", "lat"))


@register("""SELECT p.point_id, t.depth, round(a.value + (b.value - a.value) * (t.depth - t.d0) / (t.d1 - t.d0), 6) AS value FROM points p,
  (SELECT * FROM (VALUES (175e-1, 1, 2, 10.0, 25.0), (60.0, 2, 3, 25.0, 60.0), (300.0, 4, 5, 150.0, 400.0)) v(depth, lo, hi, d0, d1)) t
  JOIN profile a ON a.point_id = p.point_id AND a.level = t.lo JOIN profile b ON b.point_id = p.point_id AND b.level = t.hi""")
def interpolate_upward_axis(spark, d):
    """The same field with its levels numbered from the bottom."""
    field = derive.profile(spark, d).withColumn("level", F.lit(6) - F.col("level"))
    levels = derive.levels(spark).withColumn("level", F.lit(6) - F.col("level"))
    return _rounded(vertical.interpolate_to_depth(field, levels, [17.5, 60.0, 300.0]))


@register("SELECT 'lonlat' AS kind, 'made' AS source, '1' AS version, true AS is_mesh, false AS table_is_mesh, 18 AS n FROM size")
def mesh_metadata(spark, d):
    mesh = with_metadata(lonlat_mesh(spark, 60.0), "lonlat", source="made")
    return spark.createDataFrame([(mesh_kind(mesh), mesh.source, mesh.version, is_mesh(mesh), is_mesh(mesh.points), mesh.points.count())], "kind string, source string, version string, is_mesh boolean, table_is_mesh boolean, n int")


_WITH_BOTTOM = "(SELECT level, point_id, CASE WHEN point_id % 7 <> level THEN area END AS area FROM points, levels)"


def _bottomed(spark, d):
    """Areas by level with one level more than the depth axis has."""
    extra = derive.points(spark, d).select(F.lit(len(derive.LEVELS)).alias("level"), "point_id", "area")
    return _area3d(spark, d).unionByName(extra)


@register(f"SELECT time, round(sum(value * thickness * area) / sum(CASE WHEN value IS NOT NULL THEN thickness * area END), 6) AS mean FROM field3d JOIN levels USING (level) JOIN {_WITH_BOTTOM} a USING (level, point_id) GROUP BY time")
def volume_mean_extra_level(spark, d):
    import warnings

    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        mean = reduce.volume_mean(derive.field3d(spark, d), derive.points(spark, d), derive.levels(spark), ["time"], area3d=_bottomed(spark, d))
    assert any("one more vertical level" in str(w.message) for w in said)
    return _rounded(mean)


@register(f"""SELECT t.time, l.depth AS y, round(sum(value * area) / sum(CASE WHEN value IS NOT NULL THEN area END), 6) AS value
  FROM (SELECT DISTINCT time FROM field3d) t CROSS JOIN levels l LEFT JOIN field3d f ON f.time = t.time AND f.level = l.level
  LEFT JOIN {_WITH_BOTTOM} a ON a.point_id = f.point_id AND a.level = f.level GROUP BY t.time, l.depth""")
def hovmoller_area3d(spark, d):
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return _rounded(reduce.hovmoller(derive.field3d(spark, d), derive.points(spark, d), derive.levels(spark), area3d=_bottomed(spark, d)))
