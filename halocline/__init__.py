"""halocline: a PySpark-native analytics engine for unstructured ocean and atmosphere meshes."""

from .functions.coords import great_circle_distance, great_circle_path, haversine_distance, normalize_lon
from .operators.grids import expand_bounds_for_polar, grid_cell_area, regular_grid
from .operators.reduce import (
    heat_content,
    hovmoller,
    hovmoller_anomaly,
    ice_area,
    ice_area_nh,
    ice_area_sh,
    ice_extent,
    ice_extent_nh,
    ice_extent_sh,
    ice_summary,
    ice_volume,
    ice_volume_nh,
    ice_volume_sh,
    surface_mean,
    volume_mean,
)
from .operators.regrid import Interpolator, WeightsCache, clear_cache, get_cache, regrid, set_cache_options
from .operators.regrid import build as build_interpolator
from .operators.sections import map_table, transect
from .operators.spatial import find_nearest, get_region_mask, list_available_regions, load_geojson, points_in_polygon, subset_by_bbox
from .operators.topology import cluster_area, element_centers, element_to_node, mask_by_depth, node_to_element
from .operators.vertical import closest_depth, interpolate_to_depth
from .sources.healpix import healpix_mesh, npoints_to_nside, nside_to_npoints, resolution_to_nside
from .sources.load import detect_mesh_type, load_mesh
from .sources.mesh import Mesh, lonlat_mesh, mesh_from_df, open_dataset, validate_mesh

__version__ = "0.1.0"

__all__ = [name for name in dir() if not name.startswith("_")]
