"""Fixed physical and geometric values that results depend on."""

EARTH_RADIUS = 6_371_000.0  # m
RHO_SEAWATER = 1025.0  # kg / m3
CP_SEAWATER = 3990.0  # J / (kg K)
INFLUENCE_RADIUS = 80_000.0  # m
EXTENT_THRESHOLD = 0.15  # inclusive
LATITUDE_EDGES = [-90.0 + 5.0 * i for i in range(37)]
CYCLIC_DEGREES = 100.0
KM_PER_DEGREE = 111.0
POLAR_FACTOR = 1.414
CACHE_ITEMS = 10

# Names under which coordinates are looked for, in order of priority.
LON_NAMES = ["lon", "longitude", "x", "nav_lon", "glon", "xt_ocean", "xu_ocean", "xh", "xq", "nod2d_lon"]
LAT_NAMES = ["lat", "latitude", "y", "nav_lat", "glat", "yt_ocean", "yu_ocean", "yh", "yq", "nod2d_lat"]
