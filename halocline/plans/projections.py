"""Map projection names and the data bounds a map in them needs."""

from __future__ import annotations

# Projection aliases.
ALIASES = {
    "pc": "PlateCarree",
    "platecarree": "PlateCarree",
    "rob": "Robinson",
    "robinson": "Robinson",
    "merc": "Mercator",
    "mercator": "Mercator",
    "moll": "Mollweide",
    "mollweide": "Mollweide",
    "np": "NorthPolarStereo",
    "npstere": "NorthPolarStereo",
    "northpolarstereo": "NorthPolarStereo",
    "sp": "SouthPolarStereo",
    "spstere": "SouthPolarStereo",
    "southpolarstereo": "SouthPolarStereo",
    "ortho": "Orthographic",
    "orthographic": "Orthographic",
    "lcc": "LambertConformal",
    "lambertconformal": "LambertConformal",
}


def projection_name(name: str) -> str:
    """Canonical projection of an alias, whatever its case."""
    if (found := ALIASES.get(name.lower())) is None:
        raise ValueError(f"Unknown projection: {name!r}. Available: {sorted(ALIASES)}")
    return found


def is_global(name: str) -> bool:
    return projection_name(name) in ("Robinson", "Mollweide")


def polar_side(name: str) -> str | None:
    return {"NorthPolarStereo": "north", "SouthPolarStereo": "south"}.get(projection_name(name))


def data_bounds(name: str, extent: tuple[float, float, float, float] | None = None):
    """(longitude bounds, latitude bounds): polar maps show all longitudes and their hemisphere, or
    20 degrees beyond the extent's edge; others the extent with a margin of 5 degrees."""
    side = polar_side(name)
    if side == "north":
        return (-180.0, 180.0), (max(0.0, extent[2] - 20.0) if extent else 0.0, 90.0)
    if side == "south":
        return (-180.0, 180.0), (-90.0, min(0.0, extent[3] + 20.0) if extent else 0.0)
    if extent is None:
        return (-180.0, 180.0), (-90.0, 90.0)
    west, east, south, north = extent
    return (max(-180.0, west - 5.0), min(180.0, east + 5.0)), (max(-90.0, south - 5.0), min(90.0, north + 5.0))
