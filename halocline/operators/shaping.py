"""Bringing data and coordinates into long form."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def meshgrid(lon_axis: DataFrame, lat_axis: DataFrame) -> DataFrame:
    """``lon_axis(i, lon)`` and ``lat_axis(j, lat)`` -> ``(j, i, lon, lat)``, every pair. The axes of
    a regular grid are its small side, so one is broadcast."""
    warnings.warn("Creating meshgrid from 1D lon/lat axes", UserWarning, stacklevel=2)
    return lat_axis.select("j", "lat").crossJoin(F.broadcast(lon_axis.select("i", "lon"))).select("j", "i", "lon", "lat")


def prepare_coordinates(lon: DataFrame, lat: DataFrame) -> DataFrame:
    """Coordinates in long form from tables of 1-D axes ``(point_id, ...)`` of equal size, 2-D
    tables ``(j, i, ...)``, or two axes ``(i, lon)`` and ``(j, lat)`` of a regular grid."""
    two = [{"i", "j"} <= set(df.columns) for df in (lon, lat)]
    if all(two):
        warnings.warn("Raveling 2D lon/lat arrays", UserWarning, stacklevel=2)
        return lon.join(lat, ["j", "i"]).select("j", "i", "lon", "lat")
    if any(two):
        raise ValueError("lon and lat must both be 1D or both be 2D")
    if "point_id" in lon.columns and "point_id" in lat.columns:
        return lon.join(lat, "point_id").select("point_id", "lon", "lat")
    return meshgrid(lon, lat)


def prepare_input(data: DataFrame, lon: DataFrame, lat: DataFrame, value: str = "value") -> DataFrame:
    """``(..., lon, lat, value)``: data by point with coordinates by point, data ``(j, i)`` with
    coordinates ``(j, i)``, or data ``(j, i)`` with two axes."""
    keys_data = {"j", "i"} if {"j", "i"} <= set(data.columns) else {"point_id"} & set(data.columns)
    if keys_data == {"point_id"} and "point_id" in lon.columns and "point_id" in lat.columns:
        return data.join(lon.join(lat, "point_id"), "point_id").select("point_id", "lon", "lat", value)
    if keys_data == {"j", "i"}:
        if {"i", "j"} <= set(lon.columns) and {"i", "j"} <= set(lat.columns):
            warnings.warn("Raveling 2D arrays", UserWarning, stacklevel=2)
            return data.join(lon.join(lat, ["j", "i"]), ["j", "i"]).select("j", "i", "lon", "lat", value)
        if "i" in lon.columns and "j" in lat.columns:
            warnings.warn("Creating meshgrid from 1D lon/lat axes", UserWarning, stacklevel=2)
            return data.join(F.broadcast(lon), "i").join(F.broadcast(lat), "j").select("j", "i", "lon", "lat", value)
    raise ValueError(f"Incompatible shapes: data {data.columns}, lon {lon.columns}, lat {lat.columns}")
