"""HEALPix pixel centres in closed form, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import EARTH_RADIUS
from ..functions.coords import normalize_lon
from .mesh import Mesh


def nside_to_npoints(nside: int) -> int:
    return 12 * nside * nside


def npoints_to_nside(npoints: int) -> int:
    nside = math.isqrt(npoints // 12)
    if npoints <= 0 or 12 * nside * nside != npoints:
        raise ValueError(f"Invalid HEALPix npoints: {npoints}")
    return nside


def resolution_to_nside(degrees: float) -> int:
    """Smallest power of two whose pixel size is at most the resolution."""
    nside = 1
    while math.degrees(math.sqrt(4 * math.pi / nside_to_npoints(nside))) > degrees:
        nside *= 2
    return nside


def _ring(pix: Column, nside: int) -> tuple[Column, Column]:
    """(z, azimuth in radians) of RING pixels: polar caps of rings with 4 i pixels, a belt of
    rings with 4 nside, alternate ones shifted by half a pixel."""
    ncap, npix = 2 * nside * (nside - 1), nside_to_npoints(nside)
    root = lambda x: F.floor((1 + F.sqrt(1.0 + 2.0 * x)) / 2)
    north = root(pix)
    north_at = pix + 1 - 2 * north * (north - 1)
    south_pix = F.lit(npix) - 1 - pix
    south = root(south_pix)
    south_at = 4 * south + 1 - (south_pix + 1 - 2 * south * (south - 1))
    belt = pix - ncap
    ring = F.floor(belt / (4 * nside)) + nside
    belt_at = belt % (4 * nside) + 1
    shift = (1 + (ring + nside) % 2) / 2.0
    cap_z = lambda i: 1 - (i * i) / (3.0 * nside * nside)
    cap_phi = lambda i, j: (j - 0.5) * (math.pi / 2) / i
    z = F.when(pix < ncap, cap_z(north)).when(pix < npix - ncap, (2 * nside - ring) * (2.0 / (3 * nside))).otherwise(-cap_z(south))
    phi = F.when(pix < ncap, cap_phi(north, north_at)).when(pix < npix - ncap, (belt_at - shift) * (math.pi / 2) / nside).otherwise(cap_phi(south, south_at))
    return z, phi


def _nested(pix: Column, nside: int) -> tuple[Column, Column]:
    """(z, azimuth) of NESTED pixels: a base pixel and two coordinates with interleaved bits."""
    face = F.floor(pix / (nside * nside)).cast("int")
    inside = pix % (nside * nside)
    bits = max(1, nside.bit_length() - 1)
    pick = lambda first: sum((F.shiftleft(F.shiftright(inside, 2 * b + first).bitwiseAND(F.lit(1)), b) for b in range(bits)), F.lit(0))
    x, y = pick(0), pick(1)
    row = F.get(F.array(*(F.lit(v) for v in (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4))), face)
    column = F.get(F.array(*(F.lit(v) for v in (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7))), face)
    ring = row * nside - x - y - 1
    count = F.when(ring < nside, ring).when(ring > 3 * nside, 4 * nside - ring).otherwise(F.lit(nside))
    z = F.when(ring < nside, 1 - count * count / (3.0 * nside * nside)).when(ring > 3 * nside, count * count / (3.0 * nside * nside) - 1).otherwise((2 * nside - ring) * (2.0 / (3 * nside)))
    shift = F.when((ring < nside) | (ring > 3 * nside), 0).otherwise((ring - nside) % 2)
    at = F.floor((column * count + x - y + 1 + shift) / 2)
    at = F.when(at > 4 * nside, at - 4 * nside).when(at < 1, at + 4 * nside).otherwise(at)
    return z, (at - (shift + 1) * 0.5) * (math.pi / 2) / count


def healpix_mesh(spark: SparkSession, npoints: int, nest: bool = True) -> Mesh:
    """All pixels with centre and equal area."""
    nside = npoints_to_nside(npoints)
    if nest and nside & (nside - 1):
        raise ValueError(f"NESTED order needs a power of two, got nside={nside}")
    z, phi = (_nested if nest else _ring)(F.col("id"), nside)
    points = spark.range(npoints).select(
        F.col("id").alias("point_id"),
        normalize_lon(F.degrees(phi)).alias("lon"),
        F.degrees(F.asin(z)).alias("lat"),
        F.lit(4 * math.pi * EARTH_RADIUS**2 / npoints).alias("area"),
    )
    return Mesh(points, "healpix", extra={"nside": nside, "ordering": "NESTED" if nest else "RING"})
