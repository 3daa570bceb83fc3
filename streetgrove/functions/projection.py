"""Transverse Mercator as column arithmetic (series of the WGS 84 ellipsoid)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEMI_MAJOR_M = 6378137.0  # fixed values
FLATTENING = 1 / 298.257223563


def transverse_mercator(lon: Column, lat: Column, *, lon0: float, lat0: float = 0.0, scale: float = 1.0, east: float = 0.0, north: float = 0.0) -> tuple[Column, Column]:
    """(x, y) in metres; good to millimetres within a few degrees of ``lon0``."""
    e2 = FLATTENING * (2 - FLATTENING)
    ep2 = e2 / (1 - e2)
    phi = F.radians(lat)
    n = SEMI_MAJOR_M / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    t = F.pow(F.tan(phi), 2)
    c = ep2 * F.pow(F.cos(phi), 2)
    a = F.cos(phi) * F.radians(lon - lon0)
    m = meridian(phi, e2) - meridian(F.radians(F.lit(lat0)), e2)
    x = n * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(a, 5) / 120)
    y = m + n * F.tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(a, 6) / 720)
    return scale * x + east, scale * y + north


def meridian(phi: Column, e2: float) -> Column:
    e4, e6 = e2 * e2, e2 * e2 * e2
    return SEMI_MAJOR_M * (
        (1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) * phi - (3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) * F.sin(2 * phi)
        + (15 * e4 / 256 + 45 * e6 / 1024) * F.sin(4 * phi) - (35 * e6 / 3072) * F.sin(6 * phi))
