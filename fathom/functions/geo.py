"""Geometry on the sphere and in the plane, as columns of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_NM = 1.852


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance. Longitudes may lie on either side of the antimeridian; rounding never leaves asin's domain; null if any part is."""
    p, q = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.when(a > 1, 1.0).otherwise(F.sqrt(a)))


def wrapped(degrees: Column) -> Column:
    """An angle's equal in (-180, 180]."""
    x = F.pmod(degrees, F.lit(360.0))
    return F.when(x > 180, x - 360).otherwise(x)


def unit_sphere(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    p, q = F.radians(lat), F.radians(lon)
    return F.cos(p) * F.cos(q), F.cos(p) * F.sin(q), F.sin(p)


def crossing(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column, parallel: float = 1e-12) -> tuple[Column, Column]:
    """x, y where the segments AB and CD meet, both ends included; null where they don't, or are parallel."""
    det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / F.nullif(det, F.lit(0.0))
    u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / F.nullif(det, F.lit(0.0))
    meets = (F.abs(det) >= parallel) & t.between(0, 1) & u.between(0, 1)
    return F.when(meets, ax + t * (bx - ax)), F.when(meets, ay + t * (by - ay))
