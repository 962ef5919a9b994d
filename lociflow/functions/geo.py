"""Distances and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth, and the clamp of the haversine term.
EARTH_KM = 6371.0
CLAMP = 1e-7


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Great-circle distance; the clamp makes equal points 4.03 km apart, as in the metric that is matched."""
    half = lambda a, b: F.sin((F.radians(b) - F.radians(a)) / 2)
    raw = half(lat_a, lat_b) * half(lat_a, lat_b) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half(lon_a, lon_b) * half(lon_a, lon_b)
    a = F.least(F.greatest(raw, F.lit(CLAMP)), F.lit(1 - CLAMP))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(a))


def denormalize(z: Column, mean: Column, std: Column) -> Column:
    return z * std + mean
