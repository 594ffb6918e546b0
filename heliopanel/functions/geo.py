"""Great-circle distance and points on the unit sphere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliopanel.constants import EARTH_RADIUS_KM


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres between two points given in degrees."""
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    half_lat = F.sin((phi2 - phi1) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    a = half_lat * half_lat + F.cos(phi1) * F.cos(phi2) * half_lon * half_lon
    return F.when(a.isNotNull(), F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a))))


def unit_vector(df: DataFrame) -> DataFrame:
    """Adds x, y and z of (lat, lon) in degrees on the unit sphere."""
    phi, out = F.radians("lat"), F.radians("lon")
    return df.withColumns({"x": F.cos(phi) * F.cos(out), "y": F.cos(phi) * F.sin(out), "z": F.sin(phi)})
