"""Positions on the WGS-84 ellipsoid and rotations, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The ellipsoid.
A = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)


def ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates in metres of degrees and metres."""
    la, lo = F.radians(lat), F.radians(lon)
    n = A / F.sqrt(1 - E2 * F.sin(la) * F.sin(la))
    return (n + alt) * F.cos(la) * F.cos(lo), (n + alt) * F.cos(la) * F.sin(lo), (n * (1 - E2) + alt) * F.sin(la)


def enu(lat: Column, lon: Column, alt: Column, lat0: Column, lon0: Column, alt0: Column) -> tuple[Column, Column, Column]:
    """East, north and up in metres of an origin."""
    (x, y, z), (x0, y0, z0) = ecef(lat, lon, alt), ecef(lat0, lon0, alt0)
    dx, dy, dz = x - x0, y - y0, z - z0
    la, lo = F.radians(lat0), F.radians(lon0)
    east = -F.sin(lo) * dx + F.cos(lo) * dy
    north = -F.sin(la) * F.cos(lo) * dx - F.sin(la) * F.sin(lo) * dy + F.cos(la) * dz
    up = F.cos(la) * F.cos(lo) * dx + F.cos(la) * F.sin(lo) * dy + F.sin(la) * dz
    return east, north, up


def from_enu(east: Column, north: Column, up: Column, lat0: Column, lon0: Column, alt0: Column) -> tuple[Column, Column, Column]:
    """Earth-centred coordinates of metres east, north and up of an origin."""
    x0, y0, z0 = ecef(lat0, lon0, alt0)
    la, lo = F.radians(lat0), F.radians(lon0)
    x = x0 - F.sin(lo) * east - F.sin(la) * F.cos(lo) * north + F.cos(la) * F.cos(lo) * up
    y = y0 + F.cos(lo) * east - F.sin(la) * F.sin(lo) * north + F.cos(la) * F.sin(lo) * up
    return x, y, z0 + F.cos(la) * north + F.sin(la) * up


def geodetic(df: DataFrame, x: str, y: str, z: str, rounds: int = 7) -> DataFrame:
    """``df`` with lat_at, lon_at (degrees) and alt_at of earth-centred coordinates, by fixed-point iteration."""
    p = F.hypot(F.col(x), F.col(y))
    d = df.withColumn("_p", p).withColumn("_la", F.atan2(F.col(z), F.col("_p") * (1 - E2)))
    for _ in range(rounds):
        n = A / F.sqrt(1 - E2 * F.sin("_la") * F.sin("_la"))
        h = F.col("_p") / F.cos("_la") - n
        d = d.withColumn("_la", F.atan2(F.col(z), F.col("_p") * (1 - E2 * n / (n + h))))
    n = A / F.sqrt(1 - E2 * F.sin("_la") * F.sin("_la"))
    d = d.withColumns({"alt_at": F.col("_p") / F.cos("_la") - n, "lat_at": F.degrees("_la"), "lon_at": F.degrees(F.atan2(F.col(y), F.col(x)))})
    return d.drop("_p", "_la")


def body_to_enu(x: Column, y: Column, z: Column, roll: Column, pitch: Column, yaw: Column) -> tuple[Column, Column, Column]:
    """A vector forward, right, down turned by roll, pitch and yaw (clockwise from north) into east, north, up."""
    sr, cr, sp, cp, sy, cy = F.sin(roll), F.cos(roll), F.sin(pitch), F.cos(pitch), F.sin(yaw), F.cos(yaw)
    north = cy * cp * x + (cy * sp * sr - sy * cr) * y + (cy * sp * cr + sy * sr) * z
    east = sy * cp * x + (sy * sp * sr + cy * cr) * y + (sy * sp * cr - cy * sr) * z
    down = -sp * x + cp * sr * y + cp * cr * z
    return east, north, -down


ENU_SQL = f"""
xyz AS (SELECT *, {A} / sqrt(1 - {E2} * sin(radians(lat)) ** 2) AS n1, {A} / sqrt(1 - {E2} * sin(radians(lat0)) ** 2) AS n2 FROM gps JOIN o USING (flight_id)),
dd AS (SELECT *, (n1 + alt) * cos(radians(lat)) * cos(radians(lon)) - (n2 + alt0) * cos(radians(lat0)) * cos(radians(lon0)) AS dx,
  (n1 + alt) * cos(radians(lat)) * sin(radians(lon)) - (n2 + alt0) * cos(radians(lat0)) * sin(radians(lon0)) AS dy,
  (n1 * (1 - {E2}) + alt) * sin(radians(lat)) - (n2 * (1 - {E2}) + alt0) * sin(radians(lat0)) AS dz FROM xyz),
enu AS (SELECT *, -sin(radians(lon0)) * dx + cos(radians(lon0)) * dy AS east,
  -sin(radians(lat0)) * cos(radians(lon0)) * dx - sin(radians(lat0)) * sin(radians(lon0)) * dy + cos(radians(lat0)) * dz AS north,
  cos(radians(lat0)) * cos(radians(lon0)) * dx + cos(radians(lat0)) * sin(radians(lon0)) * dy + sin(radians(lat0)) * dz AS up FROM dd)"""
