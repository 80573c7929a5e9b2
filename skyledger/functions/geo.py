"""Geodesy as column expressions. Angles are degrees, distances are named by their unit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS84 ellipsoid and unit sizes.
WGS84_A = 6378137.0
WGS84_B = 6356752.314245
NM_M = 1852.0
EARTH_M = 6371000.0
CENTRE_LAT, CENTRE_LON = 30.92095, 120.96985


def earth_radius(lat: Column) -> Column:
    """Metres from the earth's centre to the ellipsoid at a latitude."""
    c, s = F.cos(F.radians(lat)), F.sin(F.radians(lat))
    top = F.pow(WGS84_A * WGS84_A * c, 2) + F.pow(WGS84_B * WGS84_B * s, 2)
    return F.sqrt(top / (F.pow(WGS84_A * c, 2) + F.pow(WGS84_B * s, 2)))


def gravity(lat: Column) -> Column:
    """Acceleration of gravity in m/s2 at a latitude."""
    s2 = F.pow(F.sin(F.radians(lat)), 2)
    return 9.7803 * (1 + 0.001932 * s2) / F.sqrt(1 - 6.694e-3 * s2)


def pair_radius(lat1: Column, lat2: Column) -> Column:
    """The radius for a pair: at the middle latitude, or, over the equator, weighted by the latitudes."""
    across = 0.5 * (F.abs(lat1) * (earth_radius(lat1) + WGS84_A) + F.abs(lat2) * (earth_radius(lat2) + WGS84_A))
    across = across / F.greatest(F.abs(lat1) + F.abs(lat2), F.lit(0.001))
    return F.when(lat1 * lat2 >= 0, earth_radius(0.5 * (lat1 + lat2))).otherwise(across)


def _central_angle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
    h = h + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * F.atan2(F.sqrt(h), F.sqrt(F.greatest(1 - h, F.lit(0.0))))


def distance_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance with the pair's own radius."""
    return pair_radius(lat1, lat2) * _central_angle(lat1, lon1, lat2, lon2) / NM_M


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    return 6371.0 * _central_angle(lat1, lon1, lat2, lon2)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial great-circle bearing in [-180, 180]."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.degrees(F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)))


def compass(angle: Column) -> Column:
    """An angle in [0, 360)."""
    return F.pmod(angle, F.lit(360.0))


def wrap180(angle: Column) -> Column:
    """An angle in [-180, 180)."""
    return F.pmod(angle + 180.0, F.lit(360.0)) - 180.0


def destination(lat: Column, lon: Column, angle: Column, dist_nm: Column) -> tuple[Column, Column]:
    """Latitude and longitude reached along a bearing."""
    arc, b, p = dist_nm * NM_M / earth_radius(lat), F.radians(angle), F.radians(lat)
    lat2 = F.asin(F.sin(p) * F.cos(arc) + F.cos(p) * F.sin(arc) * F.cos(b))
    lon2 = F.radians(lon) + F.atan2(F.sin(b) * F.sin(arc) * F.cos(p), F.cos(arc) - F.sin(p) * F.sin(lat2))
    return F.degrees(lat2), F.degrees(lon2)


def flat_distance_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on a plane scaled at the middle latitude."""
    dx = F.radians(lon2 - lon1) * F.cos(F.radians(lat1 + lat2) * 0.5)
    return EARTH_M * F.sqrt(F.pow(F.radians(lat2 - lat1), 2) + dx * dx) / NM_M


def flat_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dx = F.radians(lon2 - lon1) * F.cos(F.radians(lat1 + lat2) * 0.5)
    return compass(F.degrees(F.atan2(dx, F.radians(lat2 - lat1))))


def flat_destination(lat: Column, lon: Column, angle: Column, dist_nm: Column) -> tuple[Column, Column]:
    dx, dy = dist_nm * F.sin(F.radians(angle)), dist_nm * F.cos(F.radians(angle))
    return lat + dy / 60.0, lon + dx / F.greatest(60.0 * F.cos(F.radians(lat)), F.lit(0.01))


def local_xy_nm(lat: Column, lon: Column, lat0: float = CENTRE_LAT, lon0: float = CENTRE_LON) -> tuple[Column, Column]:
    """East and north of a fixed centre on its tangent plane."""
    return east_north_nm(lat - lat0, lon - lon0, lat0)


def east_north_nm(north: Column, east: Column, lat0: float = CENTRE_LAT) -> tuple[Column, Column]:
    """Differences of latitude and longitude on the tangent plane of a fixed centre."""
    return east * 60.0 * F.cos(F.radians(F.lit(lat0))), north * 60.0


def velocity_nm_s(track: Column, speed_mps: Column) -> tuple[Column, Column]:
    """East and north speed."""
    return speed_mps / NM_M * F.sin(F.radians(track)), speed_mps / NM_M * F.cos(F.radians(track))


def along_cross_km(lat0: Column, lon0: Column, lat1: Column, lon1: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Distances along and across the great circle from point 0 to point 1, of a point; right of track is positive."""
    d = haversine_km(lat0, lon0, lat, lon) / 6371.0
    off = F.radians(bearing(lat0, lon0, lat, lon) - bearing(lat0, lon0, lat1, lon1))
    return 6371.0 * F.atan2(F.sin(d) * F.cos(off), F.cos(d)), 6371.0 * F.asin(F.sin(d) * F.sin(off))
