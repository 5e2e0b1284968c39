"""Geometry as column expressions. Coordinates are degrees, lengths metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_008.8
METRES_PER_DEGREE = 111_320.0
WALKING_M_PER_MIN = 80.0


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def haversine_py(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    """The same for plain numbers."""
    dlat, dlon = math.radians(lat2 - lat1) / 2, math.radians(lon2 - lon1) / 2
    a = math.sin(dlat) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(dlon) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(min(1.0, math.sqrt(a)))


def project(lon: Column, lat: Column, reference_lat: Column | float) -> tuple[Column, Column]:
    """Equirectangular x and y about a reference latitude."""
    ref = F.lit(reference_lat) if isinstance(reference_lat, (int, float)) else reference_lat
    return F.lit(EARTH_RADIUS_M) * F.radians(lon) * F.cos(F.radians(ref)), F.lit(EARTH_RADIUS_M) * F.radians(lat)


def project_planar(lon: Column, lat: Column, centre_lon: Column, centre_lat: Column) -> tuple[Column, Column]:
    """Planar x and y about a centre, at a fixed number of metres a degree."""
    return (lon - centre_lon) * METRES_PER_DEGREE * F.cos(F.radians(centre_lat)), (lat - centre_lat) * METRES_PER_DEGREE


def planar_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Planar distance at the middle latitude."""
    dx = (lon1 - lon2) * METRES_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(dx * dx + ((lat1 - lat2) * METRES_PER_DEGREE) * ((lat1 - lat2) * METRES_PER_DEGREE))


def point_to_segment_squared(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared distance of a point from a segment; a segment without length is a point."""
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / length))).otherwise(F.lit(0.0))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return ex * ex + ey * ey


def point_to_line_squared(px: Column, py: Column, xs: Column, ys: Column) -> Column:
    """Least squared distance of a point from the polyline with vertices xs, ys."""
    at = lambda a, i: F.element_at(a, i)
    return F.array_min(F.transform(F.sequence(F.lit(1), F.size(xs) - 1), lambda i: point_to_segment_squared(px, py, at(xs, i), at(ys, i), at(xs, i + 1), at(ys, i + 1))))


def interpolate(a: Column, b: Column, share: Column) -> Column:
    return a + (b - a) * share


def is_coordinate(lon: Column, lat: Column) -> Column:
    """Both there and finite."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return fine(lon) & fine(lat)


def bounds(lon: Column, lat: Column, decimals: int | None = None, pad_m: float = 0.0) -> list[Column]:
    """Aggregates west, south, east, north, widened by pad_m and rounded."""
    west, east, south, north = F.min(lon), F.max(lon), F.min(lat), F.max(lat)
    if pad_m:
        dy, dx = pad_m / METRES_PER_DEGREE, F.lit(pad_m) / (METRES_PER_DEGREE * F.cos(F.radians((south + north) / 2)))
        west, east, south, north = west - dx, east + dx, south - dy, north + dy
    named = {"west": west, "south": south, "east": east, "north": north}
    return [(F.round(c, decimals) if decimals is not None else c).alias(n) for n, c in named.items()]


def walking_minutes(metres: Column) -> Column:
    return metres / WALKING_M_PER_MIN
