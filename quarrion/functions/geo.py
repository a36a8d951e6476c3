"""Geometry as column expressions on longitude and latitude in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the Earth in metres.
RADIUS = 6371008.7714


def distance(lon: Column, lat: Column, to: tuple[float, float]) -> Column:
    """Great-circle distance in metres."""
    a, b = F.radians(lat), F.radians(F.lit(float(to[1])))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(F.lit(float(to[0])) - lon) / 2), 2)
    return F.lit(2 * RADIUS) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def in_box(lon: Column, lat: Column, low: tuple[float, float], high: tuple[float, float]) -> Column:
    """A box whose western edge lies east of its eastern one crosses the date line."""
    if low[1] > high[1]:
        raise ValueError("bottom left lies above top right")
    inside = lon.between(low[0], high[0]) if low[0] <= high[0] else (lon >= low[0]) | (lon <= high[0])
    return inside & lat.between(low[1], high[1])


def in_ring(lon: Column, lat: Column, ring: list) -> Column:
    """Whether a ray to the east crosses the ring an odd number of times."""
    odd = F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        if y1 == y2:
            continue
        crosses = ((F.lit(float(y1)) > lat) != (F.lit(float(y2)) > lat)) & (lon < F.lit((x2 - x1) / (y2 - y1)) * (lat - float(y1)) + float(x1))
        odd = odd != crosses
    return odd


def in_geometry(lon: Column, lat: Column, geometry: dict) -> Column:
    """Point in a Polygon (holes excluded) or MultiPolygon."""
    kind, at = geometry["type"], geometry["coordinates"]
    if kind not in ("Polygon", "MultiPolygon"):
        raise ValueError(f"{kind} has no inside")
    hit = F.lit(False)
    for polygon in at if kind == "MultiPolygon" else [at]:
        inside = in_ring(lon, lat, polygon[0])
        for hole in polygon[1:]:
            inside = inside & ~in_ring(lon, lat, hole)
        hit = hit | inside
    return hit


def box_relation(low_lon: Column, low_lat: Column, high_lon: Column, high_lat: Column, relation: str, geometry: dict) -> Column:
    """Relations of stored boxes to a point or an axis-parallel box."""
    points = [geometry["coordinates"]] if geometry["type"] == "Point" else geometry["coordinates"][0]
    if relation == "within" and geometry["type"] == "Point":
        raise ValueError("nothing lies within a point")
    w, e = min(p[0] for p in points), max(p[0] for p in points)
    s, n = min(p[1] for p in points), max(p[1] for p in points)
    if geometry["type"] != "Point" and {tuple(p) for p in points} != {(w, s), (w, n), (e, s), (e, n)}:
        raise NotImplementedError("stored shapes are related to points and boxes only")
    apart = (low_lon > e) | (high_lon < w) | (low_lat > n) | (high_lat < s)
    if relation == "intersects":
        return ~apart
    if relation == "disjoint":
        return apart
    if relation == "within":
        return (low_lon >= w) & (high_lon <= e) & (low_lat >= s) & (high_lat <= n)
    if relation == "contains":
        return (low_lon <= w) & (high_lon >= e) & (low_lat <= s) & (high_lat >= n)
    raise ValueError(f"unknown relation {relation}")
