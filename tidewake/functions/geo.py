"""Distances, projection and planar geometry as native column expressions.

Rings are ``array<struct<lon:double,lat:double>>`` columns.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numeric import as_col

EARTH_RADIUS_KM = 6371.0
MERCATOR_RADIUS_M = 6378137.0
KM_PER_LAT_DEGREE = 110.57
KM_PER_LON_DEGREE = 111.32


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance, NULL if a coordinate is; the arcsine argument is bounded to [0, 1]."""
    a1, o1, a2, o2 = (F.radians(as_col(c)) for c in (lat1, lon1, lat2, lon2))
    dlat, dlon = F.sin((a2 - a1) / 2), F.sin((o2 - o1) / 2)
    h = dlat * dlat + F.cos(a1) * F.cos(a2) * dlon * dlon
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.when(h < 0, 0.0).when(h > 1, 1.0).otherwise(h)))


def planar_km(lat1, lon1, lat2, lon2) -> Column:
    """Flat-earth distance with the longitude scale taken at (lat1, lon1)."""
    a1, o1, a2, o2 = (as_col(c) for c in (lat1, lon1, lat2, lon2))
    dy = (a1 - a2) * KM_PER_LAT_DEGREE
    dx = (o1 - o2) * KM_PER_LON_DEGREE * F.cos(F.radians(a1))
    return F.hypot(dx, dy)


def mercator_lon(x) -> Column:
    return F.degrees(as_col(x) / MERCATOR_RADIUS_M)


def mercator_lat(y) -> Column:
    import math
    return F.degrees(2 * F.atan(F.exp(as_col(y) / MERCATOR_RADIUS_M)) - math.pi / 2)


def ring_edges(ring) -> Column:
    """Consecutive vertex pairs of a ring as array<struct<x1,y1,x2,y2>>."""
    r = as_col(ring)
    n = F.size(r)
    return F.zip_with(
        F.slice(r, F.lit(1), n - 1), F.slice(r, F.lit(2), n - 1),
        lambda a, b: F.struct(a["lon"].alias("x1"), a["lat"].alias("y1"),
                              b["lon"].alias("x2"), b["lat"].alias("y2")))


def ray_parity(lon, lat, edges) -> Column:
    """Even-odd rule over an edge array: true when the point is inside."""
    x, y = as_col(lon), as_col(lat)

    def crosses(e):
        spans = (e["y1"] > y) != (e["y2"] > y)
        at = F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"]
        return spans & F.coalesce(x < at, F.lit(False))

    return F.size(F.filter(as_col(edges), crosses)) % 2 == 1


def point_in_ring(lon, lat, ring) -> Column:
    return ray_parity(lon, lat, ring_edges(ring))


def ring_centroid(ring) -> Column:
    """Area centroid struct<lat,lon>; the vertex mean when the ring has no area."""
    r = as_col(ring)
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"))

    def step(acc, e):
        cross = e["x1"] * e["y2"] - e["x2"] * e["y1"]
        return F.struct((acc["a"] + cross).alias("a"),
                        (acc["cx"] + (e["x1"] + e["x2"]) * cross).alias("cx"),
                        (acc["cy"] + (e["y1"] + e["y2"]) * cross).alias("cy"))

    s = F.aggregate(ring_edges(r), zero, step)
    total = lambda field: F.aggregate(r, F.lit(0.0), lambda acc, p: acc + p[field])
    flat = F.abs(s["a"]) < 1e-12
    return F.struct(
        F.when(flat, F.try_divide(total("lat"), F.size(r)))
        .otherwise(F.try_divide(s["cy"], 3 * s["a"])).alias("lat"),
        F.when(flat, F.try_divide(total("lon"), F.size(r)))
        .otherwise(F.try_divide(s["cx"], 3 * s["a"])).alias("lon"))


def cell_index(x, size: float) -> Column:
    """Floor cell of a coordinate."""
    return F.floor(as_col(x) / F.lit(float(size))).cast("long")


def rounded_cell(x, size: float) -> Column:
    """Nearest cell, halves to even."""
    return F.rint(as_col(x) / F.lit(float(size))).cast("long")
