"""Distances and containment on columns of degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The earth's radius; metres per degree and the latitude at which longitudes are flattened; for areas,
# kilometres per degree of latitude and longitude at 13.7 degrees north.
EARTH_M = 6_371_000.0
DEGREE_M, FLAT_AT = 111_320.0, 13.75
LAT_KM, LNG_KM = 110.57, 111.32 * math.cos(math.radians(13.7))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres."""
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def flat(lat: Column, lng: Column) -> tuple[Column, Column]:
    """Metres east and north on a plane about the city."""
    return lng * (DEGREE_M * math.cos(math.radians(FLAT_AT))), lat * DEGREE_M


def segment_distance(lat: Column, lng: Column, lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres from a point to a segment, on the plane."""
    (px, py), (ax, ay), (bx, by) = flat(lat, lng), flat(lat1, lng1), flat(lat2, lng2)
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.when(square > 0, square)))).otherwise(0.0)
    return F.hypot(px - (ax + t * dx), py - (ay + t * dy))


def inside_ring(lat: Column, lng: Column, ring: Column) -> Column:
    """Whether a point lies in a ring, an array of [lng, lat] pairs, by counting the edges that a ray crosses."""
    n = F.size(ring)

    def crosses(p: Column, i: Column) -> Column:
        q = F.element_at(ring, F.when(i == 0, n).otherwise(i))
        over = (p[1] > lat) != (q[1] > lat)
        at = (q[0] - p[0]) * (lat - p[1]) / F.when(q[1] - p[1] != 0, q[1] - p[1]) + p[0]
        return F.when(over & (lng < at), 1).otherwise(0)

    return F.aggregate(F.transform(ring, crosses), F.lit(0), lambda a, x: a + x) % 2 == 1


def inside_polygon(lat: Column, lng: Column, rings: Column) -> Column:
    """In the first ring and in none of the others, which are holes."""
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(1)))
    return inside_ring(lat, lng, rings[0]) & ~F.exists(holes, lambda h: inside_ring(lat, lng, h))


def ring_area_km2(ring: Column, lng_km: float = LNG_KM, lat_km: float = LAT_KM) -> Column:
    """Shoelace area of a ring of [lng, lat] pairs, closed or not."""
    shifted = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(1))), F.slice(ring, 1, 1))
    parts = F.zip_with(ring, shifted, lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.abs(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)) / 2 * lat_km * lng_km


def vertex_mean(ring: Column) -> Column:
    """struct<lng, lat>: the mean of a ring's vertices; null without any."""
    n = F.when(F.size(ring) > 0, F.size(ring))
    mean = lambda i: F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[i]) / n
    return F.struct(mean(0).alias("lng"), mean(1).alias("lat"))
