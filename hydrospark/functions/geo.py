"""Great-circle geometry and the drainage-basin polygon."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hydrospark.functions.base import ColumnLike, col

EARTH_RADIUS_MI = 3958.7613
Ring = Sequence[tuple[float, float]]


def haversine_mi(lat1: ColumnLike, lon1: ColumnLike, lat2: ColumnLike, lon2: ColumnLike) -> Column:
    lat1, lon1, lat2, lon2 = (col(c) for c in (lat1, lon1, lat2, lon2))
    chord = (
        F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0))
        + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
        * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    )
    # Opposite points can round to just above 1, where the arc sine is undefined. Unlike `least`,
    # this keeps a missing coordinate a missing distance.
    return F.lit(2 * EARTH_RADIUS_MI) * F.nanvl(F.asin(F.sqrt(chord)), F.lit(math.pi / 2))


def bearing_deg(lat1: ColumnLike, lon1: ColumnLike, lat2: ColumnLike, lon2: ColumnLike) -> Column:
    """Initial bearing from point 1 to point 2, degrees clockwise from north in [0, 360)."""
    lat1, lon1, lat2, lon2 = (col(c) for c in (lat1, lon1, lat2, lon2))
    a, b, turn = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(turn) * F.cos(b)
    north = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def angular_diff(a: ColumnLike, b: ColumnLike) -> Column:
    """Smallest angle between two bearings, in [0, 180]."""
    return F.abs(F.pmod(col(a) - col(b) + 180.0, F.lit(360.0)) - 180.0)


def inside_ring(lat: ColumnLike, lon: ColumnLike, ring: Ring) -> Column:
    """Even-odd test. The ring is a handful of fixed vertices, so each edge is one term of the
    expression and the test stays inside generated code, with no join."""
    lat, lon = col(lat), col(lon)
    crossings = []
    for (y1, x1), (y2, x2) in zip(ring[:-1], ring[1:]):
        if y1 == y2:
            continue
        slope = (x2 - x1) / (y2 - y1)
        spans = (F.lit(y1) > lat) != (F.lit(y2) > lat)
        crossings.append(F.when(spans & (lon < (lat - y1) * slope + x1), 1).otherwise(0))
    return reduce(lambda a, b: a + b, crossings) % 2 == 1


def ring_distance_mi(lat: ColumnLike, lon: ColumnLike, ring: Ring) -> Column:
    """0 inside the ring, else the distance to its nearest vertex."""
    vertices = list(dict.fromkeys(ring))
    nearest = F.least(*[haversine_mi(lat, lon, y, x) for y, x in vertices])
    return F.when(inside_ring(lat, lon, ring), F.lit(0.0)).otherwise(nearest)


def ring_proximity(distance_mi: ColumnLike) -> Column:
    miles = col(distance_mi)
    return F.when(miles.isNotNull(), F.exp(-F.greatest(F.lit(0.0), miles) / 100.0))
