"""Positions: keys, zones, distances and polygon tests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from phenogrid.functions.columns import col
from phenogrid.schema import EARTH_KM


def location_key(lat, lon) -> Column:
    return F.format_string("%.4f_%.4f", col(lat), col(lon))


def utm_epsg(lat, lon) -> Column:
    zone = F.floor((col(lon) + 180) / 6) + 1
    return F.concat(F.lit("EPSG:"), (F.when(col(lat) >= 0, 32600).otherwise(32700) + zone).cast("string"))


def distance_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dp = F.radians(col(lat2) - col(lat1))
    dl = F.radians(col(lon2) - col(lon1))
    h = F.sin(dp / 2) * F.sin(dp / 2) + F.cos(p1) * F.cos(p2) * F.sin(dl / 2) * F.sin(dl / 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def ring_centre(ring) -> tuple[Column, Column]:
    """(lon, lat) mean of a closed ring's vertices without the closing one."""
    ring = col(ring)
    n = F.size(ring) - 1
    open_ring = F.slice(ring, F.lit(1), n)
    mean = lambda part: F.aggregate(open_ring, F.lit(0.0), lambda acc, p: acc + p[part]) / n
    return mean("lon"), mean("lat")


def ring_crossings(lon, lat, ring) -> Column:
    """Number of ring edges crossed by a ray from the position."""
    ring = col(ring)
    lon, lat = col(lon), col(lat)

    def step(acc, i):
        a = F.element_at(ring, i)
        b = F.element_at(ring, F.when(i == 1, F.size(ring)).otherwise(i - 1))
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        x = F.try_divide((b["lon"] - a["lon"]) * (lat - a["lat"]), b["lat"] - a["lat"]) + a["lon"]
        return acc + F.when(spans & (lon < x), 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.size(ring)), F.lit(0), step)


def in_rings(lon, lat, rings) -> Column:
    """Even-odd test over all outer rings together."""
    total = F.aggregate(col(rings), F.lit(0), lambda acc, r: acc + ring_crossings(lon, lat, r))
    return total % 2 == 1
