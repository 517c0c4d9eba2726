"""Buffers around points and lines, and shares of their area in zones, as column expressions over rings.

A ring is an array of (lon, lat) structs, closed or not. Areas are in square degrees; only their ratios inside one buffer are used.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the radius of the sphere.
RADIUS = 6378137.0
RING = "array<struct<lon: double, lat: double>>"


def destination(lon: Column, lat: Column, metres: float, bearing: Column) -> Column:
    """The point at a distance and bearing (radians, clockwise from north) on a sphere."""
    d, p = F.lit(metres / RADIUS), F.radians(lat)
    y = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(bearing))
    x = F.radians(lon) + F.atan2(F.sin(bearing) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(y))
    return F.struct(F.degrees(x).alias("lon"), F.degrees(y).alias("lat"))


def circle(lon: Column, lat: Column, metres: float, steps: int = 64) -> Column:
    """A closed ring around a point."""
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: destination(lon, lat, metres, 2 * math.pi * i / steps))


def bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    return F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))


def capsule(lon1: Column, lat1: Column, lon2: Column, lat2: Column, metres: float, steps: int = 32) -> Column:
    """The surroundings of a straight line: half a circle around each end. It is convex."""
    b, i = bearing(lon1, lat1, lon2, lat2), F.sequence(F.lit(0), F.lit(steps))
    ahead = F.transform(i, lambda k: destination(lon2, lat2, metres, b - math.pi / 2 + math.pi * k / steps))
    behind = F.transform(i, lambda k: destination(lon1, lat1, metres, b + math.pi / 2 + math.pi * k / steps))
    return F.concat(ahead, behind)


def rotated(ring: Column) -> Column:
    """Each place holds what the next one held."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def signed_area(ring: Column) -> Column:
    """Positive for a ring that runs counter-clockwise; 0 for an empty one."""
    o = F.get(ring, 0)
    crosses = F.zip_with(ring, rotated(ring), lambda p, q: (p["lon"] - o["lon"]) * (q["lat"] - o["lat"]) - (q["lon"] - o["lon"]) * (p["lat"] - o["lat"]))
    return F.aggregate(crosses, F.lit(0.0), lambda a, x: a + x) / 2


def counter_clockwise(ring: Column) -> Column:
    return F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def clipped(subject: Column, convex: Column) -> Column:
    """The part of a ring inside a convex counter-clockwise one, cut along one edge after the other.

    The subject need not be convex: parts that fall apart stay tied by edges of no area, so areas are right.
    """
    none, n = F.array().cast(RING), F.size(convex)

    def cut(ring: Column, i: Column) -> Column:
        a, b = F.element_at(convex, i), F.element_at(convex, i % n + 1)
        left = lambda p: (b["lon"] - a["lon"]) * (p["lat"] - a["lat"]) - (b["lat"] - a["lat"]) * (p["lon"] - a["lon"])
        measured = F.transform(ring, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"), left(p).alias("side")))

        def kept(p: Column, q: Column) -> Column:
            at = p["side"] / (p["side"] - q["side"])
            crossing = F.struct(*[(p[c] + (q[c] - p[c]) * at).alias(c) for c in ("lon", "lat")])
            own = F.when(p["side"] >= 0, F.array(F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))).otherwise(none)
            return F.concat(own, F.when(p["side"] * q["side"] < 0, F.array(crossing)).otherwise(none))

        return F.flatten(bound(measured, lambda sided: F.zip_with(sided, rotated(sided), kept)))

    return F.aggregate(F.sequence(F.lit(1), n), subject, cut)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def share_inside(buffer: Column, zone: Column, convex_zone: bool = False) -> Column:
    """The share of a convex buffer's area that lies in a zone of any simple shape; a zone of several parts is a row for each part.

    convex_zone: zones are convex and have fewer sides than the buffer, so the buffer is cut at theirs, which takes fewer cuts.
    """
    subject, at = (buffer, zone) if convex_zone else (zone, buffer)
    inside = bound(counter_clockwise(at), lambda convex: clipped(subject, convex))
    return F.abs(bound(inside, signed_area)) / F.abs(signed_area(buffer))
