"""Lines of any number of vertices and polygons of any simple shape: least distances, lengths inside boxes, and envelopes.

A line is an array of (lon, lat). Its edges are looked up by the cells that each runs through, column by column, so a long edge costs its
length and not the area of its box; every exact test follows an equi-join on cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.operators.spatial import clipped_length, in_ring, point_line_m
from roadlake.schema import EARTH_M

EDGE = ("lon1", "lat1", "lon2", "lat2")


def edges(lines: DataFrame, path: str = "path") -> DataFrame:
    """A row for each edge, as lon1, lat1, lon2, lat2; a line of one vertex has one edge of no length, an empty or null one none."""
    p = F.col(path)
    n = F.size(p)
    ends = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct(F.element_at(p, i).alias("a"), F.element_at(p, F.least(i + 1, n)).alias("b")))
    df = lines.where(n > 0).withColumn("_e", F.explode(ends)).drop(path)
    place = {"lon1": "a.lon", "lat1": "a.lat", "lon2": "b.lon", "lat2": "b.lat"}
    return df.select(*[c for c in df.columns if c != "_e"], *[F.col(f"_e.{v}").alias(k) for k, v in place.items()])


def paths(vertices: DataFrame, key: str, order: str) -> DataFrame:
    """Lines from rows of vertices."""
    some = F.sort_array(F.collect_list(F.struct(F.col(order).alias("i"), "lon", "lat")))
    return vertices.groupBy(key).agg(F.transform(some, lambda v: F.struct(v["lon"].alias("lon"), v["lat"].alias("lat"))).alias("path"))


def covered(df: DataFrame, wide: float, high: float, pad_lon: float = 0.0, pad_lat: float = 0.0) -> DataFrame:
    """Every cell (_x, _y) that an edge comes as near as the pads: for each column the rows of the piece that lies in it."""
    c = F.col
    left, right = F.least("lon1", "lon2"), F.greatest("lon1", "lon2")
    df = df.withColumn("_x", F.explode(F.sequence(F.floor((left - pad_lon) / wide), F.floor((right + pad_lon) / wide))))
    a, b = F.greatest(left, c("_x") * wide - pad_lon), F.least(right, (c("_x") + 1) * wide + pad_lon)
    at = lambda x: F.when(c("lon1") == c("lon2"), None).otherwise(c("lat1") + (c("lat2") - c("lat1")) * (x - c("lon1")) / (c("lon2") - c("lon1")))
    ends = [F.coalesce(at(a), c("lat1")), F.coalesce(at(b), c("lat2"))]
    slack = 1e-12  # of the division
    return df.withColumn("_y", F.explode(F.sequence(F.floor((F.least(*ends) - pad_lat - slack) / high), F.floor((F.greatest(*ends) + pad_lat + slack) / high))))


def points_near(points: DataFrame, lines: DataFrame, point_id: str, line_id: str, metres: float, path: str = "path", max_lat: float = 60.0) -> DataFrame:
    """point_id, line_id, distance_m: every point (lon, lat) and line at most `metres` apart, with the distance to the nearest of its edges."""
    high = math.degrees(metres / EARTH_M) * 1.0000001
    wide = high / math.cos(math.radians(max_lat))
    e = covered(edges(lines.select(line_id, path), path), wide, high, wide, high)
    p = points.select(point_id, "lon", "lat").withColumn("_x", F.floor(F.col("lon") / wide)).withColumn("_y", F.floor(F.col("lat") / high))
    met = p.join(e, ["_x", "_y"]).withColumn("distance_m", point_line_m(*(F.col(c) for c in ("lon", "lat", *EDGE)))).where(F.col("distance_m") <= metres)
    return met.groupBy(point_id, line_id).agg(F.min("distance_m").alias("distance_m"))


def in_boxes(lines: DataFrame, boxes: DataFrame, line_id: str, box_id: str, half: float, path: str = "path", size: float = 0.004) -> DataFrame:
    """line_id, box_id, overlap: every line and square (around lon, lat) that meet, with the length inside."""
    e = covered(edges(lines.select(line_id, path), path).withColumn("_edge", F.monotonically_increasing_id()), size, size)
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - half) / size), F.floor((F.col(c) + half) / size)))
    b = boxes.select(box_id, "lon", "lat").withColumn("_x", reach("lon")).withColumn("_y", reach("lat"))
    pairs = e.join(b, ["_x", "_y"]).dropDuplicates([line_id, *EDGE, box_id])
    c = F.col
    pairs = pairs.withColumn("overlap", clipped_length(c("lon1"), c("lat1"), c("lon2"), c("lat2"), c("lon") - half, c("lat") - half, c("lon") + half, c("lat") + half))
    return pairs.where("overlap IS NOT NULL").groupBy(line_id, box_id).agg(F.sum("overlap").alias("overlap"))


# ---- polygons and boxes

BOUNDS = ("xmin", "ymin", "xmax", "ymax")


def checked(left: float, low: float, right: float, high: float) -> tuple[float, float, float, float]:
    """A box on the globe, or an error."""
    if not (-180 <= left < right <= 180 and -90 <= low < high <= 90):
        raise ValueError("the box has to be left, low, right, high on the globe")
    return left, low, right, high


def with_bounds(df: DataFrame, ring: str = "ring") -> DataFrame:
    """The box of each ring (an array of lon, lat) as columns that a scan can filter by."""
    side = lambda f, axis: f(F.transform(F.col(ring), lambda p: p[axis]))
    return df.withColumns({"xmin": side(F.array_min, "lon"), "ymin": side(F.array_min, "lat"), "xmax": side(F.array_max, "lon"), "ymax": side(F.array_max, "lat")})


def meets(ring: Column, left: float, low: float, right: float, high: float) -> Column:
    """Whether a polygon and a box have a point in common: one of its edges meets the box, or the box lies inside."""
    n = F.size(ring)
    numbers = [F.lit(v) for v in (left, low, right, high)]

    def touches(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i % n + 1)
        return clipped_length(a["lon"], a["lat"], b["lon"], b["lat"], *numbers).isNotNull()

    return F.exists(F.sequence(F.lit(1), n), touches) | in_ring(F.lit(left), F.lit(low), ring)


def morton(lon: Column, lat: Column, bits: int = 16) -> Column:
    """The place on a curve that fills the plane cell by cell: the bits of both coordinates in turn."""
    most = 2**bits - 1
    x = F.least(F.lit(most), F.greatest(F.lit(0), F.floor((lon + 180) / 360 * most))).cast("long")
    y = F.least(F.lit(most), F.greatest(F.lit(0), F.floor((lat + 90) / 180 * most))).cast("long")

    def spread(v: Column) -> Column:
        for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
        return v

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def clustered(df: DataFrame, ring: str = "ring", parts: int | None = None) -> DataFrame:
    """The rows with their bounds, near ones together along the curve: files and row groups cover small boxes and most can be skipped."""
    df = with_bounds(df, ring).withColumn("_at", morton((F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2))
    dealt = df.repartitionByRange(parts, "_at") if parts else df.repartitionByRange("_at")
    return dealt.sortWithinPartitions("_at").drop("_at")


def in_envelope(df: DataFrame, left: float, low: float, right: float, high: float, ring: str = "ring") -> DataFrame:
    """The polygons that meet a box. Their bounds are tested first, as plain comparisons that reach the scan; the exact test sees what is left."""
    left, low, right, high = checked(left, low, right, high)
    near = df.where((F.col("xmin") <= right) & (F.col("xmax") >= left) & (F.col("ymin") <= high) & (F.col("ymax") >= low))
    return near.where(meets(F.col(ring), left, low, right, high))
