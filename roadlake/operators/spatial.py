"""Spatial joins by grid cells, without geometry libraries: every pair test follows an equi-join on cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.functions.scalars import haversine_m
from roadlake.schema import EARTH_M


def places_within(left: DataFrame, right: DataFrame, metres: float, max_lat: float = 60.0) -> DataFrame:
    """lon, lat, lon_r, lat_r, distance_m of the places at most `metres` apart: each pair of places once, however many rows are in either.

    A cell is as high and as wide as the distance at latitude max_lat, so neighbours are in the 3 x 3 cells around.
    """
    high = math.degrees(metres / EARTH_M) * 1.0000001
    wide = high / math.cos(math.radians(max_lat))
    cell = lambda c, size: F.floor(F.col(c) / size)
    l = left.select("lon", "lat").distinct()  # noqa: E741
    l = l.withColumn("_x", F.explode(F.array(*[cell("lon", wide) + d for d in (-1, 0, 1)]))).withColumn("_y", F.explode(F.array(*[cell("lat", high) + d for d in (-1, 0, 1)])))  # noqa: E741
    r = right.select("lon_r", "lat_r").distinct().withColumn("_x", cell("lon_r", wide)).withColumn("_y", cell("lat_r", high))
    d = haversine_m(F.col("lon"), F.col("lat"), F.col("lon_r"), F.col("lat_r"))
    return l.join(r, ["_x", "_y"]).drop("_x", "_y").withColumn("distance_m", d).where(F.col("distance_m") <= metres)


def within_distance(left: DataFrame, right: DataFrame, metres: float, max_lat: float = 60.0, digits: int | None = None) -> DataFrame:
    """Pairs of points at most `metres` apart, with distance_m, rounded if digits are given. left has lon, lat; right has lon_r, lat_r.

    Distances are of pairs of places, and rounded there, as rounding costs more than joining a pair; rows meet where their places do. What only
    counts or takes the least of the pairs is better off with places_within() and a row a place, as the pairs of many points in few places are
    their product. Neither side of the last join is broadcast, as files say little about how many rows they hold. Its rows are dealt by fractions,
    so Spark deals them once more and chooses the number of tasks.
    """
    near = places_within(left, right, metres, max_lat)
    near = near if digits is None else near.withColumn("distance_m", F.round("distance_m", digits))
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = left.join(near, ["lon", "lat"]).repartition(parts, "lon_r", "lat_r")
    return met.join(right.hint("merge"), ["lon_r", "lat_r"]).select(*left.columns, *right.columns, "distance_m")


#: The width in degrees of the smallest cells in which nearest points are sought (about 5 cm), and how much wider those of the next size are.
FINEST, WIDER = 0.01 / 4**7, 4


def nearest(left: DataFrame, right: DataFrame, key: list[str], right_id: str, groups: list[str] | None = None, carry: list[str] | None = None, finest: float = FINEST) -> DataFrame:
    """key, right_id, d2 and the right columns to carry: the nearest right point (planar, in degrees) of each left row, ties to the smaller id.

    Of right points in one place only the smallest id can be nearest, so each place counts once. Cells have several sizes, each four times the last,
    from `finest` to the whole plane. A left cell of the smallest size takes the first size whose 3 x 3 cells around it hold a right point; that
    point is no further than the cells of the next size reach, so the 3 x 3 cells of that size surely have the nearest of every point in the cell.
    The denser the right points, the smaller these cells: a left point meets about a hundred of them, however many there are. All joins are
    equi-joins on cells, whatever the data: no rounds, no pairs of all with all. A left row whose group has no right point, or that has no place,
    is in no result.
    """
    last = next(k for k in range(64) if finest * WIDER**k > 720) + 1
    groups, carry = groups or [], carry or []
    at = lambda c: F.floor(F.col(c) / finest)
    levels = F.explode(F.sequence(F.lit(0), F.lit(last))).alias("_level")
    up = lambda c: F.expr(f"shiftright({c}, 2 * _level)")  # noqa: E731  a cell of a size lies in one of the next
    around = lambda df: df.withColumn("_i", F.explode(F.array(*[F.lit(d) for d in range(9)]))).withColumn("_u", F.expr("_u + _i div 3 - 1")).withColumn("_v", F.expr("_v + _i % 3 - 1")).drop("_i")
    coarse = lambda df, *keep: df.select(*groups, *keep, "_x", "_y", levels).withColumn("_u", up("_x")).withColumn("_v", up("_y"))
    place = [*groups, "_level", "_u", "_v"]
    r = right.groupBy(*groups, "lon_r", "lat_r").agg(F.min(F.struct(right_id, *carry)).alias("_of")).withColumn("_x", at("lon_r")).withColumn("_y", at("lat_r"))
    l = left.withColumn("_x", at("lon")).withColumn("_y", at("lat"))  # noqa: E741
    occupied = around(coarse(r).select(*place).distinct()).distinct()
    own = [*groups, "_x", "_y"]
    fits = coarse(l.select(*own).distinct()).join(occupied, place, "left_semi").groupBy(*own).agg((F.min("_level") + 1).alias("_level"))
    asked = around(fits.withColumn("_u", up("_x")).withColumn("_v", up("_y")))
    rights = coarse(r, "lon_r", "lat_r", "_of").drop("_x", "_y")
    candidates = asked.join(rights, place).select(*own, "lon_r", "lat_r", "_of")
    d2 = F.pow(F.col("lon") - F.col("lon_r"), 2) + F.pow(F.col("lat") - F.col("lat_r"), 2)
    met = l.select(*dict.fromkeys([*key, *own]), "lon", "lat").join(candidates, own).withColumn("d2", d2)
    best = met.groupBy(*key).agg(F.min(F.struct("d2", "_of")).alias("b"))
    return best.select(*key, *(F.col("b.d2" if c == "d2" else f"b._of.{c}").alias(c) for c in (right_id, "d2", *carry)))


#: With at most as many right points, meeting each of them costs no more than looking for cells does.
FEW = 128


def nearest_in_small_groups(left: DataFrame, right: DataFrame, key: list[str], right_id: str, groups: list[str]) -> DataFrame:
    """key, right_id as nearest() gives them: left rows of groups with at most FEW right points meet all of these, without a shuffle for each pair;
    nearest() is asked for the others. right is read several times, so it should be a written table."""
    sizes = right.groupBy(*groups).agg(F.count("*").alias("_n"))
    some = right.join(sizes.where(F.col("_n") <= FEW).drop("_n"), groups).groupBy(*groups).agg(F.collect_list(F.struct("lon_r", "lat_r", right_id)).alias("_all"))
    d2 = lambda p: F.pow(F.col("lon") - p["lon_r"], 2) + F.pow(F.col("lat") - p["lat_r"], 2)
    met = left.join(some, groups).withColumn("_best", F.array_min(F.transform("_all", lambda p: F.struct(d2(p).alias("d2"), p[right_id].alias(right_id)))))
    met = met.where("lon IS NOT NULL AND lat IS NOT NULL").select(*key, F.col(f"_best.{right_id}").alias(right_id))
    large = sizes.where(F.col("_n") > FEW).drop("_n")
    if large.isEmpty():
        return met
    return met.unionByName(nearest(left.join(large, groups, "left_semi"), right.join(large, groups, "left_semi"), key, right_id, groups).select(*key, right_id))


def point_line_m(lon: Column, lat: Column, lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres from a point to a straight line, on the plane that touches the sphere at the point: exact enough for a few kilometres."""
    scale = math.pi / 180 * EARTH_M
    flat = lambda x, y: ((x - lon) * F.cos(F.radians(lat)) * scale, (y - lat) * scale)
    (ax, ay), (bx, by) = flat(lon1, lat1), flat(lon2, lat2)
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / length))).otherwise(0.0)
    return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))


def points_near_lines(points: DataFrame, lines: DataFrame, metres: float, max_lat: float = 60.0) -> DataFrame:
    """Pairs of points (lon, lat) and lines (lon1, lat1, lon2, lat2) at most `metres` apart, with distance_m: an equi-join on the cells around each line."""
    high = math.degrees(metres / EARTH_M) * 1.0000001
    wide = high / math.cos(math.radians(max_lat))
    reach = lambda a, b, size: F.explode(F.sequence(F.floor((F.least(a, b) - size) / size), F.floor((F.greatest(a, b) + size) / size)))
    l = lines.withColumn("_x", reach("lon1", "lon2", wide)).withColumn("_y", reach("lat1", "lat2", high))  # noqa: E741
    p = points.withColumn("_x", F.floor(F.col("lon") / wide)).withColumn("_y", F.floor(F.col("lat") / high))
    d = point_line_m(*(F.col(c) for c in ("lon", "lat", "lon1", "lat1", "lon2", "lat2")))
    return p.join(l, ["_x", "_y"]).drop("_x", "_y").withColumn("distance_m", d).where(F.col("distance_m") <= metres)


def in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Whether a point is in a polygon's ring, an array of (lon, lat): an odd number of edges crossed to the right."""
    n = F.size(ring)
    edges = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, F.when(i == n, 1).otherwise(i + 1).cast("int")).alias("b")))
    crosses = lambda e: ((e["a"]["lat"] > lat) != (e["b"]["lat"] > lat)) & (lon < (e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) / (e["b"]["lat"] - e["a"]["lat"]) + e["a"]["lon"])
    return F.size(F.filter(edges, crosses)) % 2 == 1


def square(lon: Column, lat: Column, half: float) -> Column:
    corner = lambda dx, dy: F.struct((lon + dx * half).alias("lon"), (lat + dy * half).alias("lat"))
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


def squares_of_places(points: DataFrame, centres: DataFrame, square_id: str, half: float, size: float = 0.004) -> DataFrame:
    """lon, lat, square_id: the smallest id of the squares around centres (lon, lat) that hold each distinct place of the points, a row a place.

    The squares are not broadcast: a compressed file of them looks smaller than it is.
    """
    h = box_cells(centres.select(square_id, "lon", "lat"), half, size).select(square_id, "_x", "_y", F.col("lon").alias("_lon"), F.col("lat").alias("_lat"))
    p = points.select("lon", "lat").distinct().withColumn("_x", F.floor(F.col("lon") / size)).withColumn("_y", F.floor(F.col("lat") / size))
    held = h.join(p.hint("merge"), ["_x", "_y"]).where(in_ring(F.col("lon"), F.col("lat"), square(F.col("_lon"), F.col("_lat"), half)))
    return held.groupBy("lon", "lat").agg(F.min(square_id).alias(square_id))


def clipped_length(x1: Column, y1: Column, x2: Column, y2: Column, left: Column, low: Column, right: Column, high: Column) -> Column:
    """The planar length of the part of a line inside a box, by clipping its parameter range; null if none is."""
    dx, dy = x2 - x1, y2 - y1

    def enter_leave(d: Column, a: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
        t1, t2 = (lo - a) / d, (hi - a) / d
        outside = (a < lo) | (a > hi)
        return F.when(d != 0, F.least(t1, t2)).when(outside, 2.0).otherwise(0.0), F.when(d != 0, F.greatest(t1, t2)).when(outside, -1.0).otherwise(1.0)

    a, b = enter_leave(dx, x1, left, right), enter_leave(dy, y1, low, high)
    t0, t1 = F.greatest(F.lit(0.0), a[0], b[0]), F.least(F.lit(1.0), a[1], b[1])
    return F.when(t1 >= t0, (t1 - t0) * F.sqrt(dx * dx + dy * dy))


def line_cells(df: DataFrame, size: float) -> DataFrame:
    """Every cell that a line's box touches, as _x, _y."""
    ends = lambda a, b: F.sequence(F.floor(F.least(a, b) / size), F.floor(F.greatest(a, b) / size))
    return df.withColumn("_x", F.explode(ends("lon1", "lon2"))).withColumn("_y", F.explode(ends("lat1", "lat2")))


def box_cells(df: DataFrame, half: float, size: float) -> DataFrame:
    """Every cell that a square around a centre touches, as _x, _y."""
    ends = lambda c: F.sequence(F.floor((F.col(c) - half) / size), F.floor((F.col(c) + half) / size))
    return df.withColumn("_x", F.explode(ends("lon"))).withColumn("_y", F.explode(ends("lat")))


def lines_in_boxes(lines: DataFrame, boxes: DataFrame, line_id: str, box_id: str, half: float, size: float = 0.004) -> DataFrame:
    """line_id, box_id, overlap: every line and square that meet, with the length inside."""
    pairs = line_cells(lines, size).join(box_cells(boxes, half, size), ["_x", "_y"]).dropDuplicates([line_id, box_id])
    c = F.col
    length = clipped_length(c("lon1"), c("lat1"), c("lon2"), c("lat2"), c("lon") - half, c("lat") - half, c("lon") + half, c("lat") + half)
    return pairs.withColumn("overlap", length).where("overlap IS NOT NULL").select(line_id, box_id, "overlap")


def in_box(left: float, low: float, right: float, high: float) -> Column:
    if left >= right or low >= high:
        raise ValueError("the box is empty")
    return F.col("lon").between(left, right) & F.col("lat").between(low, high)
