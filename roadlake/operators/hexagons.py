"""A hexagonal grid as column expressions: cells of a point, their centres and rings, and the cells of a coarser grid that hold them.

Hexagons stand on a corner, on a plane that stretches longitudes by the cosine of one latitude, so that they are regular around it. A cell
is named by its resolution and its two axial coordinates. Each resolution's cells have about seven times the area of the next one's; a
cell's parent is the coarser cell that holds its centre.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadlake.schema import EARTH_M

#: Fixed value: the mean edge of cells of resolution 0 in metres; the next one's is shorter by the root of seven.
EDGE_0 = 1_107_712.591
#: Resolutions of the levels of detail.
LEVELS = {"coarse": 6, "medium": 7, "sub": 8}
#: The latitude around which cells are regular, and the metres of a degree.
LATITUDE, DEGREE = -7.8, math.pi / 180 * EARTH_M
WIDTH = DEGREE * math.cos(math.radians(LATITUDE))
ROOT3 = math.sqrt(3)


def edge_m(resolution: int) -> float:
    return EDGE_0 / 7 ** (resolution / 2)


def axial(lon: Column, lat: Column, resolution: int) -> Column:
    """q and r of the cell of a point: its fractional coordinates rounded to the nearest centre."""
    size = edge_m(resolution)
    x, y = lon * WIDTH, lat * DEGREE
    q, r = (ROOT3 / 3 * x - y / 3) / size, (2 / 3 * y) / size
    s = -q - r
    rq, rr, rs = F.round(q), F.round(r), F.round(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    far_q, far_r = (dq > dr) & (dq > ds), dr > ds  # what was rounded furthest follows from the other two
    return F.struct(F.when(far_q, -rr - rs).otherwise(rq).cast("long").alias("q"), F.when(~far_q & far_r, -rq - rs).otherwise(rr).cast("long").alias("r"))


def named(at: Column, resolution: int) -> Column:
    return F.concat_ws(":", F.lit(str(resolution)), at["q"].cast("string"), at["r"].cast("string"))


def cell(lon: Column, lat: Column, resolution: int) -> Column:
    """The name of a point's cell; null without a place."""
    return F.when(lon.isNotNull() & lat.isNotNull(), named(axial(lon, lat, resolution), resolution))


def parts(name: Column) -> tuple[Column, Column]:
    split = F.split(name, ":")
    return F.element_at(split, 2).cast("long"), F.element_at(split, 3).cast("long")


def centre(name: Column, resolution: int) -> Column:
    q, r = parts(name)
    size = edge_m(resolution)
    return F.struct((size * ROOT3 * (q + r / 2) / WIDTH).alias("lon"), (size * 1.5 * r / DEGREE).alias("lat"))


def ring(name: Column, resolution: int) -> Column:
    """The closed boundary, seven points counter-clockwise."""
    c, size = centre(name, resolution), edge_m(resolution)
    corner = lambda i: F.struct((c["lon"] + size * math.cos(math.radians(30 + 60 * i)) / WIDTH).alias("lon"), (c["lat"] + size * math.sin(math.radians(30 + 60 * i)) / DEGREE).alias("lat"))
    return F.array(*[corner(i) for i in (0, 1, 2, 3, 4, 5, 0)])


def parent(name: Column, resolution: int) -> Column:
    """The cell of the next coarser resolution that holds a cell's centre."""
    c = centre(name, resolution)
    return cell(c["lon"], c["lat"], resolution - 1)


def neighbours(name: Column, resolution: int) -> Column:
    q, r = parts(name)
    steps = ((1, 0), (0, 1), (-1, 1), (-1, 0), (0, -1), (1, -1))
    return F.array(*[F.concat_ws(":", F.lit(str(resolution)), (q + a).cast("string"), (r + b).cast("string")) for a, b in steps])
