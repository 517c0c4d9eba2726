"""Buffers and their shares in zones, population write-back, and open windows: named queries with their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlake.functions import scalars as S
from roadlake.operators import polygons as PG
from roadlake.operators import traffic as T
from roadlake.plans.queries import NOW, _snapshots, duck_with, half_up, query
from roadlake.schema import CATEGORIES

METRES, ZONE = 500.0, 0.01

# ---- SQL of rings and of cutting them at the sides of a square


def _destination(lon: str, lat: str, bearing: str) -> str:
    d, p = f"({METRES} / {PG.RADIUS}::double)", f"radians({lat})"
    y = f"asin(sin({p}) * cos({d}) + cos({p}) * sin({d}) * cos({bearing}))"
    x = f"radians({lon}) + atan2(sin({bearing}) * sin({d}) * cos({p}), cos({d}) - sin({p}) * sin({y}))"
    return f"{{'lon': degrees({x}), 'lat': degrees({y})}}"


def _cut(ring: str, axis: str, bound: str, sign: int) -> str:
    """The part of a ring on one side of a line of equal longitude or latitude."""
    other = "lat" if axis == "lon" else "lon"
    p, q = f"{ring}[i]", f"{ring}[i % len({ring}) + 1]"
    s, t = (f"({sign} * ({x}.{axis} - {bound}))" for x in (p, q))
    at = {axis: bound, other: f"{p}.{other} + ({q}.{other} - {p}.{other}) * {s} / ({s} - {t})"}
    crossing = f"{{'lon': {at['lon']}, 'lat': {at['lat']}}}"
    kept = f"case when {s} >= 0 and {s} * {t} < 0 then [{p}, {crossing}] when {s} >= 0 then [{p}] when {s} * {t} < 0 then [{crossing}] else [] end"
    return f"flatten(list_transform(range(1, len({ring}) + 1), lambda i: {kept}))"


def _area(ring: str) -> str:
    p, q, o = f"{ring}[i]", f"{ring}[i % len({ring}) + 1]", f"{ring}[1]"
    cross = f"({p}.lon - {o}.lon) * ({q}.lat - {o}.lat) - ({q}.lon - {o}.lon) * ({p}.lat - {o}.lat)"
    return f"abs(coalesce(list_sum(list_transform(range(1, len({ring}) + 1), lambda i: {cross})), 0)) / 2"


def _spread(axis: str) -> str:
    cell = lambda f: f"cast(floor({f}(list_transform(r, lambda p: p.{axis})) / {ZONE}::double) as bigint)"
    return f"unnest(range({cell('list_min')}, {cell('list_max')} + 1))"


def _shares(rings: str) -> dict[str, str]:
    """Common table expressions from rings (id, r) to shares (id, zone, share)."""
    side = {k: f"({k[1]} + {k[0]}) * {ZONE}::double" for k in ("0x", "0y", "1x", "1y")}
    return {
        "b": rings,
        "bx": f"select *, {_spread('lon')} as x from b",
        "tiles": f"select *, {_spread('lat')} as y from bx",
        "c1": f"select *, {_cut('r', 'lon', side['0x'], 1)} as r1 from tiles",
        "c2": f"select *, {_cut('r1', 'lon', side['1x'], -1)} as r2 from c1",
        "c3": f"select *, {_cut('r2', 'lat', side['0y'], 1)} as r3 from c2",
        "c4": f"select *, {_cut('r3', 'lat', side['1y'], -1)} as r4 from c3",
        "shares": f"select * from (select id, x * 100000 + y as zone, {_area('r4')} / ({_area('r')}) as share from c4) where share > 1e-9",
    }


_CIRCLES = f"select stop_id as id, list_transform(range(0, 65), lambda i: {_destination('lon', 'lat', '(2 * pi() * i / 64)')}) as r from stops"
_BEARING = "select *, atan2(sin(radians(lon2) - radians(lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2) - radians(lon1))) as b from segments"
_CAPSULES = (
    f"select segment_id as id, list_concat(list_transform(range(0, 33), lambda k: {_destination('lon2', 'lat2', '(b - pi() / 2 + pi() * k / 32)')}), "
    f"list_transform(range(0, 33), lambda k: {_destination('lon1', 'lat1', '(b + pi() / 2 + pi() * k / 32)')})) as r from ({_BEARING})"
)


def zone_shares(rings: DataFrame, key: str, size: float = ZONE) -> DataFrame:
    """key, zone, share of each convex ring in the square zones that it touches; rings: key, ring."""
    low = lambda axis, f: F.floor(f(F.transform("ring", lambda p: p[axis])) / size)
    spread = lambda axis: F.explode(F.sequence(low(axis, F.array_min), low(axis, F.array_max)))
    cells = rings.withColumn("_x", spread("lon")).withColumn("_y", spread("lat"))
    corner = lambda dx, dy: F.struct(((F.col("_x") + dx) * size).alias("lon"), ((F.col("_y") + dy) * size).alias("lat"))
    zone = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))
    number = (F.col("_x") * 100_000 + F.col("_y")).cast("long").alias("zone")
    share = PG.share_inside(F.col("ring"), zone, convex_zone=True)
    # exploded and not filtered: Spark would work out a filter's expression once more for its column
    return cells.select(key, number, F.explode(F.filter(F.array(share), lambda x: x > 1e-9)).alias("share"))


@query(duck_with("stops", b=_CIRCLES) + "select id as stop_id, cast(i - 1 as bigint) as i, round(r[i].lon, 6) as lon, round(r[i].lat, 6) as lat from (select *, unnest(range(1, 66)) as i from b)")
def buffer_rings(t):
    r = t.stops.select("stop_id", F.posexplode(PG.circle(F.col("lon"), F.col("lat"), METRES)).alias("i", "p"))
    return r.select("stop_id", F.col("i").cast("long").alias("i"), F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


@query(duck_with("stops", **_shares(_CIRCLES)) + "select id as stop_id, zone, round(share, 6) as share from shares")
def buffer_overlap(t):
    """The share of each stop's 500 m surroundings in each square zone that they touch; shares of a stop add up to 1."""
    rings = t.stops.select("stop_id", PG.circle(F.col("lon"), F.col("lat"), METRES).alias("ring"))
    return zone_shares(rings, "stop_id").withColumn("share", F.round("share", 6))


# ---- population of the zones around a segment; the zone of its middle writes its population back


_MIDDLE = f"select segment_id as id, cast(floor((lon1 + lon2) / 2 / {ZONE}::double) as bigint) * 100000 + cast(floor((lat1 + lat2) / 2 / {ZONE}::double) as bigint) as own from segments"
_POPULATION = "1000 + {zone} % 97 * 10"


@query(
    duck_with("segments", **_shares(_CAPSULES), middle=_MIDDLE)
    + f"select id as segment_id, zone, round(share, 6) as share, {_POPULATION.format(zone='zone')} as zone_population, zone = own as is_primary, {_POPULATION.format(zone='own')} as population from shares join middle using (id)"
)
def population_context(t):
    """Zones within 500 m of each segment with their shares, and the population that the zone of the segment's middle writes back."""
    c = F.col
    rings = t.segments.select("segment_id", PG.capsule(c("lon1"), c("lat1"), c("lon2"), c("lat2"), METRES).alias("ring"))
    own = F.floor((c("lon1") + c("lon2")) / 2 / ZONE) * 100_000 + F.floor((c("lat1") + c("lat2")) / 2 / ZONE)
    population = lambda zone: (1000 + zone % 97 * 10).cast("long")
    df = zone_shares(rings, "segment_id").join(t.segments.select("segment_id", own.cast("long").alias("own")), "segment_id")
    return df.select(
        "segment_id", "zone", F.round("share", 6).alias("share"), population(c("zone")).alias("zone_population"), (c("zone") == c("own")).alias("is_primary"), population(c("own")).alias("population")
    )


# ---- windows at a moment: finished by their camera's own events or by a common watermark, or still open


MOMENT = NOW - 10 * 86400 - 30_000
_STATES = {
    "snaps": f"select * from ({_snapshots(86400)}) where captured_at < {MOMENT}",
    "w": f"select camera_id, \"window\", {', '.join(f'avg({c}) as {c}' for c in CATEGORIES)}, count(*) as sample_count, max(captured_at) as last_captured_at from snaps group by all",
    "v": "select *, max(last_captured_at) over (partition by camera_id) >= \"window\" + 86400 as finished from w",
}
_VALUES = f"{', '.join(f'{half_up(c, 6)} as {c}' for c in CATEGORIES)}, sample_count, last_captured_at"


def _at_moment(t, watermark: int | None) -> DataFrame:
    df = T.windows_at(t.observations.where(F.col("captured_at") < MOMENT), 86400, watermark)
    return df.select("camera_id", "window", "status", *[S.half_up(F.col(c), 6).alias(c) for c in CATEGORIES], "sample_count", "last_captured_at")


@query(duck_with("observations", **_STATES) + f"select camera_id, \"window\", case when finished or \"window\" + 86400 <= {MOMENT - 40_000} then 'completed' else 'open' end as status, {_VALUES} from v")
def window_flush(t):
    """A watermark flushes all cameras' windows that end before it; a camera's own later events finish its windows too."""
    return _at_moment(t, MOMENT - 40_000)


@query(duck_with("observations", **_STATES) + f"select camera_id, \"window\", {_VALUES} from (select *, row_number() over (partition by camera_id order by \"window\" desc) as rn from v where not finished) where rn = 1")
def window_preview(t):
    """The newest open window of each camera."""
    return T.previews(_at_moment(t, None)).drop("status")
