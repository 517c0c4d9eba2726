"""The activity grid at all levels of detail and lenses, lines of many vertices, and polygons in an envelope. Each query has its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlake.functions import scalars as S
from roadlake.operators import hexagons as H
from roadlake.operators import lines as L
from roadlake.operators import profile as P
from roadlake.operators import scoring as SC
from roadlake.operators import spatial as SP
from roadlake.plans.contexts import _LIVE_SQL, best_status, live_scores
from roadlake.plans.queries import _ANCHORED, _CLASS, _HEX_COLUMNS, _HEX_MAPPED, _PRIMARY, _SOME_VOLUME, _hex_sql, duck_with, hex_volumes, primary_cells, query

# ---- hexagons in SQL


def _cell(lon: str, lat: str, resolution: int) -> str:
    size = H.edge_m(resolution)
    x, y = f"({lon} * {H.WIDTH!r}::double)", f"({lat} * {H.DEGREE!r}::double)"
    q, r = f"(({H.ROOT3 / 3!r}::double * {x} - {y} / 3) / {size!r}::double)", f"((2.0::double / 3 * {y}) / {size!r}::double)"
    a, b, c = f"round({q})", f"round({r})", f"round(-{q} - {r})"
    dq, dr, ds = f"abs({a} - {q})", f"abs({b} - {r})", f"abs({c} - (-{q} - {r}))"
    far_q, far_r = f"({dq} > {dr} and {dq} > {ds})", f"({dr} > {ds})"
    return f"concat('{resolution}:', cast(case when {far_q} then -{b} - {c} else {a} end as bigint), ':', cast(case when not {far_q} and {far_r} then -{a} - {c} else {b} end as bigint))"


def _centre(name: str, resolution: int) -> tuple[str, str]:
    size = H.edge_m(resolution)
    q, r = (f"cast(split_part({name}, ':', {i}) as bigint)" for i in (2, 3))
    return f"({size * H.ROOT3!r}::double * ({q} + {r} / 2e0) / {H.WIDTH!r}::double)", f"({size * 1.5!r}::double * {r} / {H.DEGREE!r}::double)"


_NAMES = {f"h{r}": _cell("lon", "lat", r) for r in (6, 7, 8, 9)}


@query(
    duck_with("hexes", n=f"select hex_id, {', '.join(f'{v} as {k}' for k, v in _NAMES.items())} from hexes")
    + f"select hex_id, h6, h7, h8, h9, {_cell(*_centre('h9', 9), 8)} as parent, round({_centre('h9', 9)[0]}, 9) as lon, round({_centre('h9', 9)[1]}, 9) as lat from n"
)
def hexagon_cells(t):
    """The hexagons of four resolutions that hold each grid cell, the parent of the finest, and its centre."""
    lon, lat = F.col("lon"), F.col("lat")
    df = t.hexes.select("hex_id", *[H.cell(lon, lat, r).alias(f"h{r}") for r in (6, 7, 8, 9)])
    c = H.centre(F.col("h9"), 9)
    return df.select("hex_id", "h6", "h7", "h8", "h9", H.parent(F.col("h9"), 9).alias("parent"), F.round(c["lon"], 9).alias("lon"), F.round(c["lat"], 9).alias("lat"))


_CORNER = f"select cell, cast(i as bigint) as i, round({_centre('cell', 8)[0]} + {H.edge_m(8)!r}::double * cos(radians(30 + 60 * (i % 6))) / {H.WIDTH!r}::double, 9) as lon, round({_centre('cell', 8)[1]} + {H.edge_m(8)!r}::double * sin(radians(30 + 60 * (i % 6))) / {H.DEGREE!r}::double, 9) as lat from (select distinct {_cell('lon', 'lat', 8)} as cell from hexes) cross join (select unnest(range(7)) as i)"


@query(duck_with("hexes") + _CORNER)
def hexagon_rings(t):
    """The closed rings of all hexagons that hold a grid cell."""
    cells = t.hexes.select(H.cell(F.col("lon"), F.col("lat"), 8).alias("cell")).distinct()
    r = cells.select("cell", F.posexplode(H.ring(F.col("cell"), 8)).alias("i", "p"))
    return r.select("cell", F.col("i").cast("long").alias("i"), F.round("p.lon", 9).alias("lon"), F.round("p.lat", 9).alias("lat"))


# ---- the grid: three lenses, native cells or hexagons, in a box or everywhere


def static_scores(cells: DataFrame) -> DataFrame:
    """The cells with the score, rank, class that their own means give; cells without a mean have none."""
    spread = cells.agg(F.min("volume_mean").alias("low"), F.max("volume_mean").alias("high"))  # one row
    df = cells.crossJoin(F.broadcast(spread))
    norm = S.min_max_100(F.col("volume_mean"), F.col("low"), F.col("high"))
    scored = df.withColumn("score", F.when(F.col("volume_mean").isNotNull(), SC.cell_score(norm, F.col("norm_poi"), F.col("norm_population")))).drop("low", "high")
    has = scored.where("score IS NOT NULL")
    ranked = SC.classed(SC.with_total(SC.ranked(has, "score", "hex_id", True))).withColumn("rank", F.col("rank").cast("long"))
    none = scored.where("score IS NULL").withColumns({"rank": F.lit(None).cast("long"), "total": F.lit(None).cast("long"), "tier": F.lit(None).cast("int"), "class": F.lit(None).cast("string")})
    return ranked.unionByName(none).withColumns({"status": F.lit("static"), "interpolated": F.lit(False)})


def hour_cells(t, hour_of_day: int | None) -> DataFrame:
    """All cells scored at one hour of the day of the profile; the profile's last hour if none is asked for."""
    samples = t.samples()
    anchor = P.anchor(samples)
    asked = anchor.where("anchor IS NOT NULL").select((P.canonical_hour(F.lit(hour_of_day), F.col("anchor")) if hour_of_day is not None else F.col("anchor")).alias("hour"))
    own = samples.withColumn("hour", F.col("period_start")).join(F.broadcast(asked), "hour", "left_semi")  # one row
    volumes, mapped = hex_volumes(own, primary_cells(t), ["hour"])
    return SC.hour_scores(t.hexes, volumes, ["hour"], asked, mapped)


def rolled_up(df: DataFrame, resolution: int) -> DataFrame:
    """Grid cells in hexagons: sums, the score weighted by area over what has one, the class of the mean tier, the best status."""
    area, score, tier = F.col("area"), F.col("score"), S.tier_of_label(F.col("class"))
    some = lambda x, c: F.sum(F.when(c, x))
    mean_tier = some(area * tier, tier > 0) / some(area, tier > 0)
    df = df.withColumn("cell", H.cell(F.col("lon"), F.col("lat"), resolution)).where("cell IS NOT NULL").groupBy("cell").agg(
        F.count("*").alias("members"), F.round(F.sum("area"), 6).alias("area"), F.sum("poi_total").alias("poi_total"), F.sum("population").alias("population"),
        F.round(F.sum(area * score) / some(area, score.isNotNull()), 6).alias("score"), F.bround(F.round(mean_tier, 9), 0).cast("int").alias("_tier"),
        best_status(F.col("status")).alias("_status"), F.bool_or(F.col("status") == "static").alias("_static"), F.bool_or("interpolated").alias("interpolated"),
    )
    return df.withColumn("class", S.quintile_label(6 - F.col("_tier"))).withColumn("status", F.when(F.col("_static"), "static").otherwise(F.col("_status"))).drop("_tier", "_status", "_static")


def grid(t, lens: str = "static", hour_of_day: int | None = None, level: str | None = None, box: tuple[float, float, float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells, breaks) of the activity grid. lens: static, hour or live; level: None for the grid's own cells, or one of hexagons.LEVELS.

    Cells are scored before the box is applied, so the same cell looks the same in every box; the breaks are those of the cells shown.
    """
    if lens not in ("static", "hour", "live"):
        raise ValueError(f"no such lens: {lens}")
    df = {"static": lambda: static_scores(t.hexes), "hour": lambda: hour_cells(t, hour_of_day), "live": lambda: live_scores(t)}[lens]()
    if box is not None:
        df = df.where(SP.in_box(*L.checked(*box)))
    return (rolled_up(df, H.LEVELS[level]) if level else df), SC.quantile_breaks(df, "score")


BOX = (110.35, -7.83, 110.42, -7.79)
_IN = f"lon between {BOX[0]} and {BOX[2]} and lat between {BOX[1]} and {BOX[3]}"
_STATIC_SQL = (
    duck_with(
        "hexes", range_="select min(volume_mean) as low, max(volume_mean) as high from hexes",
        scored=f"select h.*, 'static' as status, false as interpolated, case when volume_mean is not null then {SC.CELL_WEIGHTS['volume']} * (case when high <= low then 100.0 else 1.0 + (volume_mean - low) / (high - low) * 99.0 end) + {SC.CELL_WEIGHTS['poi']} * norm_poi + {SC.CELL_WEIGHTS['population']} * norm_population end as score from hexes h cross join range_",
        ranked="select *, case when score is not null then row_number() over (order by score desc nulls last, hex_id) end as rank, count(score) over () as total from scored",
    ).strip()
)
_HOUR_OF_DAY = 14
_AT = f"select cast(anchor - ((anchor // 3600 % 24 - {_HOUR_OF_DAY}) % 24 + 24) % 24 * 3600 as bigint) as hour from ({_ANCHORED})"
_HOUR_V = f"select f.period_start as hour, {_HEX_COLUMNS} from samples f join hours on hours.hour = f.period_start join {_PRIMARY} using (segment_id) where {_SOME_VOLUME} group by f.period_start, h.hex_id"
_HOUR_SQL = _hex_sql(_HOUR_V, _AT, _HEX_MAPPED)


def _rolled(base: str, level: str, where: str = "true") -> str:
    label = f"case when rank is not null then {_CLASS.format(r='rank', n='total')} end"
    tier = f"case {label} when 'Sangat Tinggi' then 5 when 'Tinggi' then 4 when 'Sedang' then 3 when 'Rendah' then 2 when 'Sangat Rendah' then 1 else 0 end"
    return base + f""", z as (select *, {_cell('lon', 'lat', H.LEVELS[level])} as cell, {tier} as tier from ranked where {where}),
g as (select cell, count(*) as members, round(sum(area), 6) as area, cast(sum(poi_total) as bigint) as poi_total, cast(sum(population) as bigint) as population, round(sum(area * score) / sum(area) filter (score is not null), 6) as score,
cast(round_even(round(sum(area * tier) filter (tier > 0) / sum(area) filter (tier > 0), 9), 0) as int) as tier, bool_or(interpolated) as interpolated,
case when bool_or(status = 'static') then 'static' when bool_or(status = 'live') then 'live' when bool_or(status = 'fallback') then 'fallback' else 'no_data' end as status from z group by cell)
select * exclude (tier), case tier when 5 then 'Sangat Tinggi' when 4 then 'Tinggi' when 3 then 'Sedang' when 2 then 'Rendah' when 1 then 'Sangat Rendah' end as class from g"""


@query(_rolled(_STATIC_SQL, "sub"))
def grid_static(t):
    """The grid as stored, in the finest hexagons."""
    return grid(t, level="sub")[0]


@query(_rolled(_HOUR_SQL, "sub", _IN))
def grid_hour(t):
    """The grid at two in the afternoon of the profile, in the finest hexagons of a box."""
    return grid(t, "hour", _HOUR_OF_DAY, "sub", BOX)[0]


@query(_rolled(_LIVE_SQL, "medium"))
def grid_live(t):
    """The grid by the newest volumes, in larger hexagons."""
    return grid(t, "live", level="medium")[0]


def _shown(base: str) -> str:
    return f"{base}, b as (select quantile_cont(score, [0, 0.25, 0.5, 0.75, 1]) as q, count(score) as n, min(score) as low, max(score) as high from ranked where {_IN}) select i, round(q[i], 6) as value from b cross join (select unnest(range(1, 6)) as i) where n >= 2 and high > low"


@query(_shown(_STATIC_SQL))
def grid_breaks(t):
    """The cut points of the colours of the cells in a box."""
    breaks = grid(t, box=BOX)[1]
    return breaks.where("breaks IS NOT NULL").select(F.posexplode("breaks").alias("i", "value")).select((F.col("i") + 1).cast("long").alias("i"), F.round("value", 6).alias("value"))


@query(_HOUR_SQL + f" select hex_id, round(score, 6) as score, cast(rank as int) as rank, case when rank is not null then {_CLASS.format(r='rank', n='total')} end as class, status, interpolated, reason, segment_ids from ranked where {_IN}")
def grid_cells(t):
    """The grid's own cells in a box at an hour, ranked among all cells."""
    df, _ = grid(t, "hour", _HOUR_OF_DAY, None, BOX)
    return df.select("hex_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"), "class", "status", "interpolated", "reason", F.when(F.col("status") == "live", F.array_join("segment_ids", ",")).alias("segment_ids"))


# ---- lines of many vertices

_EDGES = "select segment_id, i, lon as lon1, lat as lat1, lead(lon) over w as lon2, lead(lat) over w as lat2 from vertices window w as (partition by segment_id order by i)"
_FLAT = "(({x} - p.lon) * cos(radians(p.lat)) * pi() / 180 * 6371000.0)", "(({y} - p.lat) * pi() / 180 * 6371000.0)"
_POLY = {
    "e": f"select * from ({_EDGES}) where lon2 is not null",
    "ends": f"select p.stop_id, e.segment_id, {_FLAT[0].format(x='lon1')} as ax, {_FLAT[1].format(y='lat1')} as ay, {_FLAT[0].format(x='lon2')} as bx, {_FLAT[1].format(y='lat2')} as by_ from stops p cross join e",
    "along": "select *, greatest(0.0, least(1.0, -(ax * (bx - ax) + ay * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) as t from ends",
    "close": "select stop_id, segment_id, min(sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (by_ - ay), 2))) as distance_m from along group by all",
}


def line_paths(t) -> DataFrame:
    """Every segment as a line of five vertices."""
    return L.paths(t.vertices, "segment_id", "i")


@query(duck_with("vertices", "stops", **_POLY) + "select stop_id, segment_id, round(distance_m, 3) as distance_m from close where distance_m <= 500")
def stops_near_lines(t):
    """Every stop within 500 m of a line of many vertices, with the distance to its nearest edge."""
    return L.points_near(t.stops, line_paths(t), "stop_id", "segment_id", 500.0).withColumn("distance_m", F.round("distance_m", 3))


_BOXED = {
    "e": f"select * from ({_EDGES}) where lon2 is not null",
    "c": "select segment_id, hex_id, lon2 - lon1 as dx, lat2 - lat1 as dy, lon1, lat1, h.lon - 0.001 as x0, h.lon + 0.001 as x1, h.lat - 0.001 as y0, h.lat + 0.001 as y1 from e cross join hexes h where least(lon1, lon2) <= h.lon + 0.001 and greatest(lon1, lon2) >= h.lon - 0.001 and least(lat1, lat2) <= h.lat + 0.001 and greatest(lat1, lat2) >= h.lat - 0.001",
    "o": "select segment_id, hex_id, (t1 - t0) * sqrt(dx * dx + dy * dy) as part from (select *, greatest(0.0, least((x0 - lon1) / dx, (x1 - lon1) / dx), least((y0 - lat1) / dy, (y1 - lat1) / dy)) as t0, least(1.0, greatest((x0 - lon1) / dx, (x1 - lon1) / dx), greatest((y0 - lat1) / dy, (y1 - lat1) / dy)) as t1 from c) where t1 >= t0",
}


@query(duck_with("vertices", "hexes", **_BOXED) + "select segment_id, count(*) filter (overlap > 1e-9) as cells, round(sum(overlap), 6) as inside from (select segment_id, hex_id, sum(part) as overlap from o group by all) group by all")
def line_cells(t):
    """How many grid cells each line of many vertices runs through, and its length in them."""
    df = L.in_boxes(line_paths(t), t.hexes.select("hex_id", "lon", "lat"), "segment_id", "hex_id", 0.001)
    return df.groupBy("segment_id").agg(F.count_if(F.col("overlap") > 1e-9).alias("cells"), F.round(F.sum("overlap"), 6).alias("inside"))


# ---- polygons in an envelope: a triangle around every grid cell

_SHAPE = ((-0.0031, -0.0012), (0.0042, -0.0008), (0.0002, 0.0053))
_ENVELOPE = (110.3617, -7.8189, 110.3631, -7.8181)


def shapes(t) -> DataFrame:
    corner = lambda x, y: F.struct((F.col("lon") + x).alias("lon"), (F.col("lat") + y).alias("lat"))
    return t.hexes.select("hex_id", F.array(*[corner(x, y) for x, y in _SHAPE]).alias("ring"))


def _triangles() -> str:
    """The polygons that meet the box, by separating axes: a convex shape and a box are apart only along an axis of either's sides."""
    left, low, right, high = _ENVELOPE
    xs, ys = [f"(lon + {x})" for x, _ in _SHAPE], [f"(lat + {y})" for _, y in _SHAPE]
    apart = [f"greatest({', '.join(xs)}) < {left}", f"least({', '.join(xs)}) > {right}", f"greatest({', '.join(ys)}) < {low}", f"least({', '.join(ys)}) > {high}"]
    for i in range(3):
        j, k = (i + 1) % 3, (i + 2) % 3
        side = lambda x, y, i=i, j=j: f"(({xs[j]} - {xs[i]}) * ({y} - {ys[i]}) - ({ys[j]} - {ys[i]}) * ({x} - {xs[i]}))"
        outside = " and ".join(f"{side(x, y)} * sign({side(xs[k], ys[k])}) < 0" for x in (left, right) for y in (low, high))
        apart.append(f"({outside})")
    return f"select hex_id from hexes where not ({' or '.join(apart)})"


@query(duck_with("hexes") + _triangles())
def polygon_envelope(t):
    """The polygons that meet a box; most are sorted out by their bounds."""
    return L.in_envelope(L.with_bounds(shapes(t)), *_ENVELOPE).select("hex_id")
