"""Named queries that put facts, cells, stops and questions into the shapes that users see. Each has its SQL for DuckDB beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlake.functions import scalars as S
from roadlake.operators import analytics as A
from roadlake.operators import facts as FA
from roadlake.operators import records as R
from roadlake.operators import scoring as SC
from roadlake.operators import spatial as SP
from roadlake.operators import traffic as T
from roadlake.plans.queries import _CLIP, _HAV, _HEX_COLUMNS, _LATEST, _PRIMARY, KEPT, NOW, W6, _hex_sql, duck_with, facts_sql, hex_volumes, primary_cells, query
from roadlake.schema import CATEGORIES, POLLUTANTS

# ---- metrics and flags from JSON

_JSON = """select f.*, try_cast(json_extract_string(totals, '$.co2') as double) / 1000 as co2, try_cast(json_extract_string(totals, '$.nox') as double) / 1000 as nox,
coalesce(json_extract_string(meta, '$.calculation_metadata.is_interpolated') = 'true', false) as interpolated, coalesce(json_extract_string(spatial_metadata, '$.corridor_id'), segment_id) as corridor
from raw_facts f join segment_metadata using (segment_id)"""


@query(duck_with("raw_facts", "segment_metadata", j=_JSON) + "select corridor, count(*) as facts, count(co2) as with_co2, round(avg(co2), 9) as co2_kg_h, round(avg(co2 + nox), 9) as both_kg_h, count(*) filter (interpolated) as interpolated from j group by all")
def json_metrics(t):
    """Rates of JSON totals by the corridor that a segment's JSON names, or the segment itself: a missing key is null, not zero."""
    f = t.raw_facts.join(t.segment_metadata, "segment_id")
    corridor = R.json_or("spatial_metadata", "corridor_id", F.col("segment_id")).alias("corridor")
    co2, nox = (R.json_number("totals", p) / 1000 for p in ("co2", "nox"))
    df = f.select(corridor, co2.alias("co2"), nox.alias("nox"), R.json_flag("meta", "calculation_metadata.is_interpolated").alias("interpolated"))
    mean = lambda c: F.round(F.avg(c), 9)
    return df.groupBy("corridor").agg(
        F.count("*").alias("facts"), F.count("co2").alias("with_co2"), mean("co2").alias("co2_kg_h"), mean(F.col("co2") + F.col("nox")).alias("both_kg_h"), F.count_if("interpolated").alias("interpolated")
    )


# ---- records


def _records(t) -> DataFrame:
    meta = t.raw_facts.select("id", "meta")
    return R.fact_records(t.samples().join(meta, "id"), NOW)


_OBSERVED = "coalesce(cast(json_extract_string(meta, '$.observed_at') as bigint), period_end)"
_RECORD = {
    "record": f"""select s.*, m.meta, {_OBSERVED} as observed_at, greatest(0, {NOW} - {_OBSERVED}) as age, coalesce(semantics, '') = 'snapshot_occupancy' as est
from samples s join raw_facts m using (id)"""
}
_RECORD_COLUMNS = """cast(id as varchar) as id, segment_id, corridor_name, period_start, observed_at, calculated_us // 1000000 as processed_at, source_mode,
case when est then 'estimated' else 'observed' end as quality_status, case when age <= 180 then 'fresh' else 'stale' end as freshness_status,
coalesce(json_extract_string(meta, '$.calculation_metadata.is_interpolated') = 'true', false) as is_interpolated, json_extract_string(meta, '$.calculation_metadata.interpolation_method') as interpolation_method"""
_CALCULATION = "coalesce(json_extract_string(meta, '$.calculation_mode'), case when est then 'live_occupancy_estimate' else 'flow_based_segment' end) as calculation_mode"


def _record_sql(columns: str) -> str:
    return facts_sql(extra=_RECORD).replace("with ", "with " + duck_with("raw_facts").removeprefix("with ").strip() + ", ", 1) + f"select {_RECORD_COLUMNS}, {columns} from record"


@query(_record_sql(f"version as calculation_version, {_CALCULATION}, age as freshness_seconds, 180 as stale_after_seconds, round(co2_g_h / 1000, 9) as co2_kg_h, car_veh_h, car_vkt, 'kg/hour' as unit"))
def fact_records(t):
    """The full record of each fact, its structures flattened to compare."""
    shared = ["id", "segment_id", "corridor_name", "period_start", "observed_at", "processed_at", "source_mode", "quality_status", "freshness_status", "is_interpolated", "interpolation_method"]
    return _records(t).select(
        *shared, "calculation_version", "calculation_mode", F.col("freshness_seconds").cast("long").alias("freshness_seconds"), "stale_after_seconds", F.round("emissions_kg_h.co2", 9).alias("co2_kg_h"),
        F.col("volume_per_hour.car").alias("car_veh_h"), F.col("vkt_km_h.car").alias("car_vkt"), F.col("units.emissions").alias("unit"),
    )


_ALL_G = " + ".join(f"{p}_g_h / 1000" for p in POLLUTANTS)
_SOME_V = "+".join(f"coalesce({c}_veh_h, 0)" for c in CATEGORIES)
_ANY_V = f"coalesce({', '.join(f'{c}_veh_h' for c in CATEGORIES)}) is not null"


@query(_record_sql(f"round({_ALL_G}, 6) as total_emissions_kg_h, case when {_ANY_V} then round({_SOME_V}, 6) end as total_vehicles_per_hour, version as detail_version, {_CALCULATION.replace('as calculation_mode', 'as detail_mode')}, truck_vkt as detail_truck_vkt"))
def history_records(t):
    """The curated record: totals only where they are whole, provenance below detail."""
    df = R.history_records(_records(t))
    shared = ["id", "segment_id", "corridor_name", "period_start", "observed_at", "processed_at", "source_mode", "quality_status", "freshness_status", "is_interpolated", "interpolation_method"]
    detail = [F.col("detail.calculation_version").alias("detail_version"), F.col("detail.calculation_mode").alias("detail_mode"), F.col("detail.vkt_km_h.truck").alias("detail_truck_vkt")]
    return df.select(*shared, F.round("total_emissions_kg_h", 6).alias("total_emissions_kg_h"), F.round("total_vehicles_per_hour", 6).alias("total_vehicles_per_hour"), *detail)


_LAST = f"select * from (select *, row_number() over ({_LATEST}) as rn from kept) where rn = 1"
_NEAREST = "select * from (select s.segment_id, l.segment_id as source, row_number() over (partition by s.segment_id order by pow(s.lon1 - l.lon1, 2) + pow(s.lat1 - l.lat1, 2), l.segment_id) as rn from segments s cross join l where s.segment_id not in (select segment_id from l)) where rn = 1"
_SUM_G = "+".join(f"coalesce({p}_g_h, 0)" for p in POLLUTANTS)
_ANY_G = f"coalesce({', '.join(f'{p}_g_h' for p in POLLUTANTS)}) is not null"
_SHOWN = {
    "l": _LAST, "n": _NEAREST,
    "shown": "select s.segment_id, s.segment_name, coalesce(l.segment_id, n.source) as of_segment, n.source as borrowed_from, case when l.segment_id is not null then 'observed' when n.source is not null then 'estimated' else 'unavailable' end as data_status from segments s left join l using (segment_id) left join n using (segment_id)",
}


@query(
    duck_with("facts", "segments", kept=KEPT, **_SHOWN)
    + f"""select w.segment_id, w.segment_name, case when {_ANY_G} then round({_SUM_G}, 6) end as total_emission_g_h, period_end as observed_at, case when id is not null then greatest(0, {NOW} - period_end) end as data_age_seconds,
case when id is null then 'unknown' when greatest(0, {NOW} - period_end) <= 30 then 'fresh' when greatest(0, {NOW} - period_end) <= 90 then 'aging' else 'stale' end as freshness_status,
case when id is null then 'unknown' else coalesce(semantics, 'unknown') end as vehicle_count_semantics, case when id is null then 'unavailable' when semantics = 'snapshot_occupancy' then 'estimated' else 'calculated' end as volume_status,
data_status, borrowed_from from shown w left join l on l.segment_id = of_segment"""
)
def segment_map(t):
    """One item a segment for the map: its newest fact, or the nearest segment's, or nothing."""
    columns = ["id", "period_end", "semantics", *(f"{p}_g_h" for p in POLLUTANTS)]
    own = t.newest("lon1", "lat1", *columns)
    rest = t.segments.join(own, "segment_id", "left_anti").select("segment_id", F.col("lon1").alias("lon"), F.col("lat1").alias("lat"))
    others = own.select(F.col("segment_id").alias("borrowed_from"), F.col("lon1").alias("lon_r"), F.col("lat1").alias("lat_r"), *columns)
    lent = SP.nearest(rest, others, ["segment_id"], "borrowed_from", carry=columns).drop("d2")
    seen = own.drop("lon1", "lat1").select("*", F.lit(None).cast("string").alias("borrowed_from"), F.lit("observed").alias("data_status"))
    display = seen.unionByName(lent.withColumn("data_status", F.lit("estimated")))
    items = R.map_items(t.segments, display, NOW)
    return items.withColumn("total_emission_g_h", F.round("total_emission_g_h", 6)).withColumn("data_age_seconds", F.col("data_age_seconds").cast("long"))


@query(
    duck_with("facts", "segments", kept=KEPT, l=_LAST)
    + f"select s.segment_id, case when l.id is null then 'NO DATA' when source_mode <> 'LIVE' then 'HISTORICAL' when {NOW} - period_end <= 86400 then 'LIVE' else 'STALE' end as status from segments s left join l using (segment_id)"
)
def live_status(t):
    l = FA.latest(t.matching()).select("segment_id", "source_mode", "period_end")  # noqa: E741
    fresh = S.freshness(F.lit(NOW) - F.col("period_end"), 86400, 86400)
    return t.segments.select("segment_id").join(l, "segment_id", "left").select("segment_id", R.live_status(F.col("source_mode"), fresh).alias("status"))


# ---- stops, lines and cells

_FLAT = "(({x} - p.lon) * cos(radians(p.lat)) * pi() / 180 * 6371000.0)", "(({y} - p.lat) * pi() / 180 * 6371000.0)"
_LINE = {
    "ends": f"select p.stop_id, s.segment_id, {_FLAT[0].format(x='s.lon1')} as ax, {_FLAT[1].format(y='s.lat1')} as ay, {_FLAT[0].format(x='s.lon2')} as bx, {_FLAT[1].format(y='s.lat2')} as by_ from stops p cross join segments s",
    "along": "select *, greatest(0.0, least(1.0, -(ax * (bx - ax) + ay * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)))) as t from ends",
    "close": "select stop_id, segment_id, sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (by_ - ay), 2)) as distance_m from along where sqrt(pow(ax + t * (bx - ax), 2) + pow(ay + t * (by_ - ay), 2)) <= 500",
}


def _close(t) -> DataFrame:
    lines = t.segments.select("segment_id", "lon1", "lat1", "lon2", "lat2")
    return SP.points_near_lines(t.stops.select("stop_id", "lon", "lat"), lines, 500.0).select("stop_id", "segment_id", "distance_m")


@query(duck_with("stops", "segments", **_LINE) + "select stop_id, segment_id, round(distance_m, 3) as distance_m from close")
def stops_near_segments(t):
    """Every stop within 500 m of a segment's line, with the distance."""
    return _close(t).withColumn("distance_m", F.round("distance_m", 3))


@query(duck_with("stops", "segments", **_LINE) + "select stop_id, arg_min(segment_id, (round(distance_m, 6), segment_id)) as segment_id from close group by all")
def segment_for_stop(t):
    """The nearest segment within 500 m of each stop."""
    return _close(t).groupBy("stop_id").agg(F.min_by("segment_id", F.struct(F.round("distance_m", 6), "segment_id")).alias("segment_id"))


def crossed_segments(t) -> DataFrame:
    return SP.lines_in_boxes(t.segments, t.hexes.select("hex_id", "lon", "lat"), "segment_id", "hex_id", 0.001)


@query(duck_with("segments", "hexes", **_CLIP, n="select distinct hex_id, segment_name from o join segments using (segment_id)", r="select *, row_number() over (partition by hex_id order by segment_name) as rn from n") + "select hex_id, string_agg(segment_name, '|' order by segment_name) as names from r where rn <= 3 group by all")
def hex_corridors(t):
    """The first three names of the segments that cross a cell."""
    names = crossed_segments(t).join(t.segments.select("segment_id", "segment_name"), "segment_id").select("hex_id", "segment_name").distinct()
    rank = F.row_number().over(Window.partitionBy("hex_id").orderBy("segment_name"))
    first = names.withColumn("rank", rank).where("rank <= 3").groupBy("hex_id").agg(F.array_sort(F.collect_list("segment_name")).alias("names"))
    return first.select("hex_id", F.array_join("names", "|").alias("names"))


@query(
    duck_with("segments", "hexes", "cameras", "mappings", "facts", kept=KEPT, **_CLIP)
    + """select (select count(*) from hexes) as hexes, (select count(distinct hex_id) from o) as with_segment, (select count(*) from cameras where is_active) as active_cameras,
(select count(distinct camera_id) from mappings where is_active and valid_to is null) as mapped_cameras,
(select count(*) from cameras c where is_active and camera_id not in (select camera_id from mappings m where m.is_active and valid_to is null)) as unmapped_cameras,
(select count(*) from segments) as segments, (select count(distinct segment_id) from kept where source_mode = 'REPLAY') as with_replay"""
)
def coverage_report(t):
    """How much of the grid, the cameras and the segments has data behind it: one row."""
    open_ = t.mappings.where("is_active AND valid_to IS NULL").select("camera_id").distinct()
    active = t.cameras.where("is_active").select("camera_id")
    one = lambda df, name: df.agg(F.count("*").alias(name))
    parts = [
        one(t.hexes, "hexes"), one(crossed_segments(t).select("hex_id").distinct(), "with_segment"), one(active, "active_cameras"), one(open_, "mapped_cameras"),
        one(active.join(open_, "camera_id", "left_anti"), "unmapped_cameras"), one(t.segments, "segments"), one(t.matching(FA.AnalyticsFilter(mode="REPLAY")).select("segment_id").distinct(), "with_replay"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    return out


_TIERS = {"sangat tinggi": "high", "tinggi": "high", "sedang": "medium", "rendah": "low", "sangat rendah": "low"}
_SEED = {
    "tier": "select camera_id, lower(json_extract_string(spatial_metadata, '$.priority_tier')) as tier from (select *, row_number() over (partition by camera_id order by segment_id) as rn from mappings where is_active) m join segment_metadata using (segment_id) where rn = 1",
    "prio": f"select c.*, coalesce(case tier {' '.join(f'''when '{k}' then '{v}' ''' for k, v in _TIERS.items())} end, 'medium') as priority from cameras c join tier using (camera_id) where c.data_source <> 'LIVE' and c.is_active",
}


@query(duck_with("cameras", "mappings", "segment_metadata", **_SEED) + f"select camera_id, priority, round({NOW} + (user_id * 7919 % 1000) / 1000.0 * case priority when 'high' then 30 when 'medium' then 60 else 300 end, 3) as next_at from prio")
def priority_seed(t):
    """A priority for each active camera that isn't live, by the tier of one mapped segment, and a first time spread over its interval."""
    from roadlake.operators.states import interval

    first = FA.first_of(t.mappings.where("is_active"), ["camera_id"], F.asc("segment_id")).select("camera_id", "segment_id").join(t.segment_metadata, "segment_id")
    tier = F.lower(F.get_json_object("spatial_metadata", "$.priority_tier"))
    priority = F.coalesce(F.create_map(*[F.lit(x) for p in _TIERS.items() for x in p])[tier], F.lit("medium"))
    df = t.cameras.where("data_source <> 'LIVE' AND is_active").join(first.select("camera_id", priority.alias("priority")), "camera_id")
    spread = F.col("user_id") * 7919 % 1000 / 1000.0 * interval(F.col("priority"), F.lit(None).cast("int"))
    return df.select("camera_id", "priority", F.round(F.lit(NOW) + spread, 3).alias("next_at"))


@query(duck_with("cameras", "mappings") + "select camera_id, segment_id from cameras c where is_active and not exists (select 1 from mappings m where m.camera_id = c.camera_id and m.segment_id = c.segment_id and m.is_active and m.valid_to is null)")
def mapping_seed(t):
    """Mappings that a seed would add: active cameras whose own segment has no open mapping of theirs."""
    open_ = t.mappings.where("is_active AND valid_to IS NULL").select("camera_id", "segment_id")
    return t.cameras.where("is_active").select("camera_id", "segment_id").join(open_, ["camera_id", "segment_id"], "left_anti")


_NEWEST = f"(select * from (select *, row_number() over ({_LATEST}) as rn from kept) where rn = 1) f"
_LIVE_V = f"select 0 as hour, {_HEX_COLUMNS} from {_NEWEST} join {_PRIMARY} using (segment_id) where {_ANY_V} group by h.hex_id"
_LIVE_SQL = _hex_sql(_LIVE_V, "select 0 as hour", f"select distinct 0 as hour, h.hex_id from {_NEWEST} join {_PRIMARY} using (segment_id)")
_CELL = "concat(cast(cast(floor(h.lon / 0.0101) as int) as varchar), ':', cast(cast(floor(h.lat / 0.0101) as int) as varchar))"
_LIVE_GRID = _LIVE_SQL + f", z as (select {_CELL} as cell, h.area, r.* exclude (area) from ranked r join hexes h using (hex_id)) select cell, count(*) as members, round(sum(area * score) / sum(area) filter (score is not null), 6) as score, case when bool_or(status = 'live') then 'live' when bool_or(status = 'fallback') then 'fallback' else 'no_data' end as status from z group by cell"


def live_scores(t) -> DataFrame:
    """Every cell's score, rank, class and status by the newest volumes of its segments."""
    lens = t.spark.range(1).select(F.lit(0).alias("lens"))
    volumes, mapped = hex_volumes(FA.latest(t.matching()).withColumn("lens", F.lit(0)), primary_cells(t), ["lens"])
    return SC.hour_scores(t.hexes, volumes, ["lens"], lens, mapped)


def best_status(status: Column) -> Column:
    """live if any is, else fallback if any is, else no_data."""
    order = F.max(F.when(status == "live", 3).when(status == "fallback", 2).otherwise(1))
    return F.element_at(F.array(F.lit("no_data"), F.lit("fallback"), F.lit("live")), order)


@query(_LIVE_GRID)
def live_grid(t):
    """The newest volumes' scores in larger cells: the best status of a cell's members, scores weighted by area."""
    df = live_scores(t)
    place = F.concat_ws(":", F.floor(F.col("lon") / 0.0101).cast("int"), F.floor(F.col("lat") / 0.0101).cast("int"))
    scored = F.when(F.col("score").isNotNull(), F.col("area"))
    return df.withColumn("cell", place).groupBy("cell").agg(F.count("*").alias("members"), F.round(F.sum(F.col("area") * F.col("score")) / F.sum(scored), 6).alias("score"), best_status(F.col("status")).alias("status"))


# ---- increments and lists

_RECONCILE = {
    "done": f"select segment_id, max(captured_at // {W6} * {W6}) as last_start from observations where captured_at < {NOW} - 10 * 86400 group by all",
    "win": f"select segment_id, captured_at // {W6} * {W6} as win, count(*) as n, max(id) as last_id from observations group by all",
    "next": "select w.segment_id, min(win) filter (win > last_start) as next_win, min(win) as first_win, any_value(last_start) as last_start from win w left join done using (segment_id) group by all",
    "begin": f"select segment_id, case when next_win >= coalesce(greatest(first_win, last_start - 12 * {W6}), first_win) + 120 * {W6} then next_win - 12 * {W6} else coalesce(greatest(first_win, last_start - 12 * {W6}), first_win) end as start from next",
}


@query(duck_with("observations", **_RECONCILE) + f"select segment_id, win as \"window\", n, last_id from win join begin using (segment_id) where win >= start and win < start + 120 * {W6}")
def reconcile_windows(t):
    """The windows that a pass reads again: at most 120 for each segment, from twelve before its last fact, or before the next observation after an outage."""
    o = t.observations.withColumn("window", S.bucket(F.col("captured_at"), W6))
    done = o.where(F.col("captured_at") < NOW - 10 * 86400).groupBy("segment_id").agg(F.max("window").alias("last_start"))
    return T.reconciliation(o.groupBy("segment_id", "window").agg(F.count("*").alias("n"), F.max("id").alias("last_id")), done, W6)


@query(duck_with("observations", d="select *, row_number() over (partition by camera_id, captured_at order by id desc) as twice from observations", r="select *, row_number() over (partition by camera_id order by captured_at desc) as rn from d where twice = 1") + "select camera_id, captured_at, id from r where rn <= 50")
def last_fifty(t):
    """The last fifty times of each camera, one observation each."""
    once = FA.first_of(t.observations.select("camera_id", "captured_at", "id"), ["camera_id", "captured_at"], F.desc("id"))
    rank = F.row_number().over(Window.partitionBy("camera_id").orderBy(F.desc("captured_at")))
    return once.withColumn("rank", rank).where("rank <= 50").drop("rank")


@query(duck_with("observations", s="select camera_id, captured_at // 86400 as day, sum(n) as seen, max(n) as peak, count(*) as cycles from observations group by all") + "select camera_id, count(*) as days, round(avg(seen), 6) as mean_seen, max(peak) as peak, cast(sum(cycles) as bigint) as cycles from s group by all")
def session_stats(t):
    """Mean and peak counts of each camera's days."""
    s = t.observations.groupBy("camera_id", F.floor(F.col("captured_at") / 86400).alias("day")).agg(F.sum("n").alias("seen"), F.max("n").alias("peak"), F.count("*").alias("cycles"))
    return s.groupBy("camera_id").agg(F.count("*").alias("days"), F.round(F.avg("seen"), 6).alias("mean_seen"), F.max("peak").alias("peak"), F.sum("cycles").alias("cycles"))


@query(duck_with("stops") + "select stop_id, ahp_score from stops order by ahp_score desc nulls last, stop_id limit 200")
def stop_list(t):
    """The list of stops: best scores first, those without last, 200 at most."""
    return t.stops.orderBy(F.desc_nulls_last("ahp_score"), "stop_id").limit(200).select("stop_id", "ahp_score")


@query(duck_with("pois") + "select poi_id, category from pois order by category, poi_id limit 500")
def poi_list(t):
    """The list of points of interest, 500 at most."""
    return t.pois.orderBy("category", "poi_id").limit(500).select("poi_id", "category")


@query(duck_with("cameras", "observations", l="select camera_id, arg_max(n, id) filter (semantics = 'interval_count') as live, arg_max(n, id) filter (semantics <> 'interval_count') as past from observations group by all") + "select camera_id, coalesce(case when data_source = 'LIVE' then live end, past) as shown, case when data_source = 'LIVE' and live is not null then 'live' when past is not null then 'historical' else 'none' end as origin from cameras left join l using (camera_id)")
def camera_values(t):
    """What a camera shows: its live value, else its last historical one."""
    counted = F.col("semantics") == "interval_count"
    l = t.observations.groupBy("camera_id").agg(F.max_by("n", F.when(counted, F.col("id"))).alias("live"), F.max_by("n", F.when(~counted, F.col("id"))).alias("past"))  # noqa: E741
    df = t.cameras.join(l, "camera_id", "left")
    live = F.when(F.col("data_source") == "LIVE", F.col("live"))
    origin = F.when(live.isNotNull(), "live").when(F.col("past").isNotNull(), "historical").otherwise("none")
    return df.select("camera_id", F.coalesce(live, F.col("past")).alias("shown"), origin.alias("origin"))


@query(duck_with("cameras") + "select camera_id, segment_id, stream_id, data_source from cameras where camera_id = 'cam-0007' and is_active")
def camera_lookup(t):
    """One active camera by id."""
    return t.cameras.where("camera_id = 'cam-0007' AND is_active").select("camera_id", "segment_id", "stream_id", "data_source").limit(1)
