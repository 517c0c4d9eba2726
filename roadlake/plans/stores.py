"""Tables that keep themselves up to date, snapshots, names, matches: queries that write and read back, with their SQL for DuckDB."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlake.functions import scalars as S
from roadlake.operators import facts as FA
from roadlake.operators import spatial as SP
from roadlake.operators import states as ST
from roadlake.operators import surveys as SV
from roadlake.plans.contexts import crossed_segments
from roadlake.plans.queries import _AGG, _CLIP, _SCHEDULE, KEPT, W6, duck_with, half_up, primary_cells, query
from roadlake.plans.questions import _NAMES, _named, _norm
from roadlake.schema import CATEGORIES
from roadlake.scratch import folder, path_of
from roadlake.sources.buckets import KeyedTable
from roadlake.sources.names import name_changes, name_contents
from roadlake.streaming.snapshots import snapshot_facts


def _table(t, name: str, keys: list[str], buckets: int = 8) -> KeyedTable:
    """A table in the scratch folder that goes with the application."""
    path = f"{folder(t.spark)}/roadlake/{name}-{uuid.uuid4().hex}"
    p, system = path_of(t.spark, path)
    system.deleteOnExit(p)
    return KeyedTable(t.spark, path, keys, buckets)


_KEY = ["segment_id", "period_start", "version"]
_UPSERT = "select *, row_number() over (partition by segment_id, period_start, version order by id % 3 desc, calculated_us desc, id desc) as rn from facts where id % 3 < 2 or segment_id < 'SEG-0010'"


@query(duck_with("facts", r=_UPSERT) + "select segment_id, period_start, version, id, calculated_us, co2_g_h from r where rn = 1")
def fact_upsert(t):
    """Facts written in three batches by (segment, period, version): later ones replace earlier ones, the last touches some buckets only and comes twice."""
    table, f = _table(t, "facts", _KEY), t.facts.select(*_KEY, "id", "calculated_us", "co2_g_h")
    for i in range(3):
        batch = f.where(F.col("id") % 3 == i) if i < 2 else f.where("id % 3 = 2 AND segment_id < 'SEG-0010'")
        table.upsert(batch, f"load:{i}", order=["calculated_us", "id"])
    table.upsert(batch, "load:2", order=["calculated_us", "id"])
    return table.read()


_STATE = "select *, row_number() over (partition by camera_id order by captured_at desc, arrival_us desc, id desc) as rn from observations"


@query(duck_with("observations", r=_STATE) + "select camera_id, captured_at as observed, arrival_us as processed, id, n from r where rn = 1")
def state_table(t):
    """Each camera's newest state, whatever the order in which batches bring them."""
    o = t.observations.select("camera_id", F.col("captured_at").alias("observed"), F.col("arrival_us").alias("processed"), "id", "n", "k")
    table = _table(t, "states", ["camera_id"])
    for i, some in enumerate(("k >= 60", "k < 30", "k >= 30 AND k < 60")):
        table.upsert(o.where(some).drop("k"), f"states:{i}", newest=["observed", "processed", "id"])
    return table.read()


_SNAP = {k: v.replace("from observations", "from (select * from observations where semantics = 'snapshot_occupancy') observations") for k, v in _AGG.items()}
_HAS_ROI, _PRIORITY = "user_id % 3 <> 0", "case user_id % 4 when 0 then 'high' when 1 then 'low' end"
_ABOUT = {
    "about": f"select segment_id, win, bool_and({_HAS_ROI}) as calibrated, case when count(distinct coalesce({_PRIORITY}, 'medium')) > 1 then 'mixed' else min(coalesce({_PRIORITY}, 'medium')) end as priority, string_agg(distinct camera_id, ',' order by camera_id) as cameras from picked group by all",
    "lost": "select segment_id, win, string_agg(concat(stream_id, '=', cams), ';' order by stream_id) as dropped from (select segment_id, win, stream_id, string_agg(distinct camera_id, ',' order by camera_id) as cams from best where not exists (select 1 from picked p where p.segment_id = best.segment_id and p.win = best.win and p.stream_id = best.stream_id and p.camera_id = best.camera_id) group by all) group by all",
}
_VKT = ", ".join(f"{half_up(f'{c}_veh_h * length_km', 4)} as {c}_vkt" for c in CATEGORIES)


@query(
    duck_with("observations", "segments", **_SNAP, **_ABOUT)
    + f"select segment_id, win as period_start, 4 as version, 'SNAPSHOT_REAL' as source_mode, {', '.join(f'{c}_raw' for c in CATEGORIES)}, {_VKT}, case when calibrated then 'calibrated' else 'uncalibrated' end as roi_status, case when dropped is not null then 'duplicate_stream_camera_deduped' end as selection_note, dropped, priority, cameras, observations from agg join segments using (segment_id) join about using (segment_id, win) left join lost using (segment_id, win)"
)
def snapshot_emissions(t):
    """Facts of snapshots: the newest camera of each stream, what was dropped, regions of interest, priorities."""
    o = t.observations.where("semantics = 'snapshot_occupancy'").withColumn("has_roi", F.expr(_HAS_ROI)).withColumn("priority", F.expr(_PRIORITY))
    f = snapshot_facts(o, t.segments, W6)
    m = F.col("calculation_metadata")
    dropped = F.array_join(F.transform(F.sort_array(F.map_entries(m["dropped_cameras"])), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";")
    return f.select(
        "segment_id", "period_start", "version", "source_mode", *[f"{c}_raw" for c in CATEGORIES], *[S.half_up(F.col(f"{c}_vkt"), 4).alias(f"{c}_vkt") for c in CATEGORIES], m["roi_status"].alias("roi_status"),
        m["selection_note"].alias("selection_note"), dropped.alias("dropped"), "priority", F.array_join("provenance.source_cameras", ",").alias("cameras"), F.col("provenance.source_observation_count").alias("observations"),
    )


_CONTENT = f"select key, name, n, trim(concat(name, case key when 'jalan malioboro' then ' malioboro' when 'yogyakarta' then ' jogja' when 'universitas gadjah mada' then ' ugm' else '' end)) as content from (select {_norm('segment_name')} as key, arg_min(segment_name, segment_id) as name, count(*) as n from ({_NAMES}) group by 1) where key <> ''"


@query(
    duck_with("segments", c=_CONTENT, stored="select key, case when n > 1 then content else concat('old ', content) end as content from c where length(key) % 3 <> 0 union all select 'jalan lama', 'Jalan Lama'")
    + "select coalesce(c.key, stored.key) as name_key, case when c.key is null then 'gone' when stored.key is null then 'new' when sha256(c.content) = sha256(stored.content) then 'same' else 'changed' end as change, sha256(c.content) as content_hash from c full join stored on c.key = stored.key"
)
def name_backfill(t):
    """Which names need a vector again, against a store that lacks some, has old contents of others, and one name too many."""
    own = name_contents(_named(t))
    kept = own.where(F.length("name_key") % 3 != 0)
    content = F.when(F.size("segment_ids") > 1, F.col("content")).otherwise(F.concat(F.lit("old "), "content"))
    stored = kept.select("name_key", F.sha2(content, 256).alias("content_hash")).unionByName(t.spark.range(1).select(F.lit("jalan lama").alias("name_key"), F.sha2(F.lit("Jalan Lama"), 256).alias("content_hash")))
    table = _table(t, "names", ["name_key"])
    table.upsert(stored)
    return name_changes(_named(t), table.read()).select("name_key", "change", "content_hash")


@query(duck_with("cameras", "mappings", "segments") + "select c.camera_id, m.stream_id, s.segment_id, s.segment_name, s.length_km, c.data_source from cameras c join mappings m using (camera_id) join segments s on s.segment_id = m.segment_id where c.is_active and m.is_active and m.valid_to is null")
def active_mappings(t):
    """Active cameras with their open mappings and the mapped segments."""
    m = t.mappings.where("is_active AND valid_to IS NULL").select("camera_id", "stream_id", "segment_id")
    c = t.cameras.where("is_active").select("camera_id", "data_source")
    return c.join(m, "camera_id").join(t.segments.select("segment_id", "segment_name", "length_km"), "segment_id")


_SOURCES = """select s_suppkey as source_id, case when s_suppkey % 9 <> 0 then cast(110.34 + 0.00137 * (s_suppkey % 37) + 0.0001 * (s_suppkey % 5) as double) end as lon, case when s_suppkey % 9 <> 0 then cast(-7.83 + 0.00211 * (s_suppkey % 23) as double) end as lat,
concat(' HALTE  ', cast((s_suppkey * 7) % 60 as {text}), ' ') as title from supplier"""
_SPOTS = "select stop_id, title, case when stop_id % 11 <> 0 then lon end as lon, lat from stops"
_METRES = "2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(p.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(p.lat)) * pow(sin(radians(p.lon - s.lon) / 2), 2))))"
_MATCH = {
    "sources": _SOURCES.format(text="varchar"), "spots": _SPOTS,
    "near": f"select s.stop_id, p.source_id, {_METRES} as d from spots s join sources p on {_METRES} <= 25",
    "placed": "select stop_id, arg_min(source_id, (d, source_id)) as source_id, round(min(d), 3) as d, count(*) > 1 as several from near group by stop_id",
    "titled": "select t, max(source_id) as source_id from (select *, trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) as t from sources) group by t",
    "rest": "select min(s.stop_id) as stop_id, t.source_id from spots s join titled t on t.t = trim(regexp_replace(lower(s.title), '\\s+', ' ', 'g')) where s.stop_id not in (select stop_id from placed) and t.source_id not in (select source_id from placed) group by t.source_id",
    "m": "select s.stop_id, coalesce(p.source_id, r.source_id) as source_id, p.d as distance_m, case when p.source_id is not null then 'coordinates' when r.source_id is not null then 'title' end as method, coalesce(several, false) as ambiguous, case when p.source_id is null and r.source_id is null then case when s.lon is null then 'no_coordinates' else 'beyond_tolerance' end end as reason from spots s left join placed p using (stop_id) left join rest r using (stop_id)",
}


def _places(t) -> tuple[DataFrame, DataFrame]:
    sources = t.spark.sql(_SOURCES.format(text="string").replace("from supplier", "from {supplier}"), supplier=t.supplier)
    return t.stops.select("stop_id", "title", F.when(F.col("stop_id") % 11 != 0, F.col("lon")).alias("lon"), "lat"), sources


@query(duck_with("stops", **_MATCH) + "select * from m")
def survey_match(t):
    """Stops with their surveyed places: the nearest within 25 m, else by title."""
    return SV.matched_places(*_places(t))


@query(duck_with("stops", **_MATCH) + "select count(*) as stops, count(method) as matched, count(*) filter (method = 'coordinates') as by_coordinates, count(*) filter (method = 'title') as by_title, count(*) filter (ambiguous) as ambiguous, count(*) filter (reason = 'beyond_tolerance') as beyond_tolerance, count(*) filter (reason = 'no_coordinates') as no_coordinates, (select count(*) from sources where source_id not in (select source_id from m where source_id is not null)) as unmatched_sources, (select count(*) from sources) as sources from m")
def survey_match_report(t):
    stops, sources = _places(t)
    return SV.match_report(SV.matched_places(stops, sources), sources)


_CAMERA_AT = "c.camera_id, s.lon1 + 0.0003 * (c.user_id % 7) as lon, s.lat1 + 0.0002 * (c.user_id % 11) as lat, c.user_id % 3 = 0 as has_value"
_KM = "2 * 6371.0 * asin(least(1.0, sqrt(pow(sin(radians(o.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(o.lat)) * pow(sin(radians(o.lon - c.lon) / 2), 2))))"
_SCALE = 0.990743  # of a degree of longitude around the city


@query(duck_with("cameras", "segments", spots=f"select {_CAMERA_AT} from cameras c join segments s using (segment_id)", r=f"select c.camera_id, o.camera_id as neighbour, {_KM} as km, row_number() over (partition by c.camera_id order by pow(c.lon * {_SCALE} - o.lon * {_SCALE}, 2) + pow(c.lat - o.lat, 2), o.camera_id) as rn from spots c join spots o on o.has_value and not c.has_value") + "select camera_id, neighbour, round(km, 6) as distance_km from r where rn = 1")
def camera_estimate(t):
    """For each camera without a value of its own the nearest one that has a value, on the plane around the city, with the distance on the sphere."""
    c = t.cameras.join(t.segments.select("segment_id", "lon1", "lat1"), "segment_id")
    at = c.select("camera_id", (F.col("lon1") + 0.0003 * (F.col("user_id") % 7)).alias("x"), (F.col("lat1") + 0.0002 * (F.col("user_id") % 11)).alias("lat"), (F.col("user_id") % 3 == 0).alias("has_value"))
    flat = at.withColumn("lon", F.col("x") * _SCALE)
    known = flat.where("has_value").select(F.col("camera_id").alias("neighbour"), F.col("lon").alias("lon_r"), F.col("lat").alias("lat_r"), F.col("x").alias("xr"), F.col("lat").alias("yr"))
    near = SP.nearest(flat.where("NOT has_value"), known, ["camera_id"], "neighbour", carry=["xr", "yr"]).join(at.select("camera_id", "x", "lat"), "camera_id")
    return near.select("camera_id", "neighbour", F.round(S.haversine_m(F.col("x"), F.col("lat"), F.col("xr"), F.col("yr")) / 1000, 6).alias("distance_km"))


@query(duck_with("facts") + f"select cast(count(*) as bigint) as messages, count(*) filter (k < 95) as valid from facts")
def valid_messages(t):
    """How many messages hold finite or missing rates only; some rates are made infinite or no number."""
    from roadlake.operators.records import valid_messages as fine

    bad = F.when(F.col("k") >= 98, float("inf")).when(F.col("k") >= 95, float("nan")).otherwise(F.col("co2_g_h"))
    df = t.facts.withColumn("co2_g_h", bad)
    return df.agg(F.count("*").alias("messages"), F.count_if(fine(df)).alias("valid"))




# ---- what is covered and what is not


_SEATS = "select c.camera_id, s.lon1 + 0.0003 * (c.user_id % 7) as lon, s.lat1 + 0.0002 * (c.user_id % 11) as lat from cameras c join segments s using (segment_id)"
_COVER = {
    **_CLIP,
    "open_": "select distinct camera_id, segment_id from mappings where is_active and valid_to is null",
    "prime": "select segment_id, hex_id from (select *, row_number() over (partition by segment_id order by round(overlap, 9) desc, hex_id) as rn from o) where rn = 1",
    "seats": _SEATS,
    "sits": "select camera_id, min(hex_id) as hex_id from seats p join hexes h on p.lon >= h.lon - 0.001 and p.lon < h.lon + 0.001 and p.lat >= h.lat - 0.001 and p.lat < h.lat + 0.001 group by all",
}


@query(
    duck_with("cameras", "mappings", "segments", "hexes", "facts", kept=KEPT, **_COVER)
    + """select 'unmapped_camera' as kind, camera_id as id, null::varchar as segment_id, null::bigint as sits_in, null::bigint as feeds from cameras where is_active and camera_id not in (select camera_id from open_)
union all select 'off_primary', camera_id, segment_id, sits.hex_id, prime.hex_id from open_ join sits using (camera_id) join prime using (segment_id) where sits.hex_id <> prime.hex_id
union all select 'segment_without_replay', segment_id, segment_id, null, null from segments where segment_id not in (select segment_id from kept where source_mode = 'REPLAY')
union all select 'cell_without_segment', hex_id::varchar, null, hex_id, null from hexes where hex_id not in (select hex_id from o)"""
)
def coverage_sets(t):
    """What is not covered: active cameras without an open mapping, cameras that feed another cell than they sit in, segments without replays, cells without segments."""
    open_ = t.mappings.where("is_active AND valid_to IS NULL").select("camera_id", "segment_id").distinct()
    c = t.cameras.join(t.segments.select("segment_id", "lon1", "lat1"), "segment_id")
    seats = c.select("camera_id", (F.col("lon1") + 0.0003 * (F.col("user_id") % 7)).alias("px"), (F.col("lat1") + 0.0002 * (F.col("user_id") % 11)).alias("py"))
    h = SP.box_cells(t.hexes.select("hex_id", "lon", "lat"), 0.001, 0.004).select("hex_id", "_x", "_y", SP.square(F.col("lon"), F.col("lat"), 0.001).alias("ring"))
    at = seats.withColumn("_x", F.floor(F.col("px") / 0.004)).withColumn("_y", F.floor(F.col("py") / 0.004))
    sits = at.join(h, ["_x", "_y"]).where(SP.in_ring(F.col("px"), F.col("py"), F.col("ring"))).groupBy("camera_id").agg(F.min("hex_id").alias("sits_in"))
    feeds = primary_cells(t).withColumnRenamed("hex_id", "feeds")
    row = lambda df, kind, id_, segment=None, sits_in=None, feeds=None: df.select(F.lit(kind).alias("kind"), F.col(id_).cast("string").alias("id"), *[(F.col(c) if c else F.lit(None)).cast(k).alias(n) for c, k, n in ((segment, "string", "segment_id"), (sits_in, "long", "sits_in"), (feeds, "long", "feeds"))])
    unmapped = t.cameras.where("is_active").join(open_, "camera_id", "left_anti")
    off = open_.join(sits, "camera_id").join(feeds, "segment_id").where("sits_in <> feeds")
    silent = t.segments.join(t.matching(FA.AnalyticsFilter(mode="REPLAY")).select("segment_id").distinct(), "segment_id", "left_anti")
    empty = t.hexes.join(crossed_segments(t).select("hex_id").distinct(), "hex_id", "left_anti")
    parts = [row(unmapped, "unmapped_camera", "camera_id"), row(off, "off_primary", "camera_id", "segment_id", "sits_in", "feeds"), row(silent, "segment_without_replay", "segment_id", "segment_id"), row(empty, "cell_without_segment", "hex_id", None, "hex_id")]
    return reduce(DataFrame.unionByName, parts)


@query(duck_with("cameras", s=_SCHEDULE, d="select camera_id from s where next_at is null or next_at <= 500 order by next_at nulls first, camera_id limit 40") + "select camera_id, case when d.camera_id is not null then 500 + coalesce(override, case priority when 'high' then 30 when 'medium' then 60 else 300 end) else next_at end as next_at from s left join d using (camera_id)")
def claim_reschedule(t):
    """All cameras after a claim of those that are due, forty at most: each claimed one has its next time."""
    c = t.spark.sql(_SCHEDULE.replace("from cameras", "from {cameras}"), cameras=t.cameras)
    return ST.rescheduled(c, ST.due(c, 500, 40), 500).select("camera_id", F.col("next_at").cast("long").alias("next_at"))
