"""Named queries of single objects in full: the city's totals, replay series, cells, stops, imported surveys. Each has its SQL for DuckDB beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlake.functions import scalars as S
from roadlake.operators import facts as FA
from roadlake.operators import profile as P
from roadlake.operators import records as R
from roadlake.operators import scoring as SC
from roadlake.operators import traffic as T
from roadlake.plans.contexts import _LIVE_SQL, live_scores
from roadlake.plans.contexts import hex_corridors as _corridors
from roadlake.plans.queries import _CLASS, _FUEL_COLS, _MEANS, ANCHOR, _snapshots, duck_with, facts_sql, query
from roadlake.schema import CATEGORIES, POLLUTANTS

# ---- the city

RATES = [(f"{p}_{u}", digits) for p in POLLUTANTS for u, digits in (("g_min", 2), ("kg_h", 4))]
CITY_NOW, FRESH, AGING = 1706659200, 1800, 7200
_AGE = f"greatest(0, {CITY_NOW} - last_captured_at)"
_NOW_AGE = f"greatest(0, {CITY_NOW} - max(last_captured_at))"


@query(
    duck_with(
        "cameras", "observations", snaps=_snapshots(86400), means=_MEANS, em=f"select *, {_FUEL_COLS} from means",
        last="select * from (select *, row_number() over (partition by camera_id order by \"window\" desc) as rn from em) where rn = 1",
    )
    + f"""select count(*) filter (is_active) as cameras, count(*) filter (is_active and data_source = 'LIVE') as live, count(*) filter (is_active and data_source <> 'LIVE') as historical,
count(*) filter (is_active and {_AGE} <= {FRESH}) as fresh, count(*) filter (is_active and {_AGE} > {AGING}) as stale, max(last_captured_at) as last_captured_at,
case when {_NOW_AGE} <= {FRESH} then 'fresh' when {_NOW_AGE} <= {AGING} then 'aging' else 'stale' end as freshness_status,
{', '.join(f'round(coalesce(sum({c}), 0), {n}) as {c}' for c, n in RATES)}, {', '.join(f'round(coalesce(sum({c}), 0), 4) as {c}' for c in CATEGORIES)}
from cameras full join last using (camera_id)"""
)
def city_totals(t):
    """All rates and vehicles of every camera's newest window, added up, with how many of the active cameras are live, fresh and stale."""
    newest = FA.first_of(T.window_means(t.observations, 86400), ["camera_id"], F.desc("window"))
    return T.city_totals(t.cameras, newest, RATES + [(c, 4) for c in CATEGORIES], CITY_NOW, FRESH, AGING)


# ---- replays

#: Name of a series, its column of the facts and what it is divided by.
SERIES = [(f"{p}_kg_h", f"{p}_g_h", 1000.0) for p in POLLUTANTS] + [(c, c, 1.0) for v in CATEGORIES for c in (f"{v}_veh_h", f"{v}_vkt")]
_REPLAY = {
    "hours": f"select segment_id, period_start as hour, {', '.join(f'avg({c} / {by}) as {k}' for k, c, by in SERIES)}, count(*) as samples, max(period_end) as observed_at from samples where period_start between {ANCHOR - 86400 + 1} and {ANCHOR} group by all",
    "grid": f"select segment_id, i, {ANCHOR} - (23 - i) * 3600 as hour from (select distinct segment_id from hours) cross join (select unnest(range(24)) as i)",
    "dense": "select grid.*, hours.* exclude (segment_id, hour), samples is not null as present from grid left join hours using (segment_id, hour)",
    "plan": "select *, max(case when present then i end) over (partition by segment_id order by i) as lft, min(case when present then i end) over (partition by segment_id order by i rows between current row and unbounded following) as rgt from dense",
}


def _between(v: str) -> str:
    line = f"when l.{v} is null then r.{v} when r.{v} is null then l.{v} else l.{v} + (r.{v} - l.{v}) * (p.i - lft) / (rgt - lft)"
    return f"round(case when p.present then p.{v} when lft is null then r.{v} when rgt is null then l.{v} {line} end, 6) as {v}"


@query(
    facts_sql(extra=_REPLAY)
    + f"""select p.segment_id, p.hour, {', '.join(_between(k) for k, _, _ in SERIES)}, coalesce(p.samples, 0) as samples, p.observed_at, not p.present as is_interpolated,
case when p.present then null when lft is not null and rgt is not null then 'linear' when lft is not null then 'forward_fill' else 'backward_fill' end as method
from plan p left join dense l on l.segment_id = p.segment_id and l.i = lft left join dense r on r.segment_id = p.segment_id and r.i = rgt"""
)
def replay_series(t):
    """A day of hourly means of every series of each segment: eight rates, volumes and kilometres by category; filled hours say how."""
    means = [F.avg(F.col(c) / by).alias(k) for k, c, by in SERIES]
    day = t.samples(start=ANCHOR - 86400 + 1, end=ANCHOR + 1)
    hours = day.groupBy("segment_id", F.col("period_start").alias("hour")).agg(*means, F.count("*").alias("samples"), F.max("period_end").alias("observed_at"))
    df = P.filled(P.densified(hours, ["segment_id"], ANCHOR), ["segment_id"], [k for k, _, _ in SERIES])
    return df.select("segment_id", "hour", *[F.round(k, 6).alias(k) for k, _, _ in SERIES], F.coalesce("samples", F.lit(0)).alias("samples"), "observed_at", (~F.col("present")).alias("is_interpolated"), "method")


# ---- cells and stops

_STATIC = {
    "range_": "select min(volume_mean) as low, max(volume_mean) as high from hexes",
    "plain": f"select hex_id, {SC.CELL_WEIGHTS['volume']} * (case when high <= low then 100.0 else 1.0 + (volume_mean - low) / (high - low) * 99.0 end) + {SC.CELL_WEIGHTS['poi']} * norm_poi + {SC.CELL_WEIGHTS['population']} * norm_population as static_score from hexes cross join range_ where volume_mean is not null",
    "placed": "select *, row_number() over (order by static_score desc, hex_id) as static_rank, count(*) over () as n from plain",
    "crossed": "select hex_id, string_agg(segment_name, '|' order by segment_name) as corridors from (select *, row_number() over (partition by hex_id order by segment_name) as rn from (select distinct hex_id, segment_name from o join segments using (segment_id))) where rn <= 3 group by all",
}


@query(
    _LIVE_SQL
    + "".join(f", {k} as ({v})" for k, v in _STATIC.items())
    + f""" select h.hex_id, h.poi_total, h.area, round(static_score, 6) as static_score, cast(static_rank as int) as static_rank, case when static_rank is not null then {_CLASS.format(r='static_rank', n='n')} end as static_class,
round(r.score, 6) as score, cast(r.rank as int) as rank, case when r.rank is not null then {_CLASS.format(r='r.rank', n='r.total')} end as class, r.status as data_status, r.source as fallback_from, corridors
from hexes h left join placed using (hex_id) join ranked r on r.hex_id = h.hex_id left join crossed on crossed.hex_id = h.hex_id"""
)
def hex_context(t):
    """What is known of each cell: its standing score beside the one that the newest volumes give, and the corridors across it."""
    cells = t.hexes
    spread = cells.agg(F.min("volume_mean").alias("low"), F.max("volume_mean").alias("high"))  # one row
    norm = S.min_max_100(F.col("volume_mean"), F.col("low"), F.col("high"))
    plain = cells.where("volume_mean IS NOT NULL").crossJoin(F.broadcast(spread)).select("hex_id", SC.cell_score(norm, F.col("norm_poi"), F.col("norm_population")).alias("static_score"))
    placed = SC.classed(SC.with_total(SC.ranked(plain, "static_score", "hex_id", True, "static_rank")), "static_rank")
    placed = placed.select("hex_id", F.round("static_score", 6).alias("static_score"), F.col("static_rank").cast("int").alias("static_rank"), F.col("class").alias("static_class"))
    now = live_scores(t).select("hex_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"), "class", F.col("status").alias("data_status"), F.when(F.col("status") != "live", F.col("source_id")).alias("fallback_from"))
    corridors = _corridors(t).withColumnRenamed("names", "corridors")
    return cells.select("hex_id", "poi_total", "area").join(placed, "hex_id", "left").join(now, "hex_id").join(corridors, "hex_id", "left")


# ---- imported surveys: every other stop has one, some have two, some surveys belong to no stop

METHOD = "survey-ahp-v1"
_SURVEYS = """select case when s_suppkey % 11 = 0 then s_suppkey + 1 else s_suppkey * 2 end as stop_id, s_suppkey as survey_id, cast(s_nationkey % 10 * 10 as double) as accessibility_score, case when s_suppkey % 7 <> 0 then floor(abs(s_acctbal)) % 101 end as ahp_score from supplier"""
_IMPORT = {
    "surveys": _SURVEYS,
    "newest": "select * from (select *, row_number() over (partition by stop_id order by survey_id desc) as rn from surveys) where rn = 1",
}


def _imported(t) -> tuple[DataFrame, DataFrame]:
    surveys = t.supplier.select(
        F.when(F.col("s_suppkey") % 11 == 0, F.col("s_suppkey") + 1).otherwise(F.col("s_suppkey") * 2).alias("stop_id"), F.col("s_suppkey").alias("survey_id"),
        (F.col("s_nationkey") % 10 * 10).cast("double").alias("accessibility_score"), F.when(F.col("s_suppkey") % 7 != 0, F.floor(F.abs("s_acctbal")) % 101).cast("double").alias("ahp_score"),
    )
    return R.import_survey(t.stops.select("stop_id", "ahp_score"), surveys, "stop_id", ["survey_id"], ["ahp_score", "accessibility_score"], METHOD)


@query(duck_with("stops", **_IMPORT) + f"select stop_id, round(case when n.stop_id is not null then n.ahp_score else s.ahp_score end, 6) as ahp_score, accessibility_score, case when n.stop_id is not null then '{METHOD}' end as score_method from stops s left join newest n using (stop_id)")
def survey_import(t):
    """The stops after the import of their newest surveys."""
    return _imported(t)[0].select("stop_id", F.round("ahp_score", 6).alias("ahp_score"), "accessibility_score", "score_method")


@query(duck_with("stops", **_IMPORT) + "select stop_id, survey_id from surveys where stop_id not in (select stop_id from stops)")
def survey_unmatched(t):
    """Surveys that belong to no stop."""
    return _imported(t)[1].select("stop_id", "survey_id")
