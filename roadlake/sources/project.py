"""The driver's tables as tables of the domain. One text for both engines; $-words stand for what their dialects say apart."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPARK = {"$K": "cast(get_json_object(props, '$.k') as int)", "$US": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))", "$DIV": "div", "$DOUBLE": "double", "$STRING": "string"}
DUCK = {"$K": "cast(json_extract_string(props, '$.k') as int)", "$US": "epoch_us(ts)", "$DIV": "//", "$DOUBLE": "double", "$STRING": "varchar"}

_POLLUTANTS = ", ".join(f"case when (event_id + {i}) % 7 <> 0 then value * {(i + 1) * 10} end as {p}_g_h" for i, p in enumerate(("tsp", "nox", "so2", "hc", "co", "co2", "ch4", "n2o")))
_VOLUMES = ", ".join(f"case when event_id % 11 <> {j} then value * {j + 1} end as {c}_veh_h" for j, c in enumerate(("car", "motorcycle", "bus", "truck")))
_VKT = ", ".join(f"case when event_id % 11 <> {j} then value * {j + 1} * (0.5 + 0.1 * ((user_id % 25) % 10)) end as {c}_vkt" for j, c in enumerate(("car", "motorcycle", "bus", "truck")))

TABLES = {
    "segments": (
        ("nation", "region"),
        """select concat('SEG-', lpad(cast(n_nationkey as $STRING), 4, '0')) as segment_id, n_name as segment_name,
        case when n_nationkey < 20 then concat('COR-', cast(r_regionkey as $STRING)) else concat('SEG-', lpad(cast(n_nationkey as $STRING), 4, '0')) end as corridor_id,
        case when n_nationkey < 20 then r_name else n_name end as corridor_name,
        cast(0.5 + 0.1 * (n_nationkey % 10) as $DOUBLE) as length_km,
        cast(110.34 + 0.01 * (n_nationkey % 5) as $DOUBLE) as lon1, cast(-7.83 + 0.01 * (n_nationkey $DIV 5) as $DOUBLE) as lat1,
        cast(110.34 + 0.01 * (n_nationkey % 5) + 0.006 as $DOUBLE) as lon2, cast(-7.83 + 0.01 * (n_nationkey $DIV 5) + 0.003 as $DOUBLE) as lat2
        from {nation} join {region} on n_regionkey = r_regionkey""",
    ),
    "cameras": (
        ("events",),
        """select concat('cam-', lpad(cast(user_id as $STRING), 4, '0')) as camera_id, user_id, concat('SEG-', lpad(cast(user_id % 25 as $STRING), 4, '0')) as segment_id,
        concat('st-', cast((user_id $DIV 25) % 2 as $STRING)) as stream_id, user_id % 25 < 20 as is_active, case when user_id % 10 < 3 then 'LIVE' else 'REPLAY' end as data_source
        from (select distinct user_id from {events}) u""",
    ),
    "mappings": (
        ("cameras",),
        """select camera_id, segment_id, stream_id, cast(null as bigint) as valid_from, cast(1705363200 as bigint) as valid_to, user_id % 13 <> 5 as is_active from {cameras}
        union all select camera_id, case when user_id % 7 = 0 then concat('SEG-', lpad(cast((user_id + 1) % 25 as $STRING), 4, '0')) else segment_id end, stream_id, cast(1705363200 as bigint), cast(null as bigint), user_id % 17 <> 3 from {cameras}""",
    ),
    "facts": (
        ("events",),
        f"""select event_id as id, concat('SEG-', lpad(cast(user_id % 25 as $STRING), 4, '0')) as segment_id,
        us $DIV 3600000000 * 3600 as period_start, us $DIV 3600000000 * 3600 + 3600 as period_end, us as calculated_us, 1 + k % 3 as version,
        case when user_id % 25 >= 22 or k % 10 = 0 then 'SYNTHETIC' when k % 10 in (3, 4) then 'REPLAY' when k % 10 = 5 then 'CSV_HISTORY' end as meta_source_mode,
        case when k % 10 = 1 then 'HISTORICAL' when k % 10 >= 6 then 'LIVE' end as meta_data_source,
        case k % 4 when 0 then 'snapshot_occupancy' when 1 then null else 'interval_count' end as semantics, k,
        {_POLLUTANTS}, {_VOLUMES}, {_VKT}
        from (select *, $K as k, $US as us from {{events}}) e""",
    ),
    "raw_facts": (
        ("events",),
        """select event_id as id, concat('SEG-', lpad(cast(user_id % 25 as $STRING), 4, '0')) as segment_id, k,
        concat('{{', concat_ws(', ', case when event_id % 7 <> 0 then concat('"co2": ', cast(value * 60 as $STRING)) end, case when event_id % 5 <> 0 then concat('"nox": ', cast(value * 20 as $STRING)) end), '}}') as totals,
        concat('{{', concat_ws(', ', case when k % 5 = 0 then concat('"observed_at": ', cast(us $DIV 1000000 as $STRING)) end, case when k % 9 = 0 then '"calculation_mode": "replay"' end,
        case when k % 3 = 0 then concat('"calculation_metadata": {{"is_interpolated": ', case when k % 2 = 0 then 'true' else 'false' end, ', "interpolation_method": "linear"}}') end), '}}') as meta
        from (select *, $K as k, $US as us from {events}) e""",
    ),
    "segment_metadata": (
        ("nation",),
        """select concat('SEG-', lpad(cast(n_nationkey as $STRING), 4, '0')) as segment_id, n_name as segment_name,
        case when n_nationkey % 3 <> 0 then concat('{{"corridor_id": "COR-', cast(n_regionkey as $STRING), '", "priority_tier": "', case n_nationkey % 5 when 0 then 'Sangat Tinggi' when 1 then 'Tinggi' when 2 then 'Sedang' when 3 then 'Rendah' else 'none' end, '"}}') end as spatial_metadata
        from {nation}""",
    ),
    "observations": (
        ("events",),
        """select event_id as id, concat('cam-', lpad(cast(user_id as $STRING), 4, '0')) as camera_id, concat('SEG-', lpad(cast(user_id % 25 as $STRING), 4, '0')) as segment_id,
        concat('st-', cast((user_id $DIV 25) % 2 as $STRING)) as stream_id, us as captured_us, us $DIV 1000000 as captured_at, cast(60 * (1 + k % 3) as $DOUBLE) as duration,
        case when k < 50 then 'interval_count' when k < 90 then 'snapshot_occupancy' else 'vehicles_per_hour' end as semantics,
        case event_type when 'view' then 'car' when 'click' then 'motorcycle' when 'purchase' then 'bus' when 'signup' then 'truck' end as category, value as n, k, user_id,
        case when event_id % 50 = 0 then us + 7200000000 else us end as arrival_us
        from (select *, $K as k, $US as us from {events}) e""",
    ),
    "hexes": (
        ("part",),
        """select p_partkey as hex_id, cast(110.34 + 0.002 * (p_partkey % 50) as $DOUBLE) as lon, cast(-7.83 + 0.002 * (p_partkey $DIV 50) as $DOUBLE) as lat,
        cast(1 + 99e0 * (p_size - 1) / 49 as $DOUBLE) as norm_poi, cast(1 + 99e0 * (p_partkey % 97) / 96 as $DOUBLE) as norm_population,
        case when p_partkey % 17 <> 0 then p_retailprice end as volume_mean, cast(0.01 * (1 + p_partkey % 5) as $DOUBLE) as area, p_size as poi_total, cast(100 + p_partkey % 50 * 10 as bigint) as population
        from {part}""",
    ),
    "stops": (
        ("supplier",),
        """select s_suppkey as stop_id, cast(110.34 + 0.00137 * (s_suppkey % 37) as $DOUBLE) as lon, cast(-7.83 + 0.00211 * (s_suppkey % 23) as $DOUBLE) as lat,
        case when s_suppkey % 3 <> 0 then abs(s_acctbal) % 100 end as ahp_score, case when s_suppkey % 4 <> 0 then 1 + s_suppkey % 5 end as facility, 1 + s_nationkey % 5 as environment,
        concat('Halte ', cast(s_suppkey % 40 as $STRING)) as title, case s_suppkey % 6 when 1 then 'Sangat Tinggi' when 2 then 'Tinggi' when 3 then 'Sedang' when 4 then 'Rendah' when 5 then 'Sangat Rendah' end as intervention_class
        from {supplier}""",
    ),
    "vertices": (
        ("segments",),
        """select segment_id, i, cast(lon1 + (lon2 - lon1) * i / 4e0 * (1 + length_km) + 0.0011 * (i % 2) as $DOUBLE) as lon, cast(lat1 + (lat2 - lat1) * i / 4e0 - 0.0007 * (i % 3) as $DOUBLE) as lat
        from {segments} cross join (select 0 as i union all select 1 union all select 2 union all select 3 union all select 4) v""",
    ),
    "pois": (
        ("customer",),
        """select c_custkey as poi_id, cast(110.34 + 0.00091 * (c_custkey % 61) as $DOUBLE) as lon, cast(-7.83 + 0.00173 * (c_custkey % 29) as $DOUBLE) as lat,
        c_mktsegment as category from {customer}""",
    ),
    "frames": (
        ("events",),
        """select user_id as camera, day, event_id % 8 as track_id, row_number() over (partition by user_id, day order by us, event_id) as frame_no, k < 70 as inside,
        case event_type when 'view' then 'car' when 'click' then 'motorcycle' when 'purchase' then 'bus' when 'signup' then 'truck' end as category, us
        from (select *, $K as k, $US as us, $US $DIV 86400000000 as day from {events}) e""",
    ),
}


def dialect(text: str, words: dict[str, str]) -> str:
    for k, v in words.items():
        text = text.replace(k, v)
    return text


def table(spark: SparkSession, sf_dir: str, name: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """A table of the domain, or one of the driver's. A range of times (epoch seconds) is a filter of the events' own column, which reaches the scan."""
    if name not in TABLES:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "events" and start is not None:
            df = df.where(F.col("ts") >= F.lit(datetime.fromtimestamp(start, UTC).replace(tzinfo=None)).cast(df.schema["ts"].dataType))
        if name == "events" and end is not None:
            df = df.where(F.col("ts") < F.lit(datetime.fromtimestamp(end, UTC).replace(tzinfo=None)).cast(df.schema["ts"].dataType))
        return df
    needs, text = TABLES[name]
    return spark.sql(dialect(text, SPARK), **{t: table(spark, sf_dir, t, start, end) for t in needs})


def duck_with(*names: str, **more: str) -> str:
    """A WITH clause for DuckDB that defines these tables, and then more common table expressions."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done or name not in TABLES:
            return
        needs, text = TABLES[name]
        for t in needs:
            add(t)
        done[name] = dialect(text, DUCK).format(**{t: t for t in needs})

    for n in names:
        add(n)
    return "with " + ", ".join(f"{k} as ({v})" for k, v in (done | more).items()) + " "
