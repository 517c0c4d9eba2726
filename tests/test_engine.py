"""Every query against its SQL on the smallest tables, hand-computed values, readers, writers and streams."""

import glob
import json
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadlake.functions import scalars as S
from roadlake.operators import analytics as A
from roadlake.operators import facts as FA
from roadlake.operators import polygons
from roadlake.operators import profile as P
from roadlake.operators import records
from roadlake.operators import scoring as SC
from roadlake.operators import traffic as T
import roadlake.plans  # noqa: F401  registers all queries
from roadlake.plans.queries import ORACLES, QUERIES, Tables
from roadlake.schema import CATEGORIES, POLLUTANTS
from roadlake.sources import readers, sinks
from roadlake.sources.buckets import KeyedTable
from roadlake.streaming import windows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def shown(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    cell = lambda v: f"{v:.6g}" if isinstance(v, float) and not math.isnan(v) else str(v)
    return sorted(tuple(cell(r[i]) for i in at) for r in rows)


SLOW = {"hex_hour_scores", "hex_hourly_series"}


@pytest.mark.parametrize("name", [q for q in ORACLES if q not in SLOW])
def test_query(spark, duck, name):
    df, sql = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert shown(df.collect(), df.columns) == shown(sql.fetchall(), sql.columns)


def column(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


def fact(i, segment, version, mode, value, hour=0, calc=0):
    return (i, segment, hour * 3600, hour * 3600 + 3600, calc, version, mode, None, None, *[value * 1000.0] * 8, *[60.0] * 4, *[1.0] * 4)


FACTS = "id long, segment_id string, period_start long, period_end long, calculated_us long, version int, meta_source_mode string, meta_data_source string, semantics string, " + ", ".join([f"{p}_g_h double" for p in POLLUTANTS] + [f"{c}_veh_h double" for c in CATEGORIES] + [f"{c}_vkt double" for c in CATEGORIES])


@pytest.fixture(scope="module")
def small(spark):
    rows = [fact(1, "A", 1, "REPLAY", 999), fact(2, "A", 2, "REPLAY", 1), fact(3, "A", 1, "REPLAY", 3, 0.5), fact(4, "B", 1, "REPLAY", 10), fact(5, "B", 1, "SYNTHETIC", 9999, 0.5)]
    rows = [tuple(int(v) if k in (2, 3) else v for k, v in enumerate(r)) for r in rows]
    segments = spark.createDataFrame([("A", "a", "A", "a"), ("B", "b", "B", "b")], "segment_id string, segment_name string, corridor_id string, corridor_name string")
    return spark.createDataFrame(rows, FACTS), segments


def test_mean_per_segment_then_sum(small):
    facts, segments = small
    samples = FA.deduplicated(FA.matching(facts, segments))
    r = A.trend(samples, 3600).first()
    assert (r.co2_kg_h, r.segment_count, r.sample_count) == (12.0, 2, 3)
    r = A.latest_summary(FA.latest(FA.matching(facts, segments)), 0).first()
    assert r.co2_kg_h == 13.0
    assert A.vehicle_totals(samples).first().car_veh_h == 120.0
    assert {r.share for r in A.vehicle_shares(samples).collect()} == {0.25}
    assert [r.total_veh_h for r in A.vehicle_ranking(samples, 5).collect()] == [240.0, 240.0]


def test_filter_contract():
    with pytest.raises(ValueError):
        FA.AnalyticsFilter(5, 5)
    with pytest.raises(ValueError):
        FA.AnalyticsFilter(0, 32 * 86400)
    assert FA.AnalyticsFilter(0, 32 * 86400, newest=True).end == 32 * 86400
    assert [S.bucket_width(h)[0] for h in (1, 3, 12, 13)] == ["1m", "5m", "15m", "1h"]
    assert S.bucket_width(4000, newest=True) == ("2h", 7200)
    for bad in ((10, "2m"), (100, "1m")):
        with pytest.raises(ValueError):
            S.bucket_width(*bad)


def test_worked_example(spark):
    df = spark.createDataFrame([(0.0, 4500.0, 0.0, 0.0, 0.8)], "car_veh_h double, motorcycle_veh_h double, bus_veh_h double, truck_veh_h double, length_km double")
    r = T.tier2(df).first()
    assert r.motorcycle_vkt == pytest.approx(3600) and r.co_g_h == pytest.approx(50400)
    r = T.fuel_model(spark.createDataFrame([(10.0, 20.0, 2.0, 1.0)], "car double, motorcycle double, bus double, truck double")).first()
    assert (r.co2_g_min, r.co_g_min) == (6756.0, 413.35)


OBS = "id long, camera_id string, segment_id string, stream_id string, captured_at long, captured_us long, duration double, semantics string, category string, n double"


def test_streams_have_their_own_durations(spark):
    rows = [(1, "c1", "S", "a", 0, 0, 60.0, "interval_count", "car", 1.0), (2, "c2", "S", "b", 0, 0, 30.0, "interval_count", "car", 1.0)]
    r = T.segment_aggregate(spark.createDataFrame(rows, OBS), 60).first()
    assert (r.car_veh_h, r.duration, r.streams) == (180.0, 60.0, 2)
    rows = [(1, "c1", "S", "a", 0, 0, 10.0, "interval_count", "car", 2.0), (2, "c1", "S", "a", 20, 20, 20.0, "interval_count", "car", 4.0), (3, "c1", "S", "a", 20, 20, 20.0, "interval_count", "car", 4.0)]
    assert T.segment_aggregate(spark.createDataFrame(rows, OBS), 60).first().car_veh_h == 720.0


def test_gap_plan_and_fill(spark):
    means = spark.createDataFrame([("s", 1 * 3600, 10.0), ("s", 4 * 3600, 40.0)], "k string, hour long, v double")
    rows = {r.hour // 3600: (r.v, r.method) for r in P.filled(P.densified(means, ["k"], 5 * 3600, 6), ["k"], ["v"]).collect()}
    assert rows == {0: (10.0, "backward_fill"), 1: (10.0, None), 2: (20.0, "linear"), 3: (30.0, "linear"), 4: (40.0, None), 5: (40.0, "forward_fill")}


@pytest.mark.parametrize("x,low,high,want", [(10, 10, 20, 1.0), (15, 10, 20, 50.5), (20, 10, 20, 100.0), (7, 7, 7, 100.0)])
def test_min_max(spark, x, low, high, want):
    assert column(spark, S.min_max_100(*map(F.lit, (x, low, high)))) == want


@pytest.mark.parametrize("age,want", [(30, "fresh"), (31, "aging"), (90, "aging"), (91, "stale"), (-5, "fresh"), (None, "unknown")])
def test_freshness(spark, age, want):
    assert column(spark, S.freshness(F.lit(age).cast("long"))) == want


@pytest.mark.parametrize("label,want", [("Sangat Tinggi", 5), ("tinggi", 4), ("Sedang", 3), ("Rendah", 2), ("SANGAT RENDAH", 1), (None, 0), ("?", 0)])
def test_tier(spark, label, want):
    assert column(spark, S.tier_of_label(F.lit(label).cast("string"))) == want


@pytest.mark.parametrize("name,want", [("Jl. Malioboro", "jalan malioboro"), ("MALIOBORO", "jalan malioboro"), ("Gg. Melati  No.5", "gang melati no 5"), (None, "")])
def test_names(spark, name, want):
    assert column(spark, S.normalized_name(F.lit(name).cast("string"))) == want


def test_rank_is_a_permutation(spark):
    df = spark.range(500).select("id", (F.col("id") * 7 % 13).alias("s"))
    got = sorted((r.rank, r.s, r.id) for r in SC.ranked(df, "s", "id", True).collect())
    assert [r for r, _, _ in got] == list(range(1, 501))
    assert [(-s, i) for _, s, i in got] == sorted((-s, i) for _, s, i in got)


def test_rank_of_two_million_rows_with_payload(spark, tmp_path):
    """Rows read from Parquet, a third of them with one score, some without, and a column that isn't part of the order."""
    score = F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 101 != 5, F.hash("id").cast("double"))
    spark.range(0, 2_000_000, numPartitions=8).select("id", score.alias("s"), F.concat(F.lit("payload "), "id").alias("text")).write.parquet(str(tmp_path / "r"))
    got = SC.ranked(spark.read.parquet(str(tmp_path / "r")), "s", "id", True, parts=16)
    n = got.agg(F.count_distinct("rank").alias("ranks"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.count("text").alias("rows")).first()
    assert (n.ranks, n.low, n.high, n.rows) == (2_000_000, 1, 2_000_000, 2_000_000)
    two = got.select(F.col("rank") + 1, "s", "id").toDF("rank", "s1", "id1").join(got, "rank")
    worse = two.where("s > s1 OR (s1 IS NULL AND s IS NOT NULL) OR (s1 = s AND id < id1)").count()
    assert worse == 0


def test_nearest_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    left = [(i, "ab"[i % 2], rng.gauss(0, 3 ** rng.randint(-4, 3)), rng.gauss(0, 2)) for i in range(300)] + [(900, "c", 0.0, 0.0)]
    right = [(i, "ab"[i % 5 == 0], rng.gauss(0, 3 ** rng.randint(-4, 3)), rng.gauss(0, 2)) for i in range(150)]
    from roadlake.operators import spatial

    l, r = spark.createDataFrame(left, "id long, g string, lon double, lat double"), spark.createDataFrame(right, "rid long, g string, lon_r double, lat_r double")  # noqa: E741
    got = {x.id: x.rid for x in spatial.nearest(l, r, ["id"], "rid", ["g"]).collect()}
    want = {i: min(((x - p) ** 2 + (y - q) ** 2, j) for j, h, p, q in right if h == g)[1] for i, g, x, y in left if g != "c"}
    assert got == want
    assert "NestedLoop" not in spatial.nearest(l, r, ["id"], "rid")._jdf.queryExecution().executedPlan().toString()


def test_collision_policies(spark):
    df = spark.createDataFrame([("S", 0, "x", "c2", 1), ("S", 0, "x", "c1", 2), ("S", 0, "y", "c3", 3)], "segment_id string, window long, stream_id string, camera_id string, n long")
    assert sorted(r.n for r in T.by_policy(df, "authoritative_camera").collect()) == [2, 3]
    with pytest.raises(Exception, match="several cameras for stream x"):
        T.by_policy(df).collect()
    assert [r.n for r in T.by_policy(df.where("stream_id = 'y'")).collect()] == [3]
    with pytest.raises(ValueError, match="no such policy"):
        T.by_policy(df, "other")


def test_time_range_reaches_the_scan(spark):
    plan = QUERIES["trend_range"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_geojson(spark, tmp_path):
    f = lambda kind, c, **p: {"type": "Feature", "geometry": {"type": kind, "coordinates": c}, "properties": p}
    (tmp_path / "p.json").write_text(json.dumps({"features": [f("Point", [110.3, -7.8], NAMA="x"), f("Point", [999, 0]), f("LineString", [1, 2])]}))
    good, bad = readers.points(spark, str(tmp_path / "p.json"))
    assert [r.properties["NAMA"] for r in good.collect()] == ["x"] and bad.count() == 2
    (tmp_path / "z.json").write_text(json.dumps({"features": [f("MultiPolygon", [[[[0, 0], [1, 0], [1, 1]]]], WADMKC="d", Penduduk="5"), f("MultiPolygon", [[[[0, 0]]]], WADMKC="d")]}))
    good, bad = readers.zones(spark, str(tmp_path / "z.json"), ["WADMKC", "Penduduk"])
    assert (good.count(), bad.count()) == (1, 1)
    out = json.loads(sinks.geojson_points(spark.createDataFrame([(1, 110.1234567, -7.0)], "id long, lon double, lat double")).first().feature)
    assert out["geometry"]["coordinates"] == [110.12346, -7.0] and out["properties"] == {"id": 1}


def test_history_csv(spark, tmp_path):
    head = "segment_id,period_start,period_end,vehicle_count_semantics,co2_kg_h,nox_kg_h\n"
    rows = ["A,2024-01-01T00:00:00Z,2024-01-01T01:00:00Z,snapshot_occupancy,1.5,", "A,2024-01-01T02:00:00,2024-01-01T03:00:00Z,snapshot_occupancy,1,1", "B,2024-01-01T00:00:00Z,2024-01-01T00:00:00Z,snapshot_occupancy,1,1", "C,2024-01-01T00:00:00Z,2024-01-01T01:00:00Z,snapshot_occupancy,-1,1", "D,2024-01-01T00:00:00Z,2024-01-01T01:00:00Z,interval_count,1,1", *["E,2024-01-01T00:00:00Z,2024-01-01T01:00:00Z,snapshot_occupancy,1,1"] * 2]
    (tmp_path / "h.csv").write_text(head + "\n".join(rows) + "\n")
    good, bad = readers.history_csv(spark, str(tmp_path / "h.csv"))
    assert [(r.segment_id, r.co2_kg_h_value, r.nox_kg_h_value) for r in good.collect()] == [("A", 1.5, None)]
    assert sorted((r.segment_id, r.reason) for r in bad.collect()) == [("A", "time without zone"), ("B", "no period"), ("C", "number co2_kg_h"), ("D", "semantics"), ("E", "repeated"), ("E", "repeated")]


def test_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda *rows: spark.createDataFrame(list(rows), "k string, mode string, v long")
    now = lambda: sorted(tuple(r) for r in sinks.latest_version(spark, path).collect())
    sinks.upsert(df(("a", "LIVE", 0), ("b", "REPLAY", 2), ("a", "LIVE", 1), ("a", "LIVE", -1)), path, ["k"], ["v"])
    sinks.upsert(df(("a", "LIVE", 3), ("c", "LIVE", 4)), path, ["k"])
    assert now() == [("a", "LIVE", 3), ("b", "REPLAY", 2), ("c", "LIVE", 4)]
    sinks.insert_missing(df(("a", "LIVE", 9), ("d", "REPLAY", 5)), path, ["k"])
    sinks.replace_where(df(("z", "REPLAY", 0)), path, "mode", "REPLAY")
    assert now() == [("a", "LIVE", 3), ("c", "LIVE", 4), ("z", "REPLAY", 0)]
    gone = sinks.latest_version(spark, path).where("mode = 'REPLAY'")
    assert sinks.delete_matching(path, spark, gone, ["k"]) == 1 and len(now()) == 3
    sinks.delete_matching(path, spark, gone, ["k"], dry_run=False)
    assert [r[0] for r in now()] == ["a", "c"]
    sinks.export_csv(spark.createDataFrame([("=1+1", [1, 2]), ("ok", [])], "x string, y array<int>"), str(tmp_path / "csv"))
    raw = next((tmp_path / "csv").glob("part-*")).read_bytes()
    assert raw.startswith(b"\xef\xbb\xbf")
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).collect()
    assert sorted((r.x, r.y) for r in back) == [("'=1+1", "[1,2]"), ("ok", "[]")]
    sinks.export_csv(spark.createDataFrame([(2, None), (1, 'a "b", c')], "i long, t string"), str(tmp_path / "csv2"), ["t", "i", "gone"], ["i"])
    assert next((tmp_path / "csv2").glob("part-*")).read_text("utf-8-sig").splitlines() == ['"t","i","gone"', '"a ""b"", c","1",""', '"","2",""']
    sinks.export_json(spark.createDataFrame([(1, None)], "i long, t string"), str(tmp_path / "json"), {"scope": "x"})
    assert json.loads(next((tmp_path / "json").glob("part-*")).read_text()) == {"metadata": {"scope": "x", "row_count": 1}, "data": [{"i": 1, "t": None}]}
    five = spark.range(5)
    assert [[r.id for r in sinks.page_scope(five, ["id"], 2, 2, scope).orderBy("id").collect()] for scope in ("page", "beyond", "all")] == [[2, 3], [4], [0, 1, 2, 3, 4]]
    now_states = spark.createDataFrame([("a", 100), ("b", 10)], "k string, processed long")
    assert [r.k for r in sinks.unexpired(now_states, 130).collect()] == ["a"]
    sinks.append_log(five, str(tmp_path / "log"))
    sinks.append_log(five, str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 10
    shapes = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])], "id long, line array<struct<lon: double, lat: double>>")
    assert json.loads(sinks.geojson_lines(shapes).first().feature)["geometry"] == {"type": "LineString", "coordinates": [[0, 0], [1, 0], [1, 1]]}
    assert json.loads(sinks.geojson_polygons(shapes, "line").first().feature)["geometry"]["coordinates"] == [[[0, 0], [1, 0], [1, 1], [0, 0]]]


def test_mapping_close_out(spark):
    m = spark.createDataFrame([("c1", "S1", None, None, True), ("c2", "S1", None, None, True), ("c1", "S2", None, 50, False), ("c3", "S3", None, None, True)], "camera_id string, segment_id string, valid_from long, valid_to long, is_active boolean")
    got = sorted((r.camera_id, r.segment_id, r.valid_to, r.is_active) for r in sinks.close_mappings(m, spark.createDataFrame([("c2", "S1")], "camera_id string, segment_id string"), 100).collect())
    assert got == [("c1", "S1", 100, False), ("c1", "S2", 50, False), ("c2", "S1", None, True), ("c3", "S3", None, True)]


def stream(spark, tmp_path, df, name, transform, files=3):
    """Runs a stream over a few files of one table, in order, to its end."""
    folder = tmp_path / name
    folder.mkdir()
    rows = df.collect()
    for i in range(files):
        part = rows[len(rows) * i // files : len(rows) * (i + 1) // files]
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(str(folder / f"d{i}"))
        for f in (folder / f"d{i}").glob("*.parquet"):
            f.rename(folder / f"{i}.parquet")
            os.utime(folder / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
        for f in (folder / f"d{i}").glob("*"):
            f.unlink()
        for f in (folder / f"d{i}").glob(".*"):
            f.unlink()
        (folder / f"d{i}").rmdir()
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    q = transform(s).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    return spark.sql(f"select * from {name}").collect()


def test_window_stream(spark, tmp_path):
    rows = [("a", 10, "car", 2.0), ("a", 50, "car", 4.0), ("b", 55, "bus", 1.0), ("a", 130, "car", 1.0), ("a", 20, "car", 9.0), ("b", 59, "bus", 3.0), ("b", 61, "bus", 8.0), ("b", 125, "bus", 0.0)]
    df = spark.createDataFrame(rows, "camera_id string, captured_at long, category string, n double")
    got = sorted((r.camera_id, r.window, r.status, r.sample_count, r.car, r.bus) for r in stream(spark, tmp_path, df, "win", lambda s: windows.window_means(s, 60), files=8))
    assert got == [("a", 0, "completed", 2, 3.0, 0.0), ("a", 0, "late", 1, 9.0, 0.0), ("b", 0, "completed", 2, 0.0, 2.0), ("b", 60, "completed", 1, 0.0, 8.0)]


def test_window_stream_of_idle_cameras(spark, tmp_path):
    """Camera b falls silent after 59: the watermark, 30 seconds behind camera a, finishes its window."""
    rows = [("b", 55, "bus", 1.0), ("b", 59, "bus", 3.0), ("a", 60, "car", 2.0), ("a", 100, "car", 4.0), ("a", 125, "car", 1.0), ("a", 126, "car", 1.0)]
    df = spark.createDataFrame(rows, "camera_id string, captured_at long, category string, n double")
    got = sorted((r.camera_id, r.window, r.status, r.sample_count, r.car, r.bus) for r in stream(spark, tmp_path, df, "idle", lambda s: windows.window_means(s, 60, "30 seconds"), files=6))
    assert got == [("a", 60, "completed", 2, 3.0, 0.0), ("b", 0, "completed", 2, 0.0, 2.0)]


def test_flow_stream_equals_batch(spark, tmp_path):
    import random

    rng, rows = random.Random(3), []
    for camera in (1, 2):
        for frame in range(120):
            for track in range(4):
                if rng.random() < 0.75 - 0.5 * ((frame // 15 + track) % 3 == 0):
                    rows.append((camera, frame, track, CATEGORIES[track], rng.random() < 0.8))
            rows.append((camera, frame, None, "car", False))
    df = spark.createDataFrame(rows, "camera long, frame_no long, track_id long, category string, inside boolean").orderBy("frame_no", "camera")
    got = sorted((r.camera, r.frame_no, r.category) for r in stream(spark, tmp_path, df, "flow", lambda s: windows.flow_counts(s, 3, 5)))
    want = sorted((r.camera, r.frame_no, r.category) for r in T.flow_exits(df, ["camera"], 3, 5).collect())
    assert got == want and got


def test_flow_forgets_and_resets(spark, tmp_path):
    """A track that was away for 300 frames counts again, in the stream as in the batch; after an outage ids start anew."""
    box = lambda f, t=1: (1, f, t, "car", True)
    rows = [*map(box, (0, 1, 2, 3)), *map(box, (400, 401, 402)), (1, 500, None, "car", False), *(box(f, 2) for f in (501, 502, 503, 505)), (1, 506, 2, "bus", False)]
    df = spark.createDataFrame(rows, "camera long, frame_no long, track_id long, category string, inside boolean")
    want = [(8, "car"), (407, "car"), (506, "bus")]
    assert sorted((r.frame_no, r.category) for r in T.flow_exits(df, ["camera"], 3, 5).collect()) == want
    assert sorted((r.frame_no, r.category) for r in stream(spark, tmp_path, df, "forget", lambda s: windows.flow_counts(s, 3, 5))) == want
    assert windows.after_outages(df, 50).select("track_id").distinct().count() == 4  # none, 1, 1 after 396 frames, 2 after 97


def test_window_sink_is_idempotent(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "w"), ["camera_id", "window"])
    write = windows.window_sink(table)
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 60, 2.0)], "camera_id string, window long, car double")
    for i in (0, 1, 1):
        write(df, i)
    assert table.read().count() == 2 and table.versions() == [0, 1]


def test_measured_windows(spark, tmp_path):
    rows = [(1, float(t), 1.0, 0.0, 0.0, 0.0) for t in (0, 4, 8, 20, 23, 26, 29, 30.5)]
    df = spark.createDataFrame(rows, "camera long, at double, car double, motorcycle double, bus double, truck double")
    got = stream(spark, tmp_path, df, "meas", lambda s: windows.measured_windows(s, 10, 5), files=2)
    assert [(r.ended_at, r.seconds, r.car) for r in got] == [(30.5, 10.5, 4.0)]


def test_newest_wins_sink(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "s"), ["k"])
    write = windows.newest_state_sink(table)
    df = lambda *rows: spark.createDataFrame(list(rows), "k string, observed long, processed long, id long")
    write(df(("a", 10, 10, 1), ("a", 9, 99, 2)), 0)
    write(df(("a", 8, 100, 3), ("b", 1, 1, 4)), 1)
    write(df(("a", 8, 100, 3), ("b", 1, 1, 4)), 1)
    assert sorted(r.id for r in table.read().collect()) == [1, 4]


def test_entry_without_corpus():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())


def test_entry_survives_missing_libraries(monkeypatch):
    """A module of the corpus operators that can't be imported takes away these only."""
    import sys

    import __spark_entry__ as e

    for name in [m for m in sys.modules if m.startswith("roadlake.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "roadlake.llm.queries", None)
    assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) == set(ORACLES)


def test_generator(spark):
    a, b = (readers.synthetic_facts(spark, 3, 5, 7).toPandas() for _ in range(2))
    assert len(a) == 15 and isinstance(a, pd.DataFrame) and a.equals(b)


def test_generator_fills_what_is_missing(spark):
    everything = readers.synthetic_facts(spark, 3, 5, 7)
    known = everything.where("(segment + hour) % 2 = 0")
    got = readers.synthetic_facts(spark, 3, 5, 7, only_missing=known)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, everything.where("(segment + hour) % 2 = 1").collect()))


def test_share_inside_a_zone_that_is_not_convex(spark):
    ring = lambda points: F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in points])
    square = [(0, 0), (0, 4), (4, 4), (4, 0)]
    horseshoe = [(-1, 1), (5, 1), (5, 3), (3, 3), (3, 2), (1, 2), (1, 3), (-1, 3)]
    share = lambda a, b: column(spark, polygons.share_inside(ring(a), ring(b)))
    assert share(square, horseshoe) == pytest.approx(6 / 16)
    assert share(square, horseshoe[::-1]) == pytest.approx(6 / 16)
    assert share(square, square) == pytest.approx(1)
    assert column(spark, polygons.share_inside(ring(square), ring([(2, 2), (6, 2), (6, 6)]), convex_zone=True)) == pytest.approx(2 / 16)
    assert share(square, [(9, 9), (9, 10), (10, 10)]) == 0


def test_buffer_shares_add_up(spark):
    shares = QUERIES["buffer_overlap"](spark, SF).groupBy("stop_id").agg(F.sum("share").alias("s")).collect()
    assert shares and all(r.s == pytest.approx(1, abs=1e-5) for r in shares)


def test_sql_functions(spark):
    from roadlake.functions import sqlfunctions

    assert len(sqlfunctions.register(spark)) == len(sqlfunctions.FUNCTIONS)
    r = spark.sql("select rl_bucket(3700, 3600) a, rl_min_max_100(15, 10, 20) b, rl_quintile(3, 7) c, rl_haversine_m(0, 0, 0, 1) d, rl_formula_guard('=x') e, rl_freshness(31) f").first()
    assert (r.a, r.b, r.c, r.e, r.f) == (3600, 50.5, 3, "'=x", "aging") and r.d == pytest.approx(111194.9, abs=1)


def test_schema_backfill(spark):
    from roadlake.operators.states import renamed_pollutants

    r = renamed_pollutants(spark.createDataFrame([(1.0, None)], "pm double, nmvoc double")).first()
    assert (r.tsp, r.hc, r.co2) == (1.0, 0.0, 0.0)


def test_survey_readers(spark, tmp_path):
    sheets = [spark.createDataFrame([("Halte  A ", "ya"), ("", "x")], "title string, roof string"), spark.createDataFrame([("halte a", "Tidak"), ("halte b", "YA")], "title string, lamp string")]
    m = readers.checklist(readers.merged_sheets(sheets, "title"), ["roof", "lamp"])
    assert sorted((r.title_key, r.checklist["roof"], r.checklist["lamp"]) for r in m.collect()) == [("halte a", True, False), ("halte b", False, True)]
    (tmp_path / "a.csv").write_text('﻿id,title,geometry.coordinates,medias\n1,x,"[110.3,-7.8]","[{""url"":""u""}]"\n2,y,bad,\n', encoding="utf-8")
    got = sorted((r.id, r.lon, r.lat) for r in readers.activities_csv(spark, str(tmp_path / "a.csv")).collect())
    assert got == [("1", 110.3, -7.8), ("2", None, None)]
    df = spark.createDataFrame([(1.0, 1.005)], "stored double, real double")
    assert readers.verified(df, "stored", F.col("real")).count() == 1
    with pytest.raises(Exception, match="stored differs"):
        readers.verified(df, "stored", F.col("real") + 1).collect()


def test_hex_scores_of_all_hours(spark):
    t = Tables(spark, SF)
    samples, segments, cells = (x.toPandas() for x in (t.samples(), t.segments, t.hexes))
    cells = cells.sort_values("hex_id").reset_index(drop=True)
    away = lambda lon, lat, some: ((some.lon - lon) ** 2 + (some.lat - lat) ** 2)
    cell = {r.segment_id: r.hex_id for r in QUERIES["primary_hex"](spark, SF).collect()}
    hours = sorted({*samples.period_start, samples.period_start.max() + 3600})
    samples = samples[samples.segment_id.isin(cell) & samples[[f"{c}_veh_h" for c in CATEGORIES]].notna().any(axis=1)]
    samples["hex_id"], samples["v"] = samples.segment_id.map(cell), samples[[f"{c}_veh_h" for c in CATEGORIES]].fillna(0).sum(axis=1)
    volumes = samples.groupby(["period_start", "hex_id"]).v.sum().round(6)
    got = {(r.hour, r.hex_id): (r.score, r.status, r.source) for r in QUERIES["hex_hour_scores"](spark, SF).collect()}
    assert len(hours) > 24 and len(got) == len(hours) * len(cells)  # all hours with facts, and one without
    for hour in [*hours[:: max(1, len(hours) // 40)], hours[-1]]:
        own = volumes[hour].to_dict() if hour in volumes.index.levels[0] else {}
        live = cells[cells.hex_id.isin(own)]
        low, high = (min(own.values()), max(own.values())) if own else (cells.volume_mean.min(), cells.volume_mean.max())
        for c in cells.itertuples():
            source = c.hex_id if c.hex_id in own else live.hex_id[away(c.lon, c.lat, live).idxmin()] if own else None
            used = own[source] if own else c.volume_mean
            score, status, other = got[hour, c.hex_id]
            if pd.isna(used):
                assert (score, status, other) == (None, "no_data", None)
                continue
            norm = 100.0 if high <= low else 1 + (used - low) / (high - low) * 99
            want = SC.cell_score(norm, c.norm_poi, c.norm_population)
            assert status == ("live" if c.hex_id in own else "fallback") and abs(score - want) < 1e-4
            assert other is None if status == "live" or not own else abs(own[other] - own[source]) < 1e-9 or other == source
    series = {r.hour for r in QUERIES["hex_hourly_series"](spark, SF).collect()}
    assert series == set(hours)


def test_embedding_resolve_of_all(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").toPandas().sort_values("vec_id")
    ids, x = e.vec_id.to_numpy(), np.array(e.embedding.tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x @ x.T
    np.fill_diagonal(c, -2)
    best = np.round(c, 9).argmax(1)  # the smallest id of equals
    want = {int(i): (int(ids[b]), float(v[b])) for i, b, v in zip(ids, best, c, strict=True) if i % 20 == 0 and v[b] >= 0.40}
    got = {r.query_id: (r.vec_id, r.similarity) for r in QUERIES["embedding_resolve"](spark, SF).collect()}
    assert got.keys() == want.keys() and max(got) >= 10
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-6 for i in want)


def workbook(path, sheets):
    """A small XLSX file: the first column's texts are shared strings, other texts stand in their cells, numbers as numbers."""
    import zipfile

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    shared = []

    def cell(i, j, v):
        at = f'r="{chr(65 + j)}{i + 1}"'
        if v is None:
            return ""
        if isinstance(v, str) and j == 0:
            shared.append(v)
            return f'<c {at} t="s"><v>{len(shared) - 1}</v></c>'
        return f'<c {at} t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f"<c {at}><v>{v}</v></c>"

    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for n, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{i + 1}">{"".join(cell(i, j, v) for j, v in enumerate(r))}</row>' for i, r in enumerate(rows))
            z.writestr(f"xl/worksheets/sheet{n + 1}.xml", f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{"".join(f"<si><t>{x}</t></si>" for x in shared)}</sst>')


def test_xlsx(spark, tmp_path):
    path = str(tmp_path / "survey.xlsx")
    workbook(path, {
        "Access": [["Stop ", "Ramp", "Width"], ["Stop  A", "Ya", 1.5], [None, None, None], ["Stop B", None, 2]],
        "State": [["Stop", "Paint"], ["stop a", "Tidak"], ["Stop C", "Ya"]],
        "Empty": [],
    })
    access = readers.xlsx_sheet(spark, path, "Access", ["Stop", "Ramp", "Width", "Absent"])
    assert [tuple(r) for r in access.collect()] == [("Stop  A", "Ya", "1.5", None), ("Stop B", None, "2", None)]
    state = readers.xlsx_sheet(spark, path, "State", ["Stop", "Paint"])
    both = {r.title_key: (r.Ramp, r.Paint) for r in readers.merged_sheets([access, state], "Stop").collect()}
    assert both == {"stop a": ("Ya", "Tidak"), "stop b": (None, None), "stop c": (None, "Ya")}
    assert readers.xlsx_sheet(spark, path, "Empty", ["Stop"]).count() == readers.xlsx_sheet(spark, path, "None", ["Stop"]).count() == 0


def test_import_survey(spark):
    stops = spark.createDataFrame([(1, 5.0), (2, 6.0), (3, None)], "stop_id long, score double")
    surveys = spark.createDataFrame([(1, 1, 9.0, "a"), (1, 2, None, "b"), (3, 1, 7.0, "c"), (9, 1, 1.0, "d"), (None, 1, 1.0, "e")], "stop_id long, at long, score double, note string")
    kept, lost = records.import_survey(stops, surveys, "stop_id", ["at"], ["score", "note"], "m")
    assert sorted(tuple(r) for r in kept.select("stop_id", "score", "note", "score_method").collect()) == [(1, None, "b", "m"), (2, 6.0, None, None), (3, 7.0, "c", "m")]
    assert sorted((r.stop_id or 0, r.note) for r in lost.collect()) == [(0, "e"), (9, "d")]
