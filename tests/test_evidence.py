"""Merged roads, overviews and hints: values as published for these inputs, written out."""

import pytest
from pyspark.sql import functions as F

from roadlake.operators import evidence as E

CONTEXT = """name string, segment_id string, length_km double, activity_class string, activity_score double, pollutant_totals map<string,double>, data_source string, observed_at long, data_status string,
is_estimated boolean, borrowed_from string, is_static boolean, is_interpolated boolean, hex_count long, hex_ids array<bigint>, avg_score double, max_score double, classes array<string>,
places array<struct<category: string, count: bigint>>, stops array<struct<stop_id: string, distance_m: double>>, stop_count long, scored long, class_counts map<string,bigint>, weak long, min_ahp double, avg_ahp double,
coverage_gap boolean, hint string, hours array<struct<hour: long, values: map<string,double>, interpolated: boolean, method: string>>"""
BASE = dict(
    name="Jalan Kenari", segment_id="SEG-0001", length_km=0.5, activity_class="Sedang", activity_score=2.0, pollutant_totals={"co2": 100.0}, data_source="snapshot", observed_at=None, data_status="observed",
    is_estimated=False, borrowed_from=None, is_static=None, is_interpolated=False, hex_count=1, hex_ids=[1], avg_score=2.0, max_score=2.0, classes=["Sedang"], places=[("kantor", 3)], stops=[], stop_count=0, scored=0, class_counts=None, weak=0,
    min_ahp=None, avg_ahp=None, coverage_gap=False, hint=None, hours=[],
)


def merge(spark, *changes):
    rows = [tuple((BASE | c).values()) for c in changes]
    out = E.merged(spark.createDataFrame(rows, CONTEXT)).collect()
    assert len(out) == 1
    return out[0]


def test_chunks_add_up(spark):
    got = merge(spark, {}, {"segment_id": "SEG-0002", "length_km": 0.7, "activity_score": 3.0, "activity_class": "Tinggi", "pollutant_totals": {"co2": 50.0, "nox": None}, "hex_ids": [2], "avg_score": 3.0, "coverage_gap": True})
    assert (got.chunk_count, got.segment_ids, got.segment_id, got.length_km, got.activity_class) == (2, ["SEG-0001", "SEG-0002"], "SEG-0002", 1.2, "Tinggi")
    assert got.pollutant_totals == {"co2": 150.0} and got.hex_ids == [1, 2] and got.avg_score == 2.5 and got.max_score == 2.0 and got.hex_count == 2
    assert [tuple(p) for p in got.places] == [("kantor", 6)] and got.coverage_gap is True and got.classes == ["Sedang"] and got.is_static is False


def test_hours_add_up(spark):
    empty = {"activity_class": None, "activity_score": None, "pollutant_totals": None, "hex_ids": [], "avg_score": None, "max_score": None, "classes": None, "places": []}
    got = merge(spark, empty | {"hours": [(0, {"co2": 1.0, "car": 10.0}, False, None), (3600, None, None, None)]}, empty | {"segment_id": "SEG-0002", "hours": [(0, {"co2": 2.0, "car": 5.0}, True, "linear")]})
    first, second = got.hours
    assert first["values"] == {"co2": 3.0, "car": 15.0} and first.interpolated is True and first.method == "linear"
    assert second.hour == 3600 and second["values"] is None and second.interpolated is False
    assert got.pollutant_totals is None and got.avg_score is None and got.max_score is None and got.classes is None


def test_stops_and_hints(spark):
    got = merge(
        spark, {"stop_count": 1, "scored": 1, "class_counts": {"Rendah": 1}, "weak": 1, "min_ahp": 40.0, "avg_ahp": 40.0, "hint": "improve_existing_stop", "stops": [("a", 120.0), ("b", None)]},
        {"segment_id": "SEG-0002", "stop_count": 2, "scored": 0, "class_counts": {"Rendah": 2}, "weak": 1, "coverage_gap": True, "hint": "add_new_stop", "stops": [("a", 80.0), ("b", 300.0), ("c", 5.0)]},
    )
    assert (got.stop_count, got.scored, got.class_counts, got.weak, got.min_ahp, got.avg_ahp) == (3, 1, {"Rendah": 3}, 2, 40.0, 40.0)
    assert got.hint == "add_new_stop" and [tuple(s) for s in got.stops] == [("a", 80.0), ("b", 300.0), ("c", 5.0)]
    assert merge(spark, {"hint": "increase_frequency"}, {"hint": "improve_existing_stop", "segment_id": "S"}).hint == "improve_existing_stop" and merge(spark, {}).hint is None


def test_hint(spark):
    cases = [(True, 0, "Rendah", "add_new_stop"), (False, 2, "Tinggi", "improve_existing_stop"), (False, 0, "Tinggi", "increase_frequency"), (None, None, "Sangat Tinggi", "increase_frequency"), (False, 0, "Sedang", None), (None, None, None, None)]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, gap boolean, weak int, label string")
    assert [r.h for r in df.select("i", E.hint(F.col("gap"), F.col("weak"), F.col("label")).alias("h")).orderBy("i").collect()] == [c[3] for c in cases]


def test_overview(spark):
    segments = spark.createDataFrame([("SEG-1", "Jalan A", 1.0), ("SEG-2", "Jalan A", 0.5), ("SEG-3", "Jalan B", 2.0), ("SEG-4", None, None)], "segment_id string, name string, length_km double")
    display = [("SEG-1", 1000.0, 100.0, "snapshot_occupancy", 20, "LIVE", False, "observed", None), ("SEG-2", 500.0, None, "snapshot_occupancy", 10, "LIVE", False, "observed", None), ("SEG-3", 200.0, None, "interval_count", 30, "REPLAY", True, "estimated", "SEG-1")]
    shown = spark.createDataFrame(display, "segment_id string, co2 double, nox double, semantics string, observed_at long, source_mode string, interpolated boolean, data_status string, borrowed_from string")
    evidence = spark.createDataFrame([("SEG-1", 90.0, "Sangat Tinggi", True, 0), ("SEG-2", 70.0, "Tinggi", False, 0), ("SEG-3", 20.0, "Rendah", False, 1)], "segment_id string, max_score double, activity_class string, coverage_gap boolean, weak long")
    got = {r.name: r for r in E.overview(segments, shown, evidence, ["co2", "nox"]).collect()}
    a, b, c = got["Jalan A"], got["Jalan B"], got["SEG-4"]
    assert (a.chunk_count, a.length_km, a.activity_class, a.coverage_gap, a.intervention_hint, a.data_status, a.observed_at) == (2, 1.5, "Sangat Tinggi", True, "add_new_stop", "observed", 20)
    assert a.emission_total_kg_h == pytest.approx(1.6) and a.co2 == pytest.approx(1.5) and a.nox == pytest.approx(0.1)
    assert (b.weak_stop_count, b.intervention_hint, b.data_status, b.borrowed_from, b.is_static, b.is_interpolated, b.nox) == (1, "improve_existing_stop", "estimated", "SEG-1", True, True, None)
    assert (c.emission_total_kg_h, c.activity_class, c.intervention_hint, c.length_km, c.coverage_gap) == (None, None, None, 0.0, False)


def test_evidence(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    segments = frame([("S",), ("T",)], "segment_id string")
    crossed = frame([("S", 1), ("S", 1), ("S", 2), ("S", 3)], "segment_id string, hex_id long")
    cells = frame([(1, 10.0, "Rendah"), (2, 30.0, "Tinggi"), (3, None, None)], "hex_id long, score double, class string")
    near = frame([("S", "a", 10.0), ("S", "b", 20.0), ("S", "c", 30.0)], "segment_id string, stop_id string, distance_m double")
    stops = frame([("a", "Rendah", 40.0), ("b", "Rendah", None), ("c", None, 80.0)], "stop_id string, intervention_class string, ahp_score double")
    places = frame([(1, "x", 2), (2, "x", 1), (2, "y", 9)] + [(2, f"z{i}", 1) for i in range(6)], "hex_id long, category string, n long")
    got = {r.segment_id: r for r in E.segment_evidence(segments, crossed, cells, near, stops, places, frame([], "hex_id long")).collect()}
    s, t = got["S"], got["T"]
    assert (s.hex_count, s.hex_ids, s.avg_score, s.max_score, s.classes, s.activity_class) == (3, [1, 2, 3], 20.0, 30.0, ["Rendah", "Tinggi"], "Tinggi")
    assert (s.stops, s.scored, s.weak, s.min_ahp, s.avg_ahp, s.class_counts, s.coverage_gap, s.hint) == (3, 2, 2, 40.0, 60.0, {"Rendah": 2}, False, "improve_existing_stop")
    assert [tuple(p) for p in s.places] == [("y", 9), ("x", 3), ("z0", 1), ("z1", 1), ("z2", 1)]
    assert (t.hex_count, t.hex_ids, t.stops, t.class_counts, t.coverage_gap, t.hint) == (0, None, 0, None, False, None)
    bare = E.segment_evidence(segments, crossed, cells, near, stops, places, frame([(2,)], "hex_id long")).where("segment_id = 'S'").first()
    assert bare.coverage_gap is True and bare.hint == "add_new_stop"


def test_ends(spark):
    df = spark.range(7).select("id", F.when(F.col("id") < 6, F.col("id").cast("double")).alias("score"))
    got = sorted((r.part, r["rank"], r.id, r.total, r.cut) for r in E.ends_of(df, "score", "id", 2, 1).collect())
    assert got == [("bottom", 6, 0, 6, True), ("median", 4, 2, 6, True), ("top", 1, 5, 6, True), ("top", 2, 4, 6, True)]
    assert {r.cut for r in E.ends_of(df, "score", "id", 3, 3).collect()} == {False} and E.ends_of(df.limit(0), "score", "id", 3, 3).count() == 0
