"""Message files as a source, states with a time to live, snapshots in micro-batches, vectors of names."""

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from roadlake.sources import messages as M
from roadlake.sources.buckets import KeyedTable
from roadlake.sources.names import backfill, name_changes
from roadlake.streaming import snapshots, states, windows
from roadlake.schema import CATEGORIES


def lines(path, *texts, end="\n"):
    with open(path, "a", encoding="utf-8") as f:
        f.write("".join(t + "\n" for t in texts[:-1]) + (texts[-1] + end if texts else ""))


# ---- message files


def test_messages_as_a_batch(spark, tmp_path, monkeypatch):
    lines(tmp_path / "emissions:a", '{"n": 1}', "no json", "", '{"n": 2}')
    lines(tmp_path / "tracks:a", '{"n": "é漢"}', "[1]", end="")
    lines(tmp_path / "other", '{"n": 9}')
    (tmp_path / "_hidden").write_text("{}\n")
    for piece in (64 << 20, 3):  # pieces that end inside lines lose and repeat none
        monkeypatch.setattr(M, "PIECE", piece)
        got = M.messages(spark, str(tmp_path), "*:*").collect()
        assert sorted((r.channel, json.loads(r.payload)["n"]) for r in got if r.channel != "other") == [("emissions:a", 1), ("emissions:a", 2), ("tracks:a", "é漢")]
    assert M.messages(spark, str(tmp_path / "nothing")).count() == 0


def test_a_stopped_stream_resumes(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()

    def run():
        q = M.messages(spark, str(source), stream=True).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start()
        q.processAllAvailable()
        seen = [p.observedMetrics["messages"].asDict() for p in q.recentProgress if p.observedMetrics]
        q.stop()
        return sum(s["all"] for s in seen), sum(s["bad"] for s in seen)

    got = lambda: sorted(json.loads(r.payload)["n"] for r in spark.read.parquet(str(out)).collect())
    lines(source / "a", '{"n": 1}', "bad", '{"n": 2}', '{"n": 3', end="")  # the last line is still being written
    assert run() == (3, 1) and got() == [1, 2]
    lines(source / "a", "}", '{"n": 4}')
    lines(source / "b", '{"n": 5}')
    assert run() == (3, 0) and got() == [1, 2, 3, 4, 5]
    assert run()[0] == 0 and got() == [1, 2, 3, 4, 5]


def test_freshness_on_read(spark):
    df = spark.createDataFrame([("a", 1000), ("b", 900), ("c", None), ("d", 2000)], "k string, observed long")
    got = {r.k: (r.freshness_seconds, r.freshness_status) for r in M.with_freshness(df, 1050, 60, 120).collect()}
    assert got == {"a": (50, "fresh"), "b": (150, "stale"), "c": (0, "unknown"), "d": (0, "fresh")}


# ---- states with a time to live


def test_states_expire_without_an_event(spark, tmp_path):
    rows = [[("a", 100, 100, "a1"), ("b", 100, 100, "b1"), ("a", 90, 120, "older")], [("a", 150, 150, "a2")], [("c", 225, 225, "c1")], [("c", 280, 280, "c2")], [("c", 290, 290, "c3")]]
    schema = "k string, observed long, processed long, v string"
    folder = tmp_path / "in"
    folder.mkdir()
    for i, part in enumerate(rows):
        pd.DataFrame(part, columns=["k", "observed", "processed", "v"]).to_parquet(folder / f"{i}.parquet")
        os.utime(folder / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    old = spark.conf.get(states.PROVIDER[0], None)
    spark.conf.set(*states.PROVIDER)
    try:
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        q = states.latest_states(s, ["k"], 120).writeStream.format("memory").queryName("ttl").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(240)
    finally:
        spark.conf.set(states.PROVIDER[0], old) if old else spark.conf.unset(states.PROVIDER[0])
    got = [(r.k, r.v, r.change) for r in spark.sql("select * from ttl").collect()]
    assert [g for g in got if g[0] == "a"] == [("a", "a1", "set"), ("a", "a2", "set"), ("a", "a2", "expired")]
    assert [g for g in got if g[0] == "b"] == [("b", "b1", "set"), ("b", "b1", "expired")]  # nothing more came for b
    assert [g for g in got if g[0] == "c"] == [("c", "c1", "set"), ("c", "c2", "set"), ("c", "c3", "set")]


def test_windows_of_a_batch_equal_those_event_by_event():
    rng = np.random.default_rng(3)
    for _ in range(30):
        done, held, out, want, late = -1, {}, {}, {}, 0
        state = (-1, np.zeros(0))
        seen_late = 0
        for _ in range(6):
            n = rng.integers(1, 12)
            f = pd.DataFrame({"captured_at": rng.integers(0, 600, n), "category": rng.choice([*CATEGORIES, "other"], n), "n": rng.integers(1, 9, n).astype(float)})
            f["window"] = f.captured_at // 60 * 60
            for r in f.sort_values("captured_at", kind="stable").itertuples():  # event by event
                if r.window <= done:
                    late += 1
                    continue
                w = held.setdefault(r.window, [0, 0.0])
                w[0], w[1] = w[0] + 1, w[1] + (r.n if r.category == "car" else 0)
                for s in [s for s in held if s + 60 <= r.captured_at]:
                    want[s], done = held.pop(s), max(done, s)
            l, sums, by = windows.added_up(f, *state)
            seen_late += len(l)
            ended = sums[:, 0] + 60 <= by
            out |= {int(x[0]): [int(x[1]), x[3]] for x in sums[ended]}
            state = (max([state[0], *sums[ended][:, 0].astype(int)]), sums[~ended].ravel())
        assert out == want and seen_late == late


# ---- snapshots


OBSERVED = "id long, camera_id string, segment_id string, stream_id string, captured_at long, captured_us long, duration double, semantics string, category string, n double, has_roi boolean, priority string"


def observed(*rows):
    return [(i, c, s, st, at, at * 1_000_000, 300.0, "snapshot_occupancy", cat, n, roi, p) for i, (c, s, st, at, cat, n, roi, p) in enumerate(rows)]


def test_snapshot_batches(spark, tmp_path):
    segments = spark.createDataFrame([("S", 2.0), ("R", 1.0)], "segment_id string, length_km double")
    table, figures = KeyedTable(spark, str(tmp_path / "facts"), ["segment_id", "period_start", "version"], 4), []
    write = snapshots.snapshot_sink(table, segments, 600, report=lambda i, f: figures.append((i, f)))
    batch = spark.createDataFrame(observed(
        ("cam-b", "S", "one", 10, "car", 3.0, True, "high"), ("cam-a", "S", "one", 5, "car", 9.0, False, "low"),  # the newer camera of a stream counts
        ("cam-c", "S", "two", 20, "bus", 1.0, True, None),
        ("cam-e", "R", "one", 30, "car", 4.0, False, "low"), ("cam-d", "R", "one", 30, "car", 2.0, False, "low"),  # a tie: the smaller id
    ), OBSERVED)
    write(batch, 0)
    got = {r.segment_id: r for r in table.read().collect()}
    s, r = got["S"], got["R"]
    assert (s.version, s.source_mode, s.data_source, s.calculation_mode, s.volume_status) == (4, "SNAPSHOT_REAL", "HISTORICAL", "live_occupancy_estimate", "estimated")
    assert s.calculation_metadata.dropped_cameras == {"one": ["cam-a"]} and s.calculation_metadata.selection_note == "duplicate_stream_camera_deduped"
    assert s.calculation_metadata.roi_status == "calibrated" and r.calculation_metadata.roi_status == "uncalibrated"
    assert s.priority == "mixed" and r.priority == "low" and r.calculation_metadata.dropped_cameras == {"one": ["cam-e"]}
    assert s.car_veh_h == 3 * 3600 / 300 and s.bus_veh_h == 3600 / 300 and s.car_vkt == 72.0 and r.car_veh_h == 24.0
    assert s.provenance.source_cameras == ["cam-b", "cam-c"] and s.provenance.source_streams == ["one", "two"] and s.provenance.source_observation_count == 2
    assert figures == [(0, {"emissions": 2, "emissions_high": 0, "emissions_medium": 0, "emissions_low": 1, "emissions_mixed": 1, "observations": 3})]
    before = table.versions()
    write(batch, 0)  # the stream runs it again
    assert table.versions() == before and len(figures) == 1
    write(spark.createDataFrame(observed(("cam-b", "S", "one", 15, "car", 6.0, True, None), ("cam-b", "S", "one", 700, "car", 1.0, True, None)), OBSERVED), 1)
    assert sorted((r.segment_id, r.period_start, r.car_veh_h, r.priority) for r in table.read().collect()) == [("R", 0, 24.0, "low"), ("S", 0, 72.0, "medium"), ("S", 600, 12.0, "medium")]
    assert table.read().where("calculation_metadata.selection_note IS NULL").count() == 2


# ---- vectors of names


def test_backfill(spark, tmp_path):
    table, asked = KeyedTable(spark, str(tmp_path / "names"), ["name_key"], 4), []

    def embed(names):
        asked.append(sorted(r.content for r in names.collect()))
        return names.withColumn("embedding", F.when(F.col("content") != "Broken", F.array(F.length("content").cast("double"), F.lit(1.0))))

    first = spark.createDataFrame([("SEG-1", "Jl. Malioboro"), ("SEG-2", "Jalan Malioboro"), ("SEG-3", "Solo"), ("SEG-4", "Broken"), ("SEG-5", None)], "segment_id string, segment_name string")
    assert backfill(table, first, embed) == {"new": 3, "changed": 0, "same": 0, "gone": 0}
    assert asked[-1] == ["Broken", "Jl. Malioboro malioboro", "Solo"]  # an alias is part of the content
    stored = {r.name_key: r for r in table.read().collect()}
    assert set(stored) == {"jalan malioboro", "solo"} and stored["jalan malioboro"].segment_ids == ["SEG-1", "SEG-2"] and stored["solo"].dim == 2
    good = first.where("segment_name <> 'Broken'")
    versions = table.versions()
    assert backfill(table, good, embed) == {"new": 0, "changed": 0, "same": 2, "gone": 0}
    assert table.versions() == versions and len(asked) == 1  # a second run embeds nothing and writes nothing
    other = spark.createDataFrame([("SEG-1", "Jalan MALIOBORO"), ("SEG-9", "Kenari")], "segment_id string, segment_name string")
    assert {r.name_key: r.change for r in name_changes(other, table.read()).collect()} == {"jalan malioboro": "changed", "kenari": "new", "solo": "gone"}
    assert backfill(table, other, embed) == {"new": 1, "changed": 1, "same": 0, "gone": 1}
    assert sorted(r.name_key for r in table.read().collect()) == ["jalan malioboro", "kenari"]


@pytest.mark.parametrize("n", [0])
def test_nothing_to_embed(spark, tmp_path, n):
    table = KeyedTable(spark, str(tmp_path / "names"), ["name_key"], 4)
    none = spark.createDataFrame([], "segment_id string, segment_name string")
    assert backfill(table, none, lambda names: names.withColumn("embedding", F.array(F.lit(1.0)))) == {"new": 0, "changed": 0, "same": 0, "gone": 0} and table.versions() == []
