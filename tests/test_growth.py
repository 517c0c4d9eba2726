"""Work that grows with the rows, not with the products of rows in one place."""

import pytest
from pyspark.sql import functions as F

from roadlake.operators import spatial as SP
from roadlake.plans import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_meet_once(spark):
    left = spark.range(3000).select("id", (F.col("id") % 2 * 1.0).alias("lon"), F.lit(0.0).alias("lat"))
    right = spark.range(2000).select(F.col("id").alias("of"), (F.col("id") % 4 * 0.001).alias("lon_r"), F.lit(0.0).alias("lat_r"))
    near = SP.places_within(left, right, 150)
    assert sorted((r.lon, r.lon_r) for r in near.collect()) == [(0.0, 0.0), (0.0, 0.001)]
    pairs = SP.within_distance(left.where("id < 100"), right.where("of < 80"), 150)
    assert pairs.columns == ["id", "lon", "lat", "of", "lon_r", "lat_r", "distance_m"]
    assert pairs.count() == 50 * 40 and pairs.where("id % 2 = 1 OR of % 4 > 1").isEmpty()


@pytest.mark.parametrize("name", ["poi_categories", "top_categories", "bus_stop_scores", "tolerance_match"])
def test_pairs_are_not_written(spark, name):
    seen = []
    within, SP.within_distance = SP.within_distance, lambda *a, **k: seen.append(a)
    try:
        QUERIES[name](spark, SF)
    finally:
        SP.within_distance = within
    assert not seen


def test_squares_are_not_broadcast(spark):
    assert "BroadcastHashJoin" not in plan(QUERIES["point_in_polygon"](spark, SF))


def test_texts_are_settled_once(spark):
    from roadlake.operators import texts as TX

    asks = spark.range(2000).select("id", F.concat(F.lit("halte "), (F.col("id") % 3).cast("string")).alias("q")).unionByName(spark.sql("SELECT 2000L AS id, CAST(NULL AS string) AS q"))
    each = TX.distinct_texts(asks)
    assert each.count() == 4 and each.select("id").distinct().count() == 4
    segments = spark.createDataFrame([("S1", "halte 1"), ("S2", "big road")], "segment_id string, segment_name string")
    got = TX.resolved_names(asks, segments)
    assert {(r.method, r.n) for r in got.groupBy("method").agg(F.count("*").alias("n")).collect()} == {("alias", 667), ("string", 1334)}
    assert got.where("id = 2000").first().method == "string"


def test_grams_need_no_lambdas(spark):
    from roadlake.operators import texts as TX

    df = spark.createDataFrame([("a\nbca\nb",)], "t string").select(TX.parts_of(F.col("t"), 3).alias("g"))
    assert "lambda" not in plan(df) and sorted(df.first().g) == ["\nbc", "a\nb", "bca", "ca\n"]


def test_series_of_a_cell_shuffles_no_other_cells(spark):
    from roadlake.operators import scoring as SC

    cells = spark.range(60).select(F.col("id").alias("hex_id"), (F.col("id") * 0.01).alias("lon"), F.lit(0.0).alias("lat"), F.col("id").cast("double").alias("norm_poi"), F.lit(1.0).alias("norm_population"), F.lit(7.0).alias("volume_mean"))
    volumes = spark.createDataFrame([(1, 3, 5.0), (1, 40, 9.0)], "hour long, hex_id long, volume double")
    hours = spark.createDataFrame([(1,), (2,)], "hour long")
    all_ = SC.hour_scores(cells, volumes, ["hour"], hours)
    want = {(r.hour, r.score, r["rank"]) for r in all_.where("hex_id = 30").collect()}
    assert {(r.hour, r.score, r["rank"]) for r in SC.cell_series(cells, volumes, ["hour"], hours, 30).collect()} == want and len(want) == 2


@pytest.mark.parametrize("name", ["segment_map", "display_facts_nn", "road_overview", "merged_contexts"])
def test_facts_are_read_once(spark, monkeypatch, name):
    from pyspark.sql.readwriter import DataFrameWriter

    reads, write = [], DataFrameWriter.parquet
    events = lambda df: reads.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation [event_id"))
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (events(self._df), write(self, *a, **k))[1])
    events(QUERIES[name](spark, SF))
    assert sum(reads) == 1


def test_facts_by_mode_hold_the_chosen(spark):
    from roadlake.operators import facts as FA

    rows = [(i, f"S{i % 3}", i % 4 * 100, i % 4 * 100 + (50 if i % 7 else 60), i % 5, i % 11, ("REPLAY", "LIVE", "CSV_HISTORY")[i * i % 3]) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, segment_id string, period_start long, period_end long, version int, calculated_us long, source_mode string")
    few, ids = FA.by_mode(df), lambda x: sorted(r.id for r in x.select("id").collect())
    assert few.count() < 60 and ids(FA.latest(few)) == ids(FA.latest(df)) and ids(FA.deduplicated(few)) == ids(FA.deduplicated(df))
    assert ids(FA.deduplicated(few.where("source_mode = 'REPLAY'"))) == ids(FA.deduplicated(df.where("source_mode = 'REPLAY'")))


def test_only_crossed_cells_are_written_and_asked(spark, monkeypatch):
    from roadlake.plans import evidence as EV
    from roadlake.plans.contexts import crossed_segments
    from roadlake.plans.queries import Tables

    asked, within = [], SP.places_within
    monkeypatch.setattr(SP, "places_within", lambda left, *a, **k: (asked.append(left), within(left, *a, **k))[1])
    t = Tables(spark, SF)
    EV.evidence(t)
    crossed = {r.hex_id for r in crossed_segments(t).collect()}
    assert len(asked) == 1 and {r.hex_id for r in asked[0].collect()} <= crossed


@pytest.mark.parametrize("name", ["hex_hour_scores", "hex_hourly_series", "live_grid"])
def test_facts_of_cells_are_read_once(spark, monkeypatch, name):
    test_facts_are_read_once(spark, monkeypatch, name)


def test_ranks_are_of_classes_not_of_the_product(spark, monkeypatch):
    from roadlake.operators import scoring as SC

    sizes, write = [], SC.written
    monkeypatch.setattr(SC, "written", lambda df, name: (t := write(df, name), sizes.append(t.count()))[0])
    cells = spark.range(3000).select(F.col("id").alias("hex_id"), (F.col("id") * 0.01).alias("lon"), F.lit(0.0).alias("lat"), (F.col("id") % 3).cast("double").alias("norm_poi"), F.lit(1.0).alias("norm_population"), F.lit(7.0).alias("volume_mean"))
    volumes = spark.createDataFrame([(h, c, 5.0 + h * c) for h in range(1, 13) for c in (3, 40)], "hour long, hex_id long, volume double")
    df = SC.hour_scores(cells, volumes, ["hour"], spark.range(1, 13).toDF("hour"))
    assert max(sizes) < 4000 and "Window" not in plan(df) and df.count() == 36_000


def test_equal_scores_are_ranked_together(spark, monkeypatch):
    import random

    from roadlake.operators import scoring as SC

    monkeypatch.setattr(SC, "BLOCK", 4)
    monkeypatch.setattr(SC, "CHUNK", 16)
    rng = random.Random(3)
    cells = [(i, None if i % 23 == 22 else rng.random(), rng.random(), rng.choice([None, 1.0, 2.0, 2.0]), rng.choice([1.0, 3.0]), rng.choice([None, 5.0, 9.0])) for i in range(150)]
    hours, seen = list(range(10)), [*rng.sample(range(150), 8), 22]
    volumes = [(h, c, rng.choice([4.0, 4.0, 8.0, 6.0]), c % 2 == 0, [f"S{c}"]) for h in hours[:-1] for c in seen if rng.random() < 0.5]
    cells_df = spark.createDataFrame(cells, "hex_id long, lon double, lat double, norm_poi double, norm_population double, volume_mean double")
    v = spark.createDataFrame(volumes, "hour long, hex_id long, volume double, interpolated boolean, segment_ids array<string>")
    asked = spark.createDataFrame([(h,) for h in hours], "hour long")
    got = {(r.hour, r.hex_id): r for r in SC.hour_scores(cells_df, v, ["hour"], asked).collect()}
    assert len(got) == 1500
    means = [c[5] for c in cells if c[5] is not None]
    for h in hours:
        own = {c: (vol, gap, ids) for k, c, vol, gap, ids in volumes if k == h}
        low, high = (min(x[0] for x in own.values()), max(x[0] for x in own.values())) if own else (min(means), max(means))
        scores = {}
        for i, x, y, poi, population, mean in cells:
            placed = [j for j in own if cells[j][1] is not None]
            source = i if i in own else None if x is None else min(placed, key=lambda j: ((cells[j][1] - x) ** 2 + (cells[j][2] - y) ** 2, j), default=None)
            used, r = own[source][0] if source is not None else mean, got[h, i]
            assert (r.source_id, r.used, r.status) == (None if i in own else source, used, "live" if i in own else "fallback" if used is not None else "no_data")
            assert r.interpolated == (own[source][1] if source is not None else False) and r.segment_ids == (own[i][2] if i in own else None)
            if used is not None and poi is not None:
                scores[i] = SC.cell_score(100.0 if high <= low else 1.0 + (used - low) / (high - low) * 99.0, poi, population)
        order = sorted(scores, key=lambda i: (-scores[i], i))
        assert {i: got[h, i]["rank"] for i in order} == {i: n for n, i in enumerate(order, 1)} and {got[h, i].total for i in order} == {len(order)}
        assert all(got[h, i]["rank"] is None and got[h, i].total is None for i in range(150) if i not in scores)
    for i in (7, 22, seen[0]):
        series = {(r.hour, r.score, r["rank"]) for r in SC.cell_series(cells_df, v, ["hour"], asked, i).collect()}
        assert series == {(h, got[h, i].score, got[h, i]["rank"]) for h in hours}


def test_small_groups_meet_all(spark, monkeypatch):
    points = lambda n, seed, *names: spark.range(n).select(F.col("id").alias(names[0]), (F.col("id") % 3).alias("g"), F.round(F.rand(seed), 1).alias(names[1]), F.round(F.rand(seed + 1), 1).alias(names[2]))
    left, right = points(300, 1, "id", "lon", "lat"), points(90, 5, "rid", "lon_r", "lat_r").where("g < 2 AND (g = 0 OR rid < 30)").cache()
    want = sorted(SP.nearest(left, right, ["id"], "rid", ["g"]).select("id", "rid").collect())
    for few in (128, 20, 0):
        monkeypatch.setattr(SP, "FEW", few)
        assert sorted(SP.nearest_in_small_groups(left, right, ["id"], "rid", ["g"]).collect()) == want and len(want) == 200


def test_distances_are_rounded_before_rows_meet(spark):
    text = QUERIES["poi_within_500m"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" in text and "round(" not in text[: text.index("Join")]
    left = spark.range(40).select("id", (F.col("id") % 7 * 0.001).alias("lon"), F.lit(0.0).alias("lat"))
    right = spark.range(30).select(F.col("id").alias("of"), (F.col("id") % 5 * 0.0013).alias("lon_r"), F.lit(0.0).alias("lat_r"))
    want = SP.within_distance(left, right, 300).select("id", "of", F.round("distance_m", 3).alias("d"))
    assert sorted(SP.within_distance(left, right, 300, digits=3).select("id", "of", "distance_m").collect()) == sorted(want.collect()) and want.count() > 100
