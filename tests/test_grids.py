"""Hexagons, nearest points, hour scores, lines of many vertices, envelopes: fixed values, brute force, and what a scan may skip."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from roadlake.operators import hexagons as H
from roadlake.operators import lines as L
from roadlake.operators import profile as P
from roadlake.operators import scoring as SC
from roadlake.operators import spatial as SP
from roadlake.operators import traffic as T
from roadlake.plans import grids
from roadlake.plans.queries import Tables

# ---- hexagons


@pytest.mark.parametrize("resolution", [5, 6, 8, 10])
def test_points_lie_in_their_hexagons(spark, resolution):
    rng = random.Random(resolution)
    points = [(i, rng.uniform(110.0, 111.0), rng.uniform(-8.2, -7.4)) for i in range(600)]
    df = spark.createDataFrame(points, "i int, lon double, lat double").withColumn("cell", H.cell(F.col("lon"), F.col("lat"), resolution))
    df = df.withColumn("ring", H.ring(F.col("cell"), resolution)).withColumn("c", H.centre(F.col("cell"), resolution))
    df = df.withColumn("inside", SP.in_ring(F.col("lon"), F.col("lat"), F.slice("ring", 1, 6)))
    df = df.withColumn("again", H.cell(F.col("c.lon"), F.col("c.lat"), resolution)).withColumn("near", H.neighbours(F.col("cell"), resolution))
    size = H.edge_m(resolution)
    for r in df.collect():
        assert r.inside and r.again == r.cell and r.ring[0] == r.ring[6] and len(r.ring) == 7
        away = math.hypot((r.lon - r.c.lon) * H.WIDTH, (r.lat - r.c.lat) * H.DEGREE)
        assert away <= size * 1.000001 and r.cell not in r.near and len(set(r.near)) == 6
    one = df.select(F.explode("near").alias("n"), "c").withColumn("d", H.centre(F.col("n"), resolution))
    apart = one.select(F.hypot((F.col("c.lon") - F.col("d.lon")) * H.WIDTH, (F.col("c.lat") - F.col("d.lat")) * H.DEGREE).alias("m"))
    assert all(abs(r.m - size * H.ROOT3) < 1e-6 * size for r in apart.collect())


def test_parents_hold_about_seven_children(spark):
    cells = spark.range(200).crossJoin(spark.range(200).toDF("j")).select((110.3 + F.col("id") * 0.001).alias("lon"), (-7.9 + F.col("j") * 0.001).alias("lat"))
    c = cells.select(H.cell(F.col("lon"), F.col("lat"), 8).alias("c")).distinct().withColumn("p", H.parent(F.col("c"), 8))
    n = sorted(r["count"] for r in c.groupBy("p").count().collect())
    assert 6 <= n[len(n) // 2] <= 8 and max(n) <= 8
    assert spark.createDataFrame([(None, 1.0)], "lon double, lat double").select(H.cell(F.col("lon"), F.col("lat"), 8)).first()[0] is None


# ---- nearest


def test_nearest_by_brute_force_at_all_densities(spark):
    rng = random.Random(8)
    spread = lambda: rng.choice([1e-7, 1e-5, 1e-3, 0.1, 30.0])
    left = [(i, 110 + rng.gauss(0, spread()), -7 + rng.gauss(0, spread())) for i in range(250)] + [(900, None, 1.0)]
    right = [(i, 110 + rng.gauss(0, spread()), -7 + rng.gauss(0, spread()), f"n{i}") for i in range(250)]
    right += [(1000 + i, right[3][1], right[3][2], "copy") for i in range(50)]
    l, r = spark.createDataFrame(left, "id long, lon double, lat double"), spark.createDataFrame(right, "rid long, lon_r double, lat_r double, name string")  # noqa: E741
    got = {x.id: (x.rid, x.name) for x in SP.nearest(l, r, ["id"], "rid", carry=["name"]).collect()}
    assert got == {i: min(((x - p) ** 2 + (y - q) ** 2, j, n) for j, p, q, n in right)[1:] for i, x, y in left if x is not None}


def test_nearest_is_linear_in_density(spark):
    def seconds(n: int) -> float:
        points = lambda seed, a, b, k: spark.range(n).select(F.col("id").alias(k), (110 + 0.02 * F.rand(seed)).alias(a), (-7 + 0.02 * F.rand(seed + 1)).alias(b))
        began = time.perf_counter()
        assert SP.nearest(points(1, "lon", "lat", "id"), points(3, "lon_r", "lat_r", "rid"), ["id"], "rid").count() == n
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(16_000) < 2.5 * seconds(8_000)


# ---- scores of an hour; expected values as published for these inputs


def scored(spark, cells, volumes, hours=("h",), mapped=None):
    cells = spark.createDataFrame(cells, "hex_id long, lon double, lat double, norm_poi double, norm_population double, volume_mean double")
    v = spark.createDataFrame(volumes, "hour string, hex_id long, volume double, interpolated boolean, segment_ids array<string>")
    m = spark.createDataFrame(mapped, "hour string, hex_id long") if mapped is not None else None
    df = SC.hour_scores(cells, v, ["hour"], spark.createDataFrame([(h,) for h in hours], "hour string"), m)
    return {(r.hour, r.hex_id): r for r in df.collect()}


def test_a_cell_without_sample_borrows_the_nearest(spark):
    cells = [(1, 0.0, 0.0, 0.0, 0.0, 10.0), (2, 0.01, 0.0, 0.0, 0.0, 20.0), (3, 1.0, 0.0, 0.0, 0.0, 30.0)]
    got = scored(spark, cells, [("h", 1, 10.0, True, ["SEG-2"]), ("h", 3, 30.0, False, ["SEG-1"])], mapped=[("h", 2)])
    two = got["h", 2]
    assert (two.status, two.source_id, two.reason, two.interpolated) == ("fallback", 1, "mapped_but_no_volume", True) and two.norm == pytest.approx(1.0)
    assert got["h", 3].norm == pytest.approx(100.0) and got["h", 3].reason is None and got["h", 3].segment_ids == ["SEG-1"]
    assert got["h", 1].interpolated and not got["h", 3].interpolated


def test_nothing_observed_takes_the_means(spark):
    got = scored(spark, [(1, 0.0, 0.0, 0.0, 0.0, 10.0), (2, 1.0, 0.0, 0.0, 0.0, 20.0)], [])
    assert got["h", 1].status == got["h", 2].status == "fallback" and got["h", 1].source_id is None
    assert got["h", 1].norm == pytest.approx(1.0) and got["h", 2].norm == pytest.approx(100.0) and got["h", 2].rank == 1
    none = scored(spark, [(1, 0.0, 0.0, 50.0, 50.0, None), (2, 1.0, 0.0, 50.0, 50.0, None)], [])
    assert {(r.status, r.norm, r.score, r["rank"], r["class"], r.reason) for r in none.values()} == {("no_data", None, None, None, None, "no_mapped_segment")}


def test_static_parts_with_live_volume(spark):
    got = scored(spark, [(1, 0.0, 0.0, 100.0, 100.0, None), (2, 1.0, 0.0, 0.0, 0.0, None)], [("h", 1, 10.0, False, []), ("h", 2, 20.0, False, [])])
    w = SC.CELL_WEIGHTS
    assert got["h", 1].score == pytest.approx(w["volume"] + (w["poi"] + w["population"]) * 100)
    assert (got["h", 2]["rank"], got["h", 2]["class"], got["h", 1]["rank"], got["h", 1]["class"]) == (1, "Sedang", 2, "Sangat Rendah")


def test_a_cell_without_place_or_mean_has_no_data(spark):
    got = scored(spark, [(1, 0.0, 0.0, 50.0, 50.0, None), (2, None, None, 50.0, 50.0, None)], [("h", 1, 5.0, False, [])])
    assert got["h", 1].status == "live" and got["h", 1].norm == 100.0
    assert (got["h", 2].status, got["h", 2].score, got["h", 2].reason) == ("no_data", None, "no_mapped_segment")


def test_hours_by_brute_force(spark):
    rng = random.Random(6)
    cells = [(i, rng.random(), rng.random(), 1.0 + rng.random(), 1.0 + rng.random(), rng.choice([None, 50 * rng.random()])) for i in range(60)]
    hours = [f"h{i}" for i in range(12)]
    seen = rng.sample(range(60), 9)
    volumes = [(h, c, 100 * rng.random(), False, []) for h in hours[:-1] for c in seen if rng.random() < 0.6]
    got = scored(spark, cells, volumes, hours)
    assert len(got) == 60 * 12
    for h in hours:
        own = {c: v for k, c, v, *_ in volumes if k == h}
        means = [c[5] for c in cells if c[5] is not None]
        low, high = (min(own.values()), max(own.values())) if own else (min(means), max(means))
        scores = {}
        for i, x, y, poi, population, mean in cells:
            source = i if i in own else min(own, key=lambda j: ((cells[j][1] - x) ** 2 + (cells[j][2] - y) ** 2, j), default=None)
            used = own[source] if source is not None else mean
            assert got[h, i].source_id == (None if i in own else source)
            if used is not None:
                norm = 100.0 if high <= low else 1 + (used - low) / (high - low) * 99
                w = SC.CELL_WEIGHTS
                scores[i] = w["volume"] * norm + w["poi"] * poi + w["population"] * population
        order = sorted(scores, key=lambda i: (-got[h, i].score, i))
        assert all(got[h, i].score == pytest.approx(scores[i]) for i in scores) and {i: got[h, i]["rank"] for i in order} == {i: n for n, i in enumerate(order, 1)}
        assert {i for (k, i), r in got.items() if k == h and r["rank"] is None} == {c[0] for c in cells} - set(scores)


def test_ranks_inside_keys(spark):
    df = spark.range(60_000, numPartitions=4).select("id", F.when(F.col("id") % 10 < 7, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"), F.when(F.col("id") % 3 == 0, 5.0).when(F.col("id") % 101 != 5, F.hash("id").cast("double")).alias("s"))
    got = SC.ranked_within(df, ["k"], "s", "id", parts=16).cache()
    want = df.selectExpr("id", "case when s is not null then row_number() over (partition by k order by s desc nulls last, id) end as want")
    assert got.join(want, "id").where("NOT (rank <=> want)").count() == 0 and got.count() == 60_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


# ---- a city's totals


def test_city_totals(spark):
    cameras = [("a", True, "LIVE"), ("b", True, "REPLAY"), ("c", False, "LIVE"), ("d", True, "LIVE")]
    newest = [("a", 1000, 1.234, 10.0), ("b", 900, 2.0, 5.0), ("c", 1500, 4.0, 100.0), ("x", 100, 8.0, 1.0)]
    cams = spark.createDataFrame(cameras, "camera_id string, is_active boolean, data_source string")
    last = spark.createDataFrame(newest, "camera_id string, last_captured_at long, co2_g_min double, car double")
    got = T.city_totals(cams, last, [("co2_g_min", 2), ("car", 4)], 1030, 30, 90).first()
    # what is added up is every camera's, what is counted the active ones'
    assert got.asDict() == {"cameras": 3, "live": 2, "historical": 1, "fresh": 1, "stale": 1, "last_captured_at": 1500, "freshness_status": "fresh", "co2_g_min": 15.23, "car": 116.0}
    none = T.city_totals(cams.where("not is_active"), last, [("co2_g_min", 2), ("car", 4)], 1030, 30, 90).first()
    assert (none.cameras, none.last_captured_at, none.freshness_status, none.co2_g_min, none.car) == (0, None, "unknown", 0.0, 0.0)


def test_profile_anchor(spark):
    rows = [(3600, "REPLAY"), (7200, "REPLAY"), (36000, "LIVE")]
    df = spark.createDataFrame(rows, "period_start long, source_mode string")
    assert P.anchor(df).first().anchor == 7200 and P.anchor(df.where("source_mode = 'LIVE'")).first().anchor == 36000
    assert [r.hour for r in P.available_hours(P.anchor(df)).collect()] == [7200 - 3600 * i for i in range(23, -1, -1)]
    assert P.available_hours(P.anchor(df.limit(0))).count() == 0


def test_lenses(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    with pytest.raises(ValueError):
        grids.grid(t, "tomorrow")
    for box in ((111.0, -7.8, 110.0, -7.7), (110.0, -7.7, 111.0, -7.8), (110.0, -91.0, 111.0, -7.0)):
        with pytest.raises(ValueError):
            grids.grid(t, box=box)
    cells, breaks = grids.grid(t, box=(0.0, 0.0, 1.0, 1.0))
    assert cells.count() == 0 and breaks.first().breaks is None


# ---- lines and polygons


def path(rng, n):
    x, y = rng.uniform(110, 110.2), rng.uniform(-7.9, -7.7)
    out = []
    for _ in range(n):
        out.append((x, y))
        x, y = x + rng.uniform(-0.03, 0.03), y + rng.choice([0.0, rng.uniform(-0.03, 0.03)])
    return out


def test_lines_by_brute_force(spark):
    rng = random.Random(12)
    lines = [(i, path(rng, rng.choice([1, 2, 5, 5, 9]))) for i in range(40)] + [(90, []), (91, None)]
    points = [(i, rng.uniform(110, 110.2), rng.uniform(-7.9, -7.7)) for i in range(200)]
    df = spark.createDataFrame(lines, "line int, path array<struct<lon: double, lat: double>>")
    pts = spark.createDataFrame(points, "point int, lon double, lat double")

    def away(px, py, a, b):
        k = math.pi / 180 * 6_371_000.0
        ax, ay, bx, by = ((a[0] - px) * math.cos(math.radians(py)) * k, (a[1] - py) * k, (b[0] - px) * math.cos(math.radians(py)) * k, (b[1] - py) * k)
        dx, dy = bx - ax, by - ay
        t = max(0.0, min(1.0, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        return math.hypot(ax + t * dx, ay + t * dy)

    want = {}
    for i, x, y in points:
        for j, p in lines:
            if p and (d := min(away(x, y, a, b) for a, b in zip(p, p[1:] or p))) <= 700:
                want[i, j] = d
    got = {(r.point, r.line): r.distance_m for r in L.points_near(pts, df, "point", "line", 700.0).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want) and len(want) > 30
    boxes = {(r.line, r.point): r.overlap for r in L.in_boxes(df, pts, "line", "point", 0.004).collect()}
    for j, p in lines:
        for i, x, y in points:
            steps = [(a[0] + (b[0] - a[0]) * (s + 0.5) / 400, a[1] + (b[1] - a[1]) * (s + 0.5) / 400, math.dist(a, b) / 400) for a, b in zip(p or [], (p or [])[1:]) for s in range(400)]
            about = sum(w for u, v, w in steps if abs(u - x) <= 0.004 and abs(v - y) <= 0.004)
            assert abs(boxes.get((j, i), 0.0) - about) < 1e-3


def test_envelopes_by_brute_force(spark):
    rng = random.Random(3)

    def star(n):
        x, y = rng.uniform(0, 10), rng.uniform(0, 10)
        return [(x + (r := rng.uniform(0.3, 3)) * math.cos(2 * math.pi * i / n), y + r * math.sin(2 * math.pi * i / n)) for i in range(n)]

    rings = [(i, star(rng.choice([3, 4, 7]))) for i in range(150)]
    df = L.with_bounds(spark.createDataFrame(rings, "i int, ring array<struct<lon: double, lat: double>>"))

    def inside(x, y, ring):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            odd ^= (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
        return odd

    for left, low, right, high in ((4, 4, 6, 6), (4.9, 4.9, 5.0, 5.0), (0, 0, 10, 10), (20, 20, 21, 21)):
        some = [(left + (right - left) * a / 60, low + (high - low) * b / 60) for a in range(61) for b in range(61)]
        want = {i for i, ring in rings if any(left <= x <= right and low <= y <= high for x, y in ring) or any(inside(x, y, ring) for x, y in some)}
        got = {r.i for r in L.in_envelope(df, left, low, right, high).collect()}
        assert want <= got and all(i in want or abs(left - right) > 1 for i in got - want) and len(got - want) <= 2  # a corner may only be grazed
    with pytest.raises(ValueError):
        L.in_envelope(df, 5, 0, 4, 1)


def test_clustered_files_are_skipped(spark, tmp_path):
    import pyarrow.parquet as pq

    cells = spark.range(40_000).select(F.col("id"), (F.rand(1) * 300 - 150).alias("x"), (F.rand(2) * 120 - 60).alias("y"))
    corner = lambda a, b: F.struct((F.col("x") + a).alias("lon"), (F.col("y") + b).alias("lat"))
    df = cells.select("id", F.array(corner(0, 0), corner(0.2, 0), corner(0.1, 0.2)).alias("ring"))
    path = str(tmp_path / "polygons")
    L.clustered(df, parts=16).write.option("parquet.block.size", 64 * 1024).parquet(path)
    plain = L.with_bounds(df)
    box = (10.0, 10.0, 14.0, 14.0)
    stored = spark.read.parquet(path)
    found = L.in_envelope(stored, *box)
    assert sorted(r.id for r in found.select("id").collect()) == sorted(r.id for r in L.in_envelope(plain, *box).select("id").collect())
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = L.in_envelope(stored, *box)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "LessThanOrEqual(xmin" in plan and "GreaterThanOrEqual(xmax" in plan
    groups = read = 0
    for f in (tmp_path / "polygons").glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = {meta.schema.column(i).path: i for i in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            s = {k: meta.row_group(g).column(at[k]).statistics for k in L.BOUNDS}
            groups += 1
            read += s["xmin"].min <= box[2] and s["xmax"].max >= box[0] and s["ymin"].min <= box[3] and s["ymax"].max >= box[1]
    assert groups >= 16 and read <= groups / 4
