"""Matching of surveyed places, details of forms, checks of factors and messages: fixed values."""

import pytest
from pyspark.sql import functions as F

from roadlake.operators import records, scoring
from roadlake.operators import surveys as SV
from roadlake.operators import traffic as T
from roadlake.schema import DISTANCE_FACTORS

PLACE = "lon double, lat double"
M = 1 / 111_194.9  # degrees of a metre


def test_matching(spark):
    stops = [("s1", "Halte A", 110.0, 0.0), ("s2", "Halte B", 110.1, 0.0), ("s3", " halte   C", 110.2, 0.0), ("s4", "Halte D", None, 0.0), ("s5", "Halte E", 110.3, 0.0), ("s6", "Halte C", 111.0, 0.0), ("s7", "Halte A", 112.0, 0.0)]
    sources = [("a", "x", 110.0 + 10 * M, 0.0), ("b", "x", 110.0 - 10 * M, 0.0), ("c", "HALTE C ", None, None), ("d", "Halte D", 113.0, 0.0), ("e", "far", 110.1 + 26 * M, 0.0), ("f", "Halte A", 110.0 + 20 * M, 0.0), ("g", None, 110.1 + 5 * M, 0.0)]
    st, so = spark.createDataFrame(stops, f"stop_id string, title string, {PLACE}"), spark.createDataFrame(sources, f"source_id string, title string, {PLACE}")
    m = SV.matched_places(st, so)
    got = {r.stop_id: (r.source_id, r.method, r.ambiguous, r.reason) for r in m.collect()}
    assert got == {
        "s1": ("a", "coordinates", True, None), "s2": ("g", "coordinates", False, None), "s3": ("c", "title", False, None), "s4": ("d", "title", False, None),
        "s5": (None, None, False, "beyond_tolerance"), "s6": (None, None, False, "beyond_tolerance"), "s7": ("f", "title", False, None),
    }
    assert SV.match_report(m, so).first().asDict() == {"stops": 7, "matched": 5, "by_coordinates": 2, "by_title": 3, "ambiguous": 1, "beyond_tolerance": 2, "no_coordinates": 0, "unmatched_sources": 2, "sources": 7}
    none = SV.matched_places(st, so.limit(0))
    assert {r.reason for r in none.collect()} == {"no_coordinates", "beyond_tolerance"} and SV.matched_places(st.limit(0), so).count() == 0


def test_details_of_forms(spark):
    df = spark.createDataFrame([(" Ya ", "3,5", "[110.3, -7.8]", "4"), ("tidak", "x", "[200, 0]", "0"), (None, None, "110.3,-7.8", None), ("true", "-2", "[1, 2, 3]", "7")], "a string, n string, c string, k string")
    rows = df.select(SV.yes(F.col("a")).alias("a"), SV.number(F.col("n")).alias("n"), SV.coordinates(F.col("c")).alias("c"), SV.breakdown({"k": F.col("k"), "l": F.lit(2)}).alias("k"), SV.checklist({"bench": F.col("a")}).alias("l")).collect()
    assert [r.a for r in rows] == [True, False, False, True] and [r.n for r in rows] == [3.5, None, None, -2.0]
    assert [r.c and tuple(r.c) for r in rows] == [(110.3, -7.8), None, None, None]
    assert [r.k for r in rows] == [{"k": 4, "l": 2}, {"l": 2}, {"l": 2}, {"k": 7, "l": 2}] and rows[0].l == {"bench": True} and rows[2].l == {"bench": False}
    import hashlib

    assert df.select(SV.source_key(F.lit("a"), F.lit(None), F.lit(3)).alias("k")).first().k == hashlib.sha1(b"a||3").hexdigest()
    listed = spark.createDataFrame([(1, None), (2, 5), (3, 9), (4, 5)], "id int, at int")
    assert [r.id for r in SV.newest_first(listed, "id", "at", 3).orderBy("place").collect()] == [3, 2, 4]


def test_factors_are_checked(spark):
    assert records.checked_factors(DISTANCE_FACTORS) is DISTANCE_FACTORS
    for bad in ({**DISTANCE_FACTORS, "car": (1.0,) * 7}, {**DISTANCE_FACTORS, "bus": (float("nan"),) * 8}, {k: v for k, v in DISTANCE_FACTORS.items() if k != "car"}, {**DISTANCE_FACTORS, "car": (-1.0,) * 8}):
        with pytest.raises(ValueError):
            T.tier2(spark.range(1), factors=bad)


def test_messages_are_checked(spark):
    names = [f"{p}_g_h" for p in ("tsp", "nox", "so2", "hc", "co", "co2", "ch4", "n2o")]
    rows = [[1.0] * 8, [None] * 8, [1.0] * 7 + [float("inf")], [float("nan")] + [1.0] * 7]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    assert [r.v for r in df.select(records.valid_messages(df).alias("v")).collect()] == [True, True, False, False]


def test_place_weights(spark):
    df = spark.createDataFrame([("Pendidikan",), ("Peribadatan",), ("none",), (None,)], "c string")
    assert [r.w for r in df.select(scoring.place_weight(F.col("c")).alias("w")).collect()] == [1.25, 0.7, 0.8, 0.8]
