"""Updates of a keyed table: untouched files, replays, writers side by side, versions, changes."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from roadlake.sources.buckets import KeyedTable, sink


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/data") for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), ["k"], 8)


def test_only_touched_buckets_are_written(spark, table):
    assert table.read() is None and table.delete(spark.range(1).toDF("k")) is None
    assert table.upsert(spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("v"))) == 0
    before = files(table.path)
    assert table.upsert(spark.createDataFrame([(5, 2), (5, 3), (2000, 7)], "k long, v int")) == 1
    after = files(table.path)
    buckets = {f.split("_bucket=")[1].split("/")[0] for f in after - before}
    assert len(buckets) <= 2 and before <= after  # the old version's files stay readable, two buckets at most are new
    got = dict(rows(table.read()))
    assert got[5] == 3 and got[2000] == 7 and got[6] == 1 and len(got) == 1001
    now = table.manifest()[0]["folders"]
    assert sum(f"{table.path}/{f}".split("/data/")[1].split("/")[0] == next(iter(before)).split("/data/")[1].split("/")[0] for f in now.values()) >= 6
    assert dict(rows(table.read(0)))[5] == 1  # a reader of the first version sees it whole
    assert rows(table.lookup(spark.createDataFrame([(5,), (6,), (7777,)], "k long"))) == [(5, 3), (6, 1)]


def test_a_batch_counts_once(spark, table):
    batch = spark.createDataFrame([(1, 1), (2, 2)], "k long, v int")
    assert table.upsert(batch, "q:0") == 0 and table.upsert(batch, "q:0") is None
    names = files(table.path)
    sink(table, "q")(spark.createDataFrame([(1, 9)], "k long, v int"), 0)
    assert files(table.path) == names and rows(table.read()) == [(1, 1), (2, 2)] and table.versions() == [0]
    sink(table, "q")(spark.createDataFrame([(1, 9)], "k long, v int"), 1)
    assert rows(table.read()) == [(1, 9), (2, 2)]
    assert table.upsert(spark.createDataFrame([], "k long, v int"), "q:2") is None


def test_newest_wins_over_what_is_stored(spark, table):
    table.upsert(spark.createDataFrame([(1, 50, "a"), (2, 50, "a")], "k long, at long, v string"), newest=["at"])
    table.upsert(spark.createDataFrame([(1, 40, "old"), (2, 50, "same"), (3, 1, "new")], "k long, at long, v string"), newest=["at"])
    assert rows(table.read()) == [(1, 50, "a"), (2, 50, "same"), (3, 1, "new")]


def test_writers_side_by_side(spark, table):
    table.upsert(spark.createDataFrame([(0, 0)], "k long, v int"))
    errors = []

    def write(i):
        try:
            KeyedTable(spark, table.path, ["k"], 8).upsert(spark.createDataFrame([(100 + i, i), (i % 3, i)], "k long, v int"))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    [t.start() for t in threads], [t.join() for t in threads]
    got = dict(rows(table.read()))
    assert not errors and {100, 101, 102, 103, 0, 1, 2} == set(got) and table.versions() == [0, 1, 2, 3, 4]


def test_a_dead_writer_is_passed_over(spark, table, monkeypatch):
    monkeypatch.setattr("roadlake.sources.buckets.WAIT", 0.1)
    table.upsert(spark.createDataFrame([(1, 1)], "k long, v int"))
    with open(f"{table.path}/manifests/1.json", "w") as f:
        f.write('{"version": 1, "fold')
    assert rows(table.read()) == [(1, 1)]
    assert table.upsert(spark.createDataFrame([(2, 2)], "k long, v int")) == 2
    assert rows(table.read()) == [(1, 1), (2, 2)] and table.versions() == [0, 2]


def test_deletes_versions_and_changes(spark, table):
    table.keep = 3
    table.upsert(spark.range(50).select(F.col("id").alias("k"), F.lit(0).alias("v")))
    for i in range(1, 4):
        table.upsert(spark.createDataFrame([(i, i)], "k long, v int"))
    table.delete(spark.createDataFrame([(7,), (8,)], "k long"))
    assert table.versions() == [2, 3, 4] and table.read().count() == 48
    assert rows(table.changes(2).select("k", "v", "change")) == [(3, 3, "upsert"), (7, None, "delete"), (8, None, "delete")]
    assert rows(table.changes(4)) == []
    used = {f for v in table.versions() for f in table._manifest(v)["folders"].values()}
    assert {f.split("/data/")[1].rsplit("/", 1)[0] for f in files(table.path)} == {f.removeprefix("data/") for f in used}  # nothing else is left
    with pytest.raises(ValueError):
        KeyedTable(spark, table.path, ["k"], 4).upsert(spark.createDataFrame([(1, 1)], "k long, v int"))


def test_a_new_column(spark, table):
    table.upsert(spark.createDataFrame([(1, 1)], "k long, v int"))
    table.upsert(spark.createDataFrame([(2, 2, "x")], "k long, v int, w string"))
    assert rows(table.read()) == [(1, 1, None), (2, 2, "x")]
