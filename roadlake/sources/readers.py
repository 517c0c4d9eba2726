"""Readers: GeoJSON, CSV with checks, XLSX and survey sheets, a seeded generator."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "struct<features: array<struct<type: string, geometry: struct<type: string, coordinates: array<double>>, properties: map<string, string>>>>"
LINES = POINTS.replace("coordinates: array<double>", "coordinates: array<array<double>>")
POLYGONS = POINTS.replace("coordinates: array<double>", "coordinates: array<array<array<double>>>")
MULTI = POINTS.replace("coordinates: array<double>", "coordinates: array<array<array<array<double>>>>")


def features(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """geometry and properties of each Feature of GeoJSON files."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", shape)["features"]).alias("f")).select("f.geometry", "f.properties")


def points(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) points: of type Point, with longitude and latitude in range."""
    df = features(spark, path, POINTS).withColumn("lon", F.try_element_at("geometry.coordinates", F.lit(1))).withColumn("lat", F.try_element_at("geometry.coordinates", F.lit(2)))
    good = F.coalesce((F.col("geometry.type") == "Point") & F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90), F.lit(False))
    return df.where(good), df.where(~good)


def lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) lines of at least two positions."""
    df = features(spark, path, LINES)
    good = F.coalesce((F.col("geometry.type") == "LineString") & (F.size("geometry.coordinates") >= 2), F.lit(False))
    return df.where(good), df.where(~good)


def zones(spark: SparkSession, path: str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) multi-polygons that have all required properties."""
    df = features(spark, path, MULTI)
    good = F.col("geometry.type") == "MultiPolygon"
    for p in required:
        good = good & F.col("properties")[p].isNotNull()
    return df.where(F.coalesce(good, F.lit(False))), df.where(~F.coalesce(good, F.lit(False)))


def grid(spark: SparkSession, path: str) -> DataFrame:
    """Polygon cells."""
    return features(spark, path, POLYGONS).where("geometry.type = 'Polygon'")


def verified(df: DataFrame, stored: str, computed: Column, tolerance: float = 0.01) -> DataFrame:
    """df; reading it fails where a stored score differs from the computed one by more than the tolerance."""
    fine = F.abs(F.col(stored) - computed) <= tolerance
    return df.withColumn(stored, F.when(F.coalesce(fine, F.lit(True)), F.col(stored)).otherwise(F.raise_error(F.concat(F.lit(f"{stored} differs: "), F.col(stored).cast("string")))))


HISTORY = "segment_id string, period_start string, period_end string, vehicle_count_semantics string, co2_kg_h string, nox_kg_h string"


def history_csv(spark: SparkSession, path: str, schema: str = HISTORY, numbers: tuple[str, ...] = ("co2_kg_h", "nox_kg_h")) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with `reason`) rows of a history: times with zone, end after start, finite numbers of at least 0, one row a segment and start."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    zone = r"(Z|[+-]\d\d:?\d\d)$"
    reason = F.when(~F.col("period_start").rlike(zone) | ~F.col("period_end").rlike(zone), "time without zone")
    df = df.withColumn("start", F.try_to_timestamp("period_start")).withColumn("end", F.try_to_timestamp("period_end"))
    reason = reason.when(F.col("start").isNull() | F.col("end").isNull() | (F.col("end") <= F.col("start")), "no period").when(F.coalesce(F.col("vehicle_count_semantics"), F.lit("")) != "snapshot_occupancy", "semantics")
    for c in numbers:
        x = F.expr(f"try_cast({c} as double)")
        reason = reason.when(F.col(c).isNotNull() & (x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")) | (x < 0)), f"number {c}")
        df = df.withColumn(f"{c}_value", x)
    df = df.withColumn("reason", reason)
    twice = df.groupBy("segment_id", "start").agg(F.count("*").alias("_n")).where("_n > 1")
    df = df.join(twice, ["segment_id", "start"], "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_n") > 1, "repeated"))).drop("_n")
    return df.where("reason IS NULL").drop("reason"), df.where("reason IS NOT NULL")


def activities_csv(spark: SparkSession, path: str) -> DataFrame:
    """Activities with a position as text "[lon,lat]" and media as JSON in a cell."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    at = F.from_json(F.col("`geometry.coordinates`"), "array<double>")
    return df.withColumn("lon", F.try_element_at(at, F.lit(1))).withColumn("lat", F.try_element_at(at, F.lit(2))).withColumn("medias", F.from_json("medias", "array<map<string,string>>"))


def is_yes(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)) == "ya", F.lit(False))


def checklist(df: DataFrame, columns: list[str], name: str = "checklist") -> DataFrame:
    """Yes-or-no columns as one map."""
    return df.withColumn(name, F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[is_yes(F.col(c)) for c in columns])))


def title_key(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def _cells(book: zipfile.ZipFile, sheet: str) -> Iterator[list[str | None]]:
    """The rows of a workbook's sheet as text, cells at their columns' places."""
    local = lambda e: e.tag.rpartition("}")[2]
    part = lambda e: "".join(x.text or "" for x in e.iter() if local(x) == "t")
    names = set(book.namelist())
    shared = [part(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    targets = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    ids = [next(v for k, v in e.attrib.items() if k.endswith("}id")) for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if local(e) == "sheet" and e.get("name") == sheet]
    if not ids:
        return
    path = targets[ids[0]].lstrip("/")
    for _, row in ElementTree.iterparse(book.open(path if path in names else f"xl/{path}")):
        if local(row) != "row":
            continue
        out: list[str | None] = []
        for cell in (c for c in row if local(c) == "c"):
            place = 0
            for letter in re.match("[A-Z]*", cell.get("r") or "")[0]:
                place = 26 * place + ord(letter) - 64
            out += [None] * (place - 1 - len(out))
            value = next((c.text for c in cell if local(c) == "v"), None)
            kind = cell.get("t")
            text = part(cell) if kind == "inlineStr" else shared[int(value)] if kind == "s" and value else value
            out.append({"0": "false", "1": "true"}.get(text, text) if kind == "b" else text)
        yield out
        row.clear()


def xlsx_sheet(spark: SparkSession, path: str, sheet: str, columns: list[str]) -> DataFrame:
    """Columns of one sheet of XLSX files, as text: the first row names them, blank rows are skipped, missing columns are null.

    A file without the sheet gives no rows; a file that is no workbook fails the query. Stored results of formulas are read. A file is one task's.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for content in (c for b in batches for c in b["content"]):
            rows = _cells(zipfile.ZipFile(io.BytesIO(content)), sheet)
            head = [(h or "").strip() for h in next(rows, [])]
            kept = [dict(zip(head, r, strict=False)) for r in rows if any((c or "").strip() for c in r)]
            yield pd.DataFrame([[r.get(c) for c in columns] for r in kept], columns=columns, dtype=object)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(read, ", ".join(f"`{c}` string" for c in columns))


def merged_sheets(sheets: list[DataFrame], title: str) -> DataFrame:
    """Sheets outer-merged by their normalized title; the first sheet's columns win."""
    out = None
    for i, s in enumerate(sheets):
        s = s.withColumn("title_key", title_key(F.col(title))).where("title_key <> ''")
        s = s.select("title_key", *[c for c in s.columns if c != "title_key" and (out is None or c not in out.columns)])
        out = s if out is None else out.join(s, "title_key", "full_outer")
    return out


def synthetic_facts(spark: SparkSession, segments: int, hours: int, seed: int = 42, only_missing: DataFrame | None = None) -> DataFrame:
    """Seeded synthetic facts: a base rate by segment and hour within 20 % and a fixed split of categories. 60, 25, 8 and 7 %.

    only_missing: facts (segment, hour) that exist; they are left out, the others have the values that they have without it.
    """
    df = spark.range(segments * hours).select((F.col("id") % segments).alias("segment"), F.floor(F.col("id") / segments).alias("hour"))
    base = (400 + 37 * (F.col("segment") % 11)) * (1 + 0.5 * F.sin(F.col("hour") * 0.2617993877991494)) * (0.8 + 0.4 * F.rand(seed))
    df = df.withColumn("volume", base)
    shares = {"motorcycle": 0.60, "car": 0.25, "bus": 0.08, "truck": 0.07}
    df = df.select("segment", "hour", *[(F.col("volume") * v).alias(f"{c}_veh_h") for c, v in shares.items()], F.lit("SYNTHETIC").alias("source_mode"))
    return df if only_missing is None else df.join(only_missing.select("segment", "hour"), ["segment", "hour"], "left_anti")
