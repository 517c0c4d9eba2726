"""Writers: keyed upserts as table versions, guarded exports, GeoJSON."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlake.functions.scalars import formula_guard
from roadlake.operators.facts import first_of
from roadlake.schema import MAX_DELETE, MAX_EXPORT


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """Whole versions of a table: folders v=N with a success mark."""
    fs, p = _files(spark, path)
    if not fs.exists(p):
        return []
    names = [(s.getPath().getName(), s.getPath()) for s in fs.listStatus(p)]
    mark = lambda q: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(q, "_SUCCESS"))
    return sorted(int(n[2:]) for n, q in names if n.startswith("v=") and mark(q))


def latest_version(spark: SparkSession, path: str) -> DataFrame | None:
    own = versions(spark, path)
    return spark.read.parquet(f"{path}/v={own[-1]}") if own else None


def _claimed(spark: SparkSession, path: str) -> int:
    """A version number that no other writer has or can take: a claim is a file that can be made once."""
    fs, p = _files(spark, path)
    number = max([int(n[2:]) for s in fs.listStatus(p) if (n := s.getPath().getName()).startswith("v=")] + [-1] if fs.exists(p) else [-1]) + 1
    while True:
        try:
            fs.create(spark._jvm.org.apache.hadoop.fs.Path(p, f".claim-{number}"), False).close()
            return number
        except Py4JJavaError as e:
            if "xist" not in str(e.java_exception):
                raise
            number += 1


def write_version(df: DataFrame, path: str, keep: int = 8) -> None:
    """Writes the next version and drops all but the last `keep`; readers of latest_version() see the old or the new one, whole.

    Two writers never write one version; of two that start from the same one the later one's result stands. sources.buckets has updates
    that keep both and rewrite only what they touch.
    """
    spark = df.sparkSession
    number = _claimed(spark, path)
    df.write.mode("overwrite").parquet(f"{path}/v={number}")
    for n in versions(spark, path)[:-keep]:
        fs, p = _files(spark, f"{path}/v={n}")
        fs.delete(p, True)
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".claim-{n}"), False)


def upsert(new: DataFrame, path: str, keys: list[str], order: list[str] | None = None) -> None:
    """Rows of new replace those of the same keys. Of equal keys inside new the one with the greatest order columns wins, then the greatest row."""
    old = latest_version(new.sparkSession, path)
    ties = [F.desc(c) for c in [*(order or []), *(c for c in new.columns if c not in keys and new.schema[c].dataType.typeName() != "map")]]
    merged = new.withColumn("_new", F.lit(1)) if old is None else new.withColumn("_new", F.lit(1)).unionByName(old.withColumn("_new", F.lit(0)))
    write_version(first_of(merged, keys, F.desc("_new"), *ties).drop("_new"), path)


def insert_missing(new: DataFrame, path: str, keys: list[str]) -> None:
    """Insert or skip: keys that are there stay as they are."""
    old = latest_version(new.sparkSession, path)
    new = new.dropDuplicates(keys)
    write_version(new if old is None else old.unionByName(new.join(old, keys, "left_anti").select(old.columns)), path)


def replace_where(new: DataFrame, path: str, column: str, value: str) -> None:
    """All rows with column = value are replaced by new, at once."""
    old = latest_version(new.sparkSession, path)
    write_version(new if old is None else old.where(~F.col(column).eqNullSafe(value)).unionByName(new), path)


def page_scope(matching: DataFrame, order: list, page: int, size: int, scope: str) -> DataFrame:
    """The rows of a page of an ordered list (scope "page"), or those behind it ("beyond"), of all that match ("all")."""
    if scope == "all":
        return matching
    if scope == "page":
        return matching.orderBy(*order).offset((page - 1) * size).limit(size)
    if scope == "beyond":
        return matching.orderBy(*order).offset(page * size)
    raise ValueError(f"no such scope: {scope}")


def delete_matching(path: str, spark: SparkSession, matching: DataFrame, keys: list[str], dry_run: bool = True) -> int:
    """Deletes rows by key, at most MAX_DELETE; a dry run only counts. One new version instead of batches: readers see all of it or nothing."""
    n = matching.select(*keys).distinct().count()
    if n > MAX_DELETE:
        raise ValueError(f"{n} rows are more than one request may delete")
    if not dry_run and versions(spark, path):  # a table that isn't there has nothing to delete
        write_version(latest_version(spark, path).join(matching.select(*keys).distinct(), keys, "left_anti"), path)
    return n


def close_mappings(mappings: DataFrame, target: DataFrame, now: int) -> DataFrame:
    """Slowly changing mappings: of the target segments' cameras only the target mapping stays active, others end now unless they had ended."""
    t = target.select("camera_id", "segment_id").withColumn("_target", F.lit(True))
    owners = target.select("segment_id").distinct().withColumn("_owned", F.lit(True))
    cams = target.select("camera_id").distinct().withColumn("_moved", F.lit(True))
    df = mappings.join(t, ["camera_id", "segment_id"], "left").join(owners, "segment_id", "left").join(cams, "camera_id", "left")
    on, off = F.coalesce("_target", F.lit(False)), F.coalesce(F.col("_owned"), F.lit(False)) | F.coalesce(F.col("_moved"), F.lit(False))
    df = df.withColumn("valid_to", F.when(on, F.lit(None).cast("long")).when(off, F.coalesce("valid_to", F.lit(now).cast("long"))).otherwise(F.col("valid_to")))
    return df.withColumn("is_active", F.when(on, True).when(off, False).otherwise(F.col("is_active"))).select(mappings.columns)


def export_csv(df: DataFrame, path: str, fields: list[str] | None = None, order: list[str] | None = None) -> None:
    """A CSV of one file with byte order mark and header: the given fields (missing ones empty), nested columns as JSON, text that a spreadsheet would run quoted.

    At most MAX_EXPORT rows, which is what bounds the one task that writes them.
    """
    check_export(df)
    columns = []
    for name in fields or df.columns:
        kind = df.schema[name].dataType.typeName() if name in df.columns else "void"
        c = F.to_json(name) if kind in ("struct", "map", "array") else F.lit("") if kind == "void" else F.col(name)
        columns.append((formula_guard(c) if kind in ("string", "struct", "map", "array") else c.cast("string")).alias(name))
    line = F.to_csv(F.struct(*columns), {"quoteAll": "true", "escape": '"', "nullValue": "", "emptyValue": ""})
    place = F.struct(*[F.col(c) for c in order or []], F.lit(0)) if order else F.lit(0)
    lines = df.select(place.alias("place"), line.alias("line")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]).alias("lines"))
    head = "\ufeff" + ",".join('"' + name.replace('"', '""') + '"' for name in fields or df.columns)
    lines.select(F.array_join(F.concat(F.array(F.lit(head)), "lines"), "\n").alias("value")).write.mode("overwrite").text(path)


def export_json(df: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """One JSON document {"metadata": ..., "data": [...]}; metadata has the number of rows beside what is given. At most MAX_EXPORT rows."""
    check_export(df)
    given = [F.lit(v).alias(k) for k, v in (metadata or {}).items()]
    data = df.agg(F.struct(*given, F.count("*").alias("row_count")).alias("metadata"), F.collect_list(F.struct(*df.columns)).alias("data"))
    data.select(F.to_json(F.struct("metadata", "data"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def check_export(df: DataFrame) -> None:
    if df.limit(MAX_EXPORT + 1).count() > MAX_EXPORT:
        raise ValueError(f"more than {MAX_EXPORT} rows to export")


def geojson_points(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One Feature a row as JSON text, coordinates with five decimals, all other columns as properties."""
    rest = [c for c in df.columns if c not in (lon, lat)]
    point = F.struct(F.lit("Point").alias("type"), F.array(F.round(lon, 5), F.round(lat, 5)).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*rest).alias("properties"))).alias("feature"))


def geojson_lines(df: DataFrame, points: str = "line") -> DataFrame:
    """One LineString Feature a row as JSON text; `points` is an array of (lon, lat), all other columns are properties."""
    return _features(df, points, "LineString", lambda c: c)


def geojson_polygons(df: DataFrame, ring: str = "ring") -> DataFrame:
    """One Polygon Feature a row as JSON text; `ring` is an array of (lon, lat), closed if it isn't."""

    def closed(c: Column) -> Column:
        same = (F.element_at(c, 1)[0] == F.element_at(c, -1)[0]) & (F.element_at(c, 1)[1] == F.element_at(c, -1)[1])
        return F.array(F.when(same, c).otherwise(F.concat(c, F.slice(c, 1, 1))))

    return _features(df, ring, "Polygon", closed)


def _features(df: DataFrame, points: str, kind: str, shape) -> DataFrame:
    rest = [c for c in df.columns if c != points]
    pairs = F.transform(points, lambda p: F.array(F.round(p["lon"], 5), F.round(p["lat"], 5)))
    geometry = F.struct(F.lit(kind).alias("type"), shape(pairs).alias("coordinates"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*rest).alias("properties")), {"ignoreNullFields": "false"}).alias("feature"))


def unexpired(states: DataFrame, now: int, seconds: int = 120, written: str = "processed") -> DataFrame:
    """States of a table with time to live: those written at most so many seconds ago."""
    return states.where(F.col(written) + seconds > now)


def append_log(df: DataFrame, path: str) -> None:
    """Appends rows to a CSV log with header."""
    df.write.mode("append").option("header", True).csv(path)
