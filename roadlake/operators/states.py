"""Camera states and schedules, names, merges and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def health(attempts: DataFrame, key: str, order: list[str], failed: Column, threshold: int = 3) -> DataFrame:
    """Each key's state after its last attempt: failures in a row, online, degraded, or offline from the threshold on."""
    last_good = attempts.withColumn("_o", F.struct(*order)).withColumn("_f", failed)
    good = last_good.groupBy(key).agg(F.max(F.when(~F.col("_f"), F.col("_o"))).alias("_g"))
    n = last_good.join(good, key).groupBy(key).agg(F.count_if(F.col("_f") & (F.col("_g").isNull() | (F.col("_o") > F.col("_g")))).alias("failures"))
    return n.withColumn("status", F.when(F.col("failures") == 0, "online").when(F.col("failures") >= threshold, "offline").otherwise("degraded"))


def due(cameras: DataFrame, now: int, limit: int) -> DataFrame:
    """Rows that are due, never sampled ones first, at most `limit`: what a scheduler claims."""
    return cameras.where(F.col("next_at").isNull() | (F.col("next_at") <= now)).orderBy(F.asc_nulls_first("next_at"), "camera_id").limit(limit)


def interval(priority: Column, override: Column) -> Column:
    return F.coalesce(override, F.when(priority == "high", 30).when(priority == "medium", 60).otherwise(300))


def rescheduled(cameras: DataFrame, claimed: DataFrame, now: int) -> DataFrame:
    """cameras after a claim: the claimed ones (camera_id) are next due after their interval, by their own setting or their priority."""
    taken = claimed.select("camera_id", F.lit(True).alias("_taken"))
    df = cameras.join(taken, "camera_id", "left")
    return df.withColumn("next_at", F.when(F.col("_taken"), F.lit(now) + interval(F.col("priority"), F.col("override"))).otherwise(F.col("next_at"))).drop("_taken")


def colour_tier(co2: Column) -> Column:
    """500 and 1500."""
    return F.when(co2.isNull(), "none").when(co2 < 500, "low").when(co2 < 1500, "medium").otherwise("high")


def numbered(df: DataFrame, name: str, order: str) -> DataFrame:
    """Names that occur more than once get their ordinal."""
    n = df.groupBy(name).agg(F.count("*").alias("_n"))
    rank = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return df.join(n, name).withColumn("_r", rank).withColumn("shown", F.when(F.col("_n") > 1, F.concat(name, F.lit(" ("), F.col("_r").cast("string"), F.lit(")"))).otherwise(F.col(name))).drop("_n", "_r")


def merged_series(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Series of parts as one: sums of what is there, flags or-ed, the first method that is not null (by part)."""
    return series.groupBy(*keys).agg(F.sum(value).alias(value), F.bool_or("interpolated").alias("interpolated"), F.min_by("method", F.when(F.col("method").isNotNull(), F.col("part"))).alias("method"))


def verdict(rows: Column, with_value: Column, spread: Column) -> Column:
    return F.when(rows == 0, "empty").when((with_value == 0) | (spread == 0), "degenerate").otherwise("ok")


def renamed_pollutants(df: DataFrame) -> DataFrame:
    """Older rows: pm is tsp, nmvoc is hc, pollutants that weren't there are 0 and none is null."""
    for old, new in (("pm", "tsp"), ("nmvoc", "hc")):
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    for p in ("tsp", "nox", "so2", "hc", "co", "co2", "ch4", "n2o"):
        df = df.withColumn(p, F.coalesce(F.col(p), F.lit(0.0)) if p in df.columns else F.lit(0.0))
    return df


def top_entries(entries: Column, k: int) -> Column:
    """The k entries of a map with the greatest values, ties by key."""
    order = lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    return F.slice(F.array_sort(F.map_entries(entries), order), 1, k)
