"""Rates: mean per segment first, then sums across segments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlake.functions.scalars import bucket
from roadlake.schema import CATEGORIES, POLLUTANTS

KEYS = ["segment_id", "segment_name", "corridor_id", "corridor_name"]
RATES = [f"{p}_kg_h" for p in POLLUTANTS]
VEHICLES = [f"{c}_veh_h" for c in CATEGORIES]
VKT = [f"{c}_vkt" for c in CATEGORIES]
def estimated() -> Column:
    return F.count_if(F.col("semantics") == "snapshot_occupancy").alias("estimated_sample_count")



def _keys(facts: DataFrame, width: int | None) -> tuple[DataFrame, list[str]]:
    return (facts.withColumn("bucket", bucket(F.col("period_start"), width)), ["bucket", *KEYS]) if width else (facts, KEYS)


def segment_means(facts: DataFrame, width: int | None = None) -> DataFrame:
    """Mean rates in kg/h of each segment (and bucket). Missing stays missing."""
    facts, keys = _keys(facts, width)
    means = [F.avg(F.col(f"{p}_g_h") / 1000.0).alias(f"{p}_kg_h") for p in POLLUTANTS]
    return facts.groupBy(*keys).agg(*means, F.count("*").alias("sample_count"), F.max("period_end").alias("observed_at"), estimated())


def summed(columns: list[str]) -> list[Column]:
    return [F.round(F.sum(c), 6).alias(c) for c in columns]


COUNTS = ["sample_count", "estimated_sample_count"]


def trend(facts: DataFrame, width: int) -> DataFrame:
    return segment_means(facts, width).groupBy("bucket").agg(*summed(RATES), F.count("*").alias("segment_count"), *[F.sum(c).alias(c) for c in COUNTS])


def top_corridors(facts: DataFrame, limit: int, pollutant: str = "co2") -> DataFrame:
    out = segment_means(facts).groupBy("corridor_id", "corridor_name").agg(
        *summed(RATES), F.concat_ws(",", F.sort_array(F.collect_list("segment_id"))).alias("segment_ids"), *[F.sum(c).alias(c) for c in COUNTS], F.max("observed_at").alias("observed_at")
    )
    out = out.orderBy(F.desc_nulls_last(f"{pollutant}_kg_h"), "corridor_id").limit(limit)
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(f"{pollutant}_kg_h"), "corridor_id")))  # over `limit` rows


def composition(facts: DataFrame) -> DataFrame:
    return segment_means(facts).agg(*summed(RATES), *[F.sum(c).alias(c) for c in COUNTS])


def vehicle_means(facts: DataFrame, width: int | None = None) -> DataFrame:
    facts, keys = _keys(facts, width)
    return facts.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in VEHICLES + VKT], F.count("*").alias("sample_count"), estimated())


def vehicle_totals(facts: DataFrame) -> DataFrame:
    return vehicle_means(facts).agg(*summed(VEHICLES + VKT), *[F.sum(c).alias(c) for c in COUNTS])


def vehicle_series(facts: DataFrame, width: int) -> DataFrame:
    return vehicle_means(facts, width).groupBy("bucket").agg(*summed(VEHICLES), F.count("*").alias("segment_count"))


def vehicle_ranking(facts: DataFrame, limit: int) -> DataFrame:
    total = reduce(lambda a, b: a + b, map(F.col, VEHICLES))  # null if any is null
    out = vehicle_means(facts).withColumn("total_veh_h", F.round(total, 6)).orderBy(F.desc_nulls_last("total_veh_h"), "segment_id").limit(limit)
    return out.select("segment_id", "segment_name", "corridor_name", *[F.round(c, 6).alias(c) for c in VEHICLES], "total_veh_h", *COUNTS)


def vehicle_shares(facts: DataFrame) -> DataFrame:
    t = vehicle_means(facts).agg(*[F.sum(c).alias(c) for c in VEHICLES])
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in VEHICLES])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("key"), F.col(f"{c}_veh_h").alias("v")) for c in CATEGORIES]))
    out = t.withColumn("total", total).select("total", rows.alias("r"))
    return out.select(F.col("r.key").alias("category"), F.round("r.v", 6).alias("vehicles_per_hour"), F.round(F.when(F.col("total") != 0, F.col("r.v") / F.col("total")), 9).alias("share"))


def latest_summary(latest: DataFrame, now: int) -> DataFrame:
    """A pollutant's total only if every segment has it."""
    totals = [F.round(F.when(F.count(f"{p}_g_h") == F.count("*"), F.sum(F.col(f"{p}_g_h") / 1000.0)), 6).alias(f"{p}_kg_h") for p in POLLUTANTS]
    return latest.agg(*totals, F.count("*").alias("segments"), F.min("period_end").alias("oldest"), F.max(F.lit(now) - F.col("period_end")).alias("max_age"))


def history(facts: DataFrame, sort: str, descending: bool, page: int, size: int) -> DataFrame:
    """A page of facts in a whitelisted order; rows of the same place in it by segment and id."""
    if sort not in ("period_start", "segment_name", "corridor_name", "source_mode"):
        raise ValueError(f"no such order: {sort}")
    order = F.desc(sort) if descending else F.asc(sort)
    total = F.round(reduce(lambda a, b: a + b, [F.col(f"{p}_g_h") / 1000.0 for p in POLLUTANTS]), 6)
    out = facts.orderBy(order, "segment_id", "period_start", "id").offset((page - 1) * size).limit(size)
    return out.select("id", "segment_id", "segment_name", "corridor_id", "period_start", "source_mode", F.when(F.col("semantics") == "snapshot_occupancy", "estimated").otherwise("observed").alias("quality"), total.alias("total_kg_h"))


def hourly_history(facts: DataFrame) -> DataFrame:
    """Means of the sums of what is there, by the hour of the period's end; every fact counts, also recalculated ones."""
    some = lambda cs: reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in cs])
    rows = facts.select("segment_id", bucket(F.col("period_end"), 3600).alias("hour"), some([f"{p}_g_h" for p in POLLUTANTS]).alias("e"), some(VEHICLES).alias("v"))
    return rows.groupBy("segment_id", "hour").agg(F.round(F.avg("e"), 6).alias("emission_g_h"), F.round(F.avg("v"), 6).alias("vehicles_h"), F.count("*").alias("facts"))
