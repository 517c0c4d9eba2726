"""Facts as records for users: metrics from JSON, freshness on two levels, curated and full shapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.functions.scalars import freshness
from roadlake.operators.facts import first_of
from roadlake.schema import AGING_SECONDS, CATEGORIES, POLLUTANTS, UNITS, WINDOW_SECONDS


def json_number(text: str | Column, key: str) -> Column:
    """A number of a JSON object; null where the key is missing or holds no number."""
    return F.get_json_object(text, f"$.{key}").try_cast("double")


def json_flag(text: str | Column, path: str) -> Column:
    """Whether the value at a path is true; false where it is missing."""
    return F.coalesce(F.get_json_object(text, f"$.{path}") == "true", F.lit(False))


def json_or(text: str | Column, key: str, other: Column) -> Column:
    """A text of a JSON object, or another column where the key is missing."""
    return F.coalesce(F.get_json_object(text, f"$.{key}"), other)


def total_or_null(values: list[Column]) -> Column:
    """The sum if all values are there, else null."""
    return reduce(lambda a, b: a + b, values)


def total_of_some(values: list[Column]) -> Column:
    """The sum of the values that are there; null without any."""
    some = reduce(lambda a, b: a | b, [v.isNotNull() for v in values])
    return F.when(some, reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values]))


def fact_records(facts: DataFrame, now: int) -> DataFrame:
    """Each fact as one record: times, provenance, quality, freshness against max(aging, three windows), metrics by name, flags and units.

    facts: id, segment and corridor names, period_start, period_end, calculated_us, version, source_mode, semantics, the metrics, and `meta`, a
    JSON text with observed_at (epoch seconds), calculation_mode and calculation_metadata.
    """
    estimated = F.coalesce(F.col("semantics") == "snapshot_occupancy", F.lit(False))
    observed = F.coalesce(json_number("meta", "observed_at").cast("long"), F.col("period_end"))
    stale_after = max(AGING_SECONDS, 3 * WINDOW_SECONDS)
    age = F.greatest(F.lit(0), F.lit(now) - observed)
    kind = F.when(estimated, "live_occupancy_estimate").otherwise("flow_based_segment")
    return facts.select(
        F.col("id").cast("string").alias("id"), "segment_id", "segment_name", "corridor_id", "corridor_name", "period_start", "period_end",
        observed.alias("observed_at"), F.floor(F.col("calculated_us") / 1_000_000).alias("processed_at"), F.col("version").alias("calculation_version"), "source_mode",
        F.col("semantics").alias("vehicle_count_semantics"), json_or("meta", "calculation_mode", kind).alias("calculation_mode"),
        F.when(estimated, "estimated").otherwise("observed").alias("quality_status"), age.alias("freshness_seconds"), F.lit(stale_after).alias("stale_after_seconds"),
        F.when(age <= stale_after, "fresh").otherwise("stale").alias("freshness_status"),
        F.struct(*[(F.col(f"{p}_g_h") / 1000.0).alias(p) for p in POLLUTANTS]).alias("emissions_kg_h"),
        F.struct(*[F.col(f"{c}_veh_h").alias(c) for c in CATEGORIES]).alias("volume_per_hour"), F.struct(*[F.col(f"{c}_vkt").alias(c) for c in CATEGORIES]).alias("vkt_km_h"),
        json_flag("meta", "calculation_metadata.is_interpolated").alias("is_interpolated"), F.get_json_object("meta", "$.calculation_metadata.interpolation_method").alias("interpolation_method"),
        F.get_json_object("meta", "$.calculation_metadata").alias("calculation_metadata"), F.struct(*[F.lit(v).alias(k) for k, v in UNITS.items()]).alias("units"),
    )


#: What a curated record keeps to itself, below `detail`.
DETAIL = ["calculation_version", "calculation_mode", "vkt_km_h"]


def history_records(records: DataFrame) -> DataFrame:
    """Records of fact_records() as users see them: totals beside the metrics, provenance below `detail`."""
    emission = total_or_null([F.col(f"emissions_kg_h.{p}") for p in POLLUTANTS])
    vehicles = total_of_some([F.col(f"volume_per_hour.{c}") for c in CATEGORIES])
    keep = [c for c in records.columns if c not in (*DETAIL, "calculation_metadata", "freshness_seconds", "stale_after_seconds")]
    return records.select(*keep, emission.alias("total_emissions_kg_h"), vehicles.alias("total_vehicles_per_hour"), F.struct(*DETAIL).alias("detail"))


def live_status(mode: Column, fresh: Column) -> Column:
    """LIVE or STALE for live facts, HISTORICAL for others, NO DATA without a fact."""
    return F.when(mode.isNull(), "NO DATA").when(mode != "LIVE", "HISTORICAL").when(fresh == "fresh", "LIVE").otherwise("STALE")


def map_items(segments: DataFrame, display: DataFrame, now: int) -> DataFrame:
    """One item a segment for a map: its total emission of the pollutants that are there, age and freshness; nulls and `unknown` without a fact.

    display: segment_id, data_status, borrowed_from, and the columns of the fact shown (null without one).
    """
    age = F.when(F.col("id").isNotNull(), F.greatest(F.lit(0), F.lit(now) - F.col("period_end")))
    df = segments.select("segment_id", "segment_name").join(display, "segment_id", "left")
    semantics = F.when(F.col("id").isNull(), "unknown").otherwise(F.coalesce("semantics", F.lit("unknown")))
    status = F.when(F.col("id").isNull(), "unavailable").when(semantics == "snapshot_occupancy", "estimated").otherwise("calculated")
    return df.select(
        "segment_id", "segment_name", total_of_some([F.col(f"{p}_g_h") for p in POLLUTANTS]).alias("total_emission_g_h"), F.col("period_end").alias("observed_at"), age.alias("data_age_seconds"),
        F.when(F.col("id").isNull(), "unknown").otherwise(freshness(age)).alias("freshness_status"), semantics.alias("vehicle_count_semantics"),
        status.alias("volume_status"), F.coalesce("data_status", F.lit("unavailable")).alias("data_status"), "borrowed_from",
    )


def valid_messages(messages: DataFrame) -> Column:
    """Whether all eight pollutants of a message are finite or null."""
    fine = lambda p: F.col(p).isNull() | (~F.isnan(p) & (F.abs(p) < float("inf")))
    return reduce(lambda a, b: a & b, [fine(f"{p}_g_h") for p in POLLUTANTS])


def checked_factors(factors: dict[str, tuple[float, ...]]) -> dict[str, tuple[float, ...]]:
    """Emission factors, after a check: every category, a finite number of at least 0 for every pollutant."""
    if set(factors) != set(CATEGORIES):
        raise ValueError(f"factors are for {sorted(factors)}")
    for c, row in factors.items():
        if len(row) != len(POLLUTANTS) or not all(isinstance(x, (int, float)) and 0 <= x < float("inf") for x in row):
            raise ValueError(f"bad factors of {c}")
    return factors


def import_survey(stops: DataFrame, surveys: DataFrame, key: str, order: list[str], scores: list[str], method: str) -> tuple[DataFrame, DataFrame]:
    """(stops, unmatched surveys): a survey's scores stand in place of the stop's own, its other columns are added, and `score_method` says so.

    Of several surveys of a stop the one with the greatest order columns counts; surveys without key match nothing. Stops without survey stay as they are.
    """
    newest = first_of(surveys, [key], *(F.desc(c) for c in order))
    own = newest.select(key, *[F.col(c).alias(f"{c}_survey") if c in stops.columns else F.col(c) for c in scores], F.lit(method).alias("score_method"))
    df = stops.join(own, key, "left")
    matched = F.col("score_method").isNotNull()
    for c in scores:
        if c in stops.columns:
            df = df.withColumn(c, F.when(matched, F.col(f"{c}_survey")).otherwise(F.col(c))).drop(f"{c}_survey")
    return df, surveys.join(stops.select(key), key, "left_anti")
