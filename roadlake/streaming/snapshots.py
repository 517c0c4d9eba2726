"""Snapshots of cameras as facts of segments, one micro-batch after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from roadlake.functions.scalars import bucket
from roadlake.operators.traffic import one_camera_per_stream, segment_aggregate, tier2
from roadlake.schema import CATEGORIES, POLLUTANTS
from roadlake.sources.buckets import KeyedTable

#: What marks a fact as a real snapshot; live facts have another version, so neither replaces the other.
VERSION, MODE, SOURCE = 4, "SNAPSHOT_REAL", "HISTORICAL"
FACTOR_SET = "proposal_tier2_g_per_vehicle_km_v1"


def snapshot_facts(observations: DataFrame, segments: DataFrame, width: int, efficiency: float = 0.0) -> DataFrame:
    """A fact for each segment and window of snapshots.

    observations: as segment_aggregate takes them, with has_roi and priority. Of the cameras of one stream the one with the newest capture
    counts, ties to the smaller id; the others are listed as dropped. A fact is calibrated if every observation that counts has a region of
    interest; priorities of several kinds are mixed, none is medium.
    """
    placed = observations.withColumn("window", bucket(F.col("captured_at"), width))
    kept = one_camera_per_stream(placed)
    groups = ["segment_id", "window"]
    everyone = placed.select(*groups, "stream_id", "camera_id").distinct()
    left_out = everyone.join(kept.select(*groups, "stream_id", "camera_id").distinct(), [*groups, "stream_id", "camera_id"], "left_anti")
    by_stream = left_out.groupBy(*groups, "stream_id").agg(F.sort_array(F.collect_list("camera_id")).alias("cameras"))
    dropped = by_stream.groupBy(*groups).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("stream_id", "cameras")))).alias("dropped_cameras"))
    about = kept.groupBy(*groups).agg(
        F.bool_and(F.coalesce("has_roi", F.lit(False))).alias("calibrated"), F.sort_array(F.collect_set(F.coalesce("priority", F.lit("medium")))).alias("priorities"),
        F.sort_array(F.collect_set("camera_id")).alias("source_cameras"), F.sort_array(F.collect_set("stream_id")).alias("source_streams"),
    )
    volumes = segment_aggregate(kept.drop("window"), width)
    facts = tier2(volumes.join(segments.select("segment_id", "length_km"), "segment_id"), efficiency=efficiency).join(about, groups).join(dropped, groups, "left")
    occupied = F.col("semantics") == "snapshot_occupancy"
    return facts.select(
        "segment_id", F.col("window").alias("period_start"), (F.col("window") + width).alias("period_end"), F.lit(VERSION).alias("version"), F.lit(SOURCE).alias("data_source"), F.lit(MODE).alias("source_mode"),
        "semantics", F.when(occupied, "live_occupancy_estimate").otherwise("flow_based_segment").alias("calculation_mode"), F.when(occupied, "estimated").otherwise("calculated").alias("volume_status"),
        "observed_at", *[f"{c}_{x}" for x in ("raw", "veh_h", "vkt") for c in CATEGORIES], *[f"{p}_g_h" for p in POLLUTANTS],
        F.struct(
            F.when(F.col("calibrated"), "calibrated").otherwise("uncalibrated").alias("roi_status"), F.when(F.col("dropped_cameras").isNotNull(), "duplicate_stream_camera_deduped").alias("selection_note"), "dropped_cameras",
            F.lit(FACTOR_SET).alias("emission_factor_set"), F.lit(efficiency).alias("control_efficiency_percent"), F.col("length_km").alias("road_length_km"), F.when(occupied, "occupancy_extrapolation").otherwise(F.col("semantics")).alias("volume_basis"),
        ).alias("calculation_metadata"),
        F.struct("source_cameras", "source_streams", F.col("observations").alias("source_observation_count"), F.lit("sum_independent_streams").alias("aggregation_policy")).alias("provenance"),
        F.when(F.size("priorities") > 1, "mixed").otherwise(F.element_at("priorities", 1)).alias("priority"),
    )


def snapshot_sink(table: KeyedTable, segments: DataFrame, width: int, stream: str = "snapshots", report=None):
    """A foreachBatch function: a batch's facts go into the table, once, however often the batch runs. report(batch number, figures)
    gets how many facts there are, by priority, and how many observations they hold, counted while they are written."""

    def write(batch: DataFrame, number: int) -> None:
        seen = Observation(f"{stream}-{number}")
        of = lambda p: F.count_if(F.col("priority") == p).alias(f"emissions_{p}")
        facts = snapshot_facts(batch, segments, width).observe(seen, F.count("*").alias("emissions"), *map(of, ("high", "medium", "low", "mixed")), F.sum("provenance.source_observation_count").alias("observations"))
        if table.upsert(facts, f"{stream}:{number}") is not None and report:
            report(number, {k: v or 0 for k, v in seen.get.items()})

    return write
