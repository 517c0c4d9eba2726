"""Versioned facts: filters, provenance, deduplication."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlake.functions.scalars import bucket_width, source_mode
from roadlake.schema import MAX_DAYS


def mode() -> Column:
    return source_mode(F.col("meta_source_mode"), F.col("meta_data_source"))


@dataclass(frozen=True)
class AnalyticsFilter:
    """A checked request; times in epoch seconds, the range half open."""

    start: int | None = None
    end: int | None = None
    segment_id: str | None = None
    corridor_id: str | None = None
    search: str | None = None
    quality: str | None = None
    mode: str | None = None
    newest: bool = False

    def __post_init__(self):
        if self.start is not None and self.end is not None:
            if self.start >= self.end:
                raise ValueError("the range is empty")
            if not self.newest and self.end - self.start > MAX_DAYS * 86400:
                raise ValueError(f"the range is longer than {MAX_DAYS} days")

    def bucket(self, requested: str | None = None) -> tuple[str, int]:
        return bucket_width((self.end - self.start) / 3600, requested, self.newest)


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key. Spark trims each partition to such rows before it shuffles."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def active_segments(cameras: DataFrame, live: bool) -> DataFrame:
    where = F.col("is_active") & (F.col("data_source") == "LIVE" if live else F.lit(True))
    return cameras.where(where).select("segment_id").distinct()


def scoped(facts: DataFrame, cameras: DataFrame, mode: str) -> DataFrame:
    """Facts of a provenance. LIVE ones count only for segments with an active live camera."""
    live = active_segments(cameras, True)
    if mode == "ACTIVE_LIVE":
        return facts.where(F.col("source_mode") == "LIVE").join(live, "segment_id", "left_semi")
    if mode == "CSV_AND_LIVE":  # one pass over the facts: those of history stay, live ones need their segment's mark
        marked = facts.where(F.col("source_mode").isin("CSV_HISTORY", "LIVE")).join(live.withColumn("_live", F.lit(True)), "segment_id", "left")
        return marked.where((F.col("source_mode") == "CSV_HISTORY") | F.col("_live")).drop("_live")
    return facts.where(F.col("source_mode") == {"HISTORICAL": "CSV_HISTORY"}.get(mode, mode))


def matching(facts: DataFrame, segments: DataFrame, f: AnalyticsFilter = AnalyticsFilter(), cameras: DataFrame | None = None, exclude_live: bool = False) -> DataFrame:
    """Facts that are not synthetic and match the filter, with their segment's columns."""
    df = facts.withColumn("source_mode", mode()).where("source_mode <> 'SYNTHETIC'")
    if f.start is not None:
        df = df.where(F.col("period_start") >= f.start)
    if f.end is not None:
        df = df.where(F.col("period_start") < f.end)
    if f.segment_id:
        df = df.where(F.col("segment_id") == f.segment_id)
    if f.quality in ("observed", "estimated"):
        estimated = F.coalesce(F.col("semantics"), F.lit("")) == "snapshot_occupancy"
        df = df.where(estimated if f.quality == "estimated" else ~estimated)
    if exclude_live:
        df = df.where("source_mode <> 'LIVE'")
    if f.mode:
        df = scoped(df, cameras, f.mode)
    if f.search:
        pattern = f"%{f.search}%"
        segments = segments.where(F.col("segment_name").ilike(pattern) | F.col("corridor_name").ilike(pattern))
    if f.corridor_id:
        segments = segments.where(F.col("corridor_id") == f.corridor_id)
    return df.join(segments, "segment_id")


def deduplicated(df: DataFrame) -> DataFrame:
    """One fact a segment and period: the highest version, then the newest calculation."""
    return first_of(df, ["segment_id", "period_start"], F.desc("version"), F.desc("calculated_us"), F.asc("id"))


def by_mode(df: DataFrame) -> DataFrame:
    """One fact a segment, period and mode: latest() and deduplicated(), of all modes or of one, choose the same from these as from all facts."""
    return first_of(df, ["segment_id", "period_start", "period_end", "source_mode"], F.desc("version"), F.desc("calculated_us"), F.asc("id"))


def latest(df: DataFrame, cameras: DataFrame | None = None) -> DataFrame:
    """The newest fact of each segment, of those with an active camera if cameras are given."""
    if cameras is not None:
        df = df.join(active_segments(cameras, False), "segment_id", "left_semi")
    return first_of(df, ["segment_id"], F.desc("period_end"), F.desc("version"), F.desc("calculated_us"), F.asc("id"))
