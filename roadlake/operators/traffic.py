"""Observations to volume, vehicle kilometres and emissions; tracks to flows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlake.functions.scalars import bucket, freshness, half_up
from roadlake.operators.facts import first_of
from roadlake.operators.records import checked_factors
from roadlake.schema import CATEGORIES, DISTANCE_FACTORS, FUEL_FACTORS, FUEL_GRAMS, POLLUTANTS


def valid(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): ids, a time, a finite duration above 0 and a finite count of at least 0."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    good = F.coalesce(F.col("camera_id").isNotNull() & F.col("segment_id").isNotNull() & F.col("captured_at").isNotNull() & finite(F.col("duration")) & (F.col("duration") > 0) & finite(F.col("n")) & (F.col("n") >= 0), F.lit(False))
    return observations.where(good), observations.where(~good)


def counts(*extra: str) -> list[Column]:
    """The count of each category as a column; unknown categories count nowhere."""
    return [F.when(F.col("category") == c, F.col("n")).otherwise(0.0).alias(c) for c in CATEGORIES]


def preferred_semantics(observations: DataFrame, width: int) -> DataFrame:
    """Of each segment and window, the observations of the best semantics there: counts, then rates, then occupancy."""
    rank = F.when(F.col("semantics") == "interval_count", 1).when(F.col("semantics") == "vehicles_per_hour", 2).otherwise(3)
    df = observations.withColumn("window", bucket(F.col("captured_at"), width)).withColumn("choice", rank)
    best = F.min("choice").over(Window.partitionBy("segment_id", "window"))
    return df.withColumn("_best", best).where("choice = _best").drop("_best")


def by_policy(observations: DataFrame, policy: str = "sum_independent_streams") -> DataFrame:
    """Observations of one camera for each segment, window and stream, by the policy that the caller names.

    authoritative_camera keeps the camera with the smallest id; sum_independent_streams takes streams to have one camera, and fails when a
    stream has several. newest_camera is one_camera_per_stream().
    """
    key = Window.partitionBy("segment_id", "window", "stream_id")
    if policy == "newest_camera":
        return one_camera_per_stream(observations)
    if policy == "authoritative_camera":
        return observations.withColumn("_first", F.min("camera_id").over(key)).where("camera_id = _first").drop("_first")
    if policy != "sum_independent_streams":
        raise ValueError(f"no such policy: {policy}")
    spread = F.struct(F.min("camera_id").over(key).alias("low"), F.max("camera_id").over(key).alias("high"))
    several = F.raise_error(F.concat(F.lit("several cameras for stream "), F.col("stream_id")))
    checked = observations.withColumn("_cameras", spread)
    return checked.where(F.when(F.col("_cameras.low") == F.col("_cameras.high"), True).otherwise(several.cast("boolean"))).drop("_cameras")


def one_camera_per_stream(observations: DataFrame) -> DataFrame:
    """The camera with the newest capture of each segment, window and stream, ties to the smaller id.

    All windows and groups from here to the segment's sums have (segment, window) among their keys, so one shuffle by these serves them all.
    """
    key = ["segment_id", "window", "stream_id"]
    last = F.max("captured_us").over(Window.partitionBy(*key, "camera_id"))
    best = F.min(F.struct(-F.col("_last"), "camera_id")).over(Window.partitionBy(*key))
    return observations.withColumn("_last", last).withColumn("_best", best).where(F.col("camera_id") == F.col("_best.camera_id")).drop("_last", "_best")


def segment_aggregate(observations: DataFrame, width: int, policy: str = "newest_camera") -> DataFrame:
    """Volume per hour and raw counts of each segment and window: streams add up, each over its own duration."""
    chosen = by_policy(preferred_semantics(observations, width), policy)
    once = first_of(chosen, ["segment_id", "window", "camera_id", "stream_id", "captured_us"], F.desc("id"))
    rows = once.select("segment_id", "window", "stream_id", "camera_id", "semantics", "captured_at", "duration", *counts())
    hourly = F.col("semantics") == "vehicles_per_hour"
    occupied = F.col("semantics") == "snapshot_occupancy"
    streams = rows.groupBy("segment_id", "window", "stream_id", "semantics").agg(
        F.sum("duration").alias("seconds"), F.count("*").alias("n"), F.max("captured_at").alias("observed_at"),
        *[F.sum(c).alias(f"{c}_n") for c in CATEGORIES], *[F.sum(F.col(c) * F.col("duration")).alias(f"{c}_w") for c in CATEGORIES],
    )
    volume = lambda c: F.when(hourly, F.col(f"{c}_w") / F.col("seconds")).otherwise(F.col(f"{c}_n") * 3600 / F.col("seconds"))
    raw = lambda c: F.when(occupied, F.col(f"{c}_n") / F.col("n")).otherwise(F.col(f"{c}_n"))
    return streams.groupBy("segment_id", "window", "semantics").agg(
        *[F.round(F.sum(volume(c)), 6).alias(f"{c}_veh_h") for c in CATEGORIES], *[F.round(F.sum(raw(c)), 6).alias(f"{c}_raw") for c in CATEGORIES],
        F.max("seconds").alias("duration"), F.sum("n").alias("observations"), F.count("*").alias("streams"), F.max("observed_at").alias("observed_at"),
    )


def tier2(volumes: DataFrame, length_km: str = "length_km", efficiency: float = 0.0, factors: dict[str, tuple[float, ...]] = DISTANCE_FACTORS) -> DataFrame:
    """Vehicle kilometres and grams per hour of each pollutant, from volumes and the segment's length. factors: grams per vehicle kilometre, checked first."""
    checked_factors(factors)
    if not 0 <= efficiency <= 100:
        raise ValueError("control efficiency is a percentage")
    correction = (100.0 - efficiency) / 100.0
    vkt = {c: F.col(f"{c}_veh_h") * F.col(length_km) for c in CATEGORIES}
    grams = [reduce(lambda a, b: a + b, [vkt[c] * factors[c][i] * correction for c in CATEGORIES]).alias(f"{p}_g_h") for i, p in enumerate(POLLUTANTS)]
    return volumes.select("*", *[v.alias(f"{c}_vkt") for c, v in vkt.items()], *grams)


def fuel_model(means: DataFrame) -> DataFrame:
    """Grams per minute and kilograms per hour from counts at a camera, by fuel use over one kilometre a minute."""
    out = []
    for i, p in enumerate(POLLUTANTS):
        g = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) * (FUEL_GRAMS[c] / 1000) * FUEL_FACTORS[c][i] for c in CATEGORIES])
        out += [half_up(g, 2).alias(f"{p}_g_min"), half_up(g * 60 / 1000, 4).alias(f"{p}_kg_h")]
    return means.select("*", *out)


def window_means(observations: DataFrame, width: int) -> DataFrame:
    """Mean counts of each camera's snapshots in epoch-aligned windows, and their emissions from the means."""
    snapshots = observations.where(F.col("category").isNotNull()).select("camera_id", bucket(F.col("captured_at"), width).alias("window"), "captured_at", *counts())
    means = snapshots.groupBy("camera_id", "window").agg(*[F.avg(c).alias(c) for c in CATEGORIES], F.count("*").alias("sample_count"), F.max("captured_at").alias("last_captured_at"))
    return fuel_model(means)


def windows_at(observations: DataFrame, width: int, watermark: int | None = None) -> DataFrame:
    """window_means' windows with their status: completed where the camera has an event at or behind the window's end, or where the
    watermark (epoch seconds, for all cameras) has passed it; else open. A watermark beyond all windows flushes everything."""
    snapshots = observations.where(F.col("category").isNotNull()).select("camera_id", bucket(F.col("captured_at"), width).alias("window"), "captured_at", *counts())
    means = snapshots.groupBy("camera_id", "window").agg(*[F.avg(c).alias(c) for c in CATEGORIES], F.count("*").alias("sample_count"), F.max("captured_at").alias("last_captured_at"))
    end, newest = F.col("window") + width, F.max("last_captured_at").over(Window.partitionBy("camera_id"))
    done = newest >= end if watermark is None else (newest >= end) | (end <= watermark)
    return means.withColumn("status", F.when(done, "completed").otherwise("open"))


def previews(windows: DataFrame) -> DataFrame:
    """The newest open window of each camera, of windows_at's."""
    return first_of(windows.where("status = 'open'"), ["camera_id"], F.desc("window"))


def late(observations: DataFrame, width: int) -> DataFrame:
    """Each observation with whether it comes too late: its window had ended for its camera when it arrived.

    A camera's events advance only its own watermark; an observation of a window that an earlier arrival has closed is late. What has been
    seen before is the greatest of the same day's earlier arrivals and of all earlier days': no window of rows is longer than a camera's day.
    """
    df = observations.withColumn("_day", F.floor(F.col("arrival_us") / 86_400_000_000))
    daily = df.groupBy("camera_id", "_day").agg(F.max("captured_at").alias("_most"))
    earlier = F.max("_most").over(Window.partitionBy("camera_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))
    before = Window.partitionBy("camera_id", "_day").orderBy("arrival_us", "id").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_today", F.max("captured_at").over(before)).join(daily.select("camera_id", "_day", earlier.alias("_carried")), ["camera_id", "_day"])
    df = df.withColumn("window", bucket(F.col("captured_at"), width)).withColumn("seen", F.greatest("_today", "_carried"))
    return df.withColumn("late", F.coalesce(F.col("window") + width <= bucket(F.col("seen"), width), F.lit(False))).drop("seen", "_day", "_today", "_carried")


def occupancy(frames: DataFrame, key: list[str]) -> DataFrame:
    """Distinct tracks inside, and single boxes without track, by frame and category."""
    inside = frames.where(F.col("inside") & F.col("category").isNotNull())
    return inside.groupBy(*key, "category").agg((F.count_distinct("track_id") + F.count_if(F.col("track_id").isNull())).alias("n"))


def flow_exits(frames: DataFrame, key: list[str], min_frames: int = 3, exit_frames: int = 5, forget: int | None = None) -> DataFrame:
    """Tracks that left: once a track that was inside for min_frames goes outside or is missing for exit_frames, it counts once, in its class then.

    The batch twin of the streaming counter: a track's rows in frame order, its frames inside so far, and the first event that counts. Frames of
    the key without the track are gaps; the last frame of the key closes tracks that stay missing. A track that was missing for `forget` frames
    (at least 300, or 60 * exit_frames) is a new one when it comes back, and may count again.
    """
    forget = forget or max(300, 60 * exit_frames)
    rows = frames.where(F.col("track_id").isNotNull() & F.col("category").isNotNull())
    rows = first_of(rows, [*key, "track_id", "frame_no"], F.asc("category"))
    ends = frames.groupBy(*key).agg(F.max("frame_no").alias("last_frame"))
    whole = Window.partitionBy(*key, "track_id").orderBy("frame_no")
    returns = F.coalesce(F.col("frame_no") - F.lag("frame_no").over(whole) > forget, F.lit(False)).cast("int")
    rows = rows.withColumn("life", returns).withColumn("life", F.sum("life").over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    order = Window.partitionBy(*key, "track_id", "life").orderBy("frame_no")
    rows = rows.withColumn("life_end", F.lead("frame_no").over(whole) - 1)
    rows = rows.withColumn("inside_so_far", F.sum(F.col("inside").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("next_frame", F.lead("frame_no").over(order)).withColumn("next_inside", F.lead("inside").over(order)).withColumn("next_category", F.lead("category").over(order))
    rows = rows.join(ends, key)
    gap = F.coalesce("next_frame", F.col("life_end") + 1, F.col("last_frame") + 1) - F.col("frame_no") - 1
    enough = F.col("inside") & (F.col("inside_so_far") >= min_frames)
    missing = enough & (gap >= exit_frames)
    leaves = enough & ~missing & F.coalesce(~F.col("next_inside"), F.lit(False))
    events = rows.where(missing | leaves).select(*key, "track_id", "life", F.when(missing, F.col("frame_no") + exit_frames).otherwise(F.col("next_frame")).alias("frame_no"), F.when(missing, F.col("category")).otherwise(F.col("next_category")).alias("category"))
    return first_of(events, [*key, "track_id", "life"], F.asc("frame_no")).drop("life")


def valid_mapping(observations: DataFrame, mappings: DataFrame) -> DataFrame:
    """Each observation with the segment of the active mapping that holds at its time: ok, no_mapping or ambiguous.

    A camera's mappings, the few it has had, are one list that is looked up in the observation's row: observations are joined once, by camera.
    """
    some = F.collect_list(F.struct("segment_id", "valid_from", "valid_to"))
    m = mappings.where("is_active").groupBy("camera_id").agg(some.alias("_m"))
    at = F.col("captured_at")
    holds = F.filter("_m", lambda x: (x["valid_from"].isNull() | (x["valid_from"] <= at)) & (x["valid_to"].isNull() | (at < x["valid_to"])))
    df = observations.join(m, "camera_id", "left").withColumn("_m", holds)
    n = F.coalesce(F.when(F.col("_m").isNotNull(), F.size("_m")), F.lit(0))
    return df.withColumn("status", F.when(n == 0, "no_mapping").when(n > 1, "ambiguous").otherwise("ok")).withColumn("mapped", F.when(n == 1, F.get("_m", F.lit(0))["segment_id"])).drop("_m")


def newest_wins(states: DataFrame, keys: list[str]) -> DataFrame:
    """The state of the greatest (observed, processed) of each key, as an atomic compare-and-set would leave it."""
    return first_of(states, keys, F.desc("observed"), F.desc("processed"), F.asc("id"))


def unchanged_skipped(windows: DataFrame, known: DataFrame) -> DataFrame:
    """Windows whose signature isn't known yet: what an incremental pass has to compute."""
    return windows.join(known, ["segment_id", "window", "signature"], "left_anti")


def reconciliation(windows: DataFrame, done: DataFrame, width: int, back: int = 12, most: int = 120) -> DataFrame:
    """The windows (segment_id, window) that an incremental pass reads: `most` from `back` before the last computed one of done (segment_id, last_start).

    Late observations of the last windows are read again; where an outage leaves nothing in that stretch, it starts before the next
    window that has observations, so a pass never stands still.
    """
    marked = windows.join(done, "segment_id", "left")
    ends = marked.groupBy("segment_id").agg(F.min("window").alias("_first"), F.first("last_start").alias("_last"), F.min(F.when(F.col("window") > F.col("last_start"), F.col("window"))).alias("_next"))
    usual = F.coalesce(F.greatest("_first", F.when(F.col("_last").isNotNull(), F.col("_last") - back * width)), F.col("_first"))
    start = F.when(F.col("_next") >= usual + most * width, F.col("_next") - back * width).otherwise(usual)
    begin = ends.select("segment_id", start.alias("_start"))
    return windows.join(begin, "segment_id").where((F.col("window") >= F.col("_start")) & (F.col("window") < F.col("_start") + most * width)).drop("_start")


def city_totals(cameras: DataFrame, newest: DataFrame, totals: list[tuple[str, int]], now: int, fresh: int, aging: int) -> DataFrame:
    """One row: the sums, rounded to so many digits, of every camera's newest window, active or not, and counts of the active cameras.

    cameras: camera_id, is_active, data_source; newest: a row a camera with last_captured_at and what is added up. Without any active camera all is zero.
    """
    df = cameras.select("camera_id", "is_active", "data_source").join(newest, "camera_id", "full")
    active = F.coalesce(F.col("is_active"), F.lit(False))
    status = freshness(F.lit(now) - F.col("last_captured_at"), fresh, aging)
    count = lambda c: F.count_if(active & c)
    last = F.max("last_captured_at")
    df = df.agg(
        count(F.lit(True)).alias("cameras"), count(F.col("data_source") == "LIVE").alias("live"), count(F.col("data_source") != "LIVE").alias("historical"),
        count(status == "fresh").alias("fresh"), count(status == "stale").alias("stale"), last.alias("last_captured_at"), freshness(F.lit(now) - last, fresh, aging).alias("freshness_status"),
        *[F.round(F.coalesce(F.sum(c), F.lit(0.0)), n).alias(c) for c, n in totals],
    )
    some = F.col("cameras") > 0
    zero = [F.when(some, F.col(c)).otherwise(0.0).alias(c) for c, _ in totals]
    return df.select("cameras", "live", "historical", "fresh", "stale", F.when(some, F.col("last_captured_at")).alias("last_captured_at"), F.when(some, F.col("freshness_status")).otherwise("unknown").alias("freshness_status"), *zero)
