"""Keyed windows with a watermark for each key, flow counting and newest-wins sinks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from roadlake.functions.scalars import bucket
from roadlake.schema import CATEGORIES
from roadlake.sources.buckets import KeyedTable, sink

WINDOW = "camera_id string, window long, status string, sample_count long, last_captured_at long, car double, motorcycle double, bus double, truck double"


def added_up(frame: pd.DataFrame, done: int, held: np.ndarray) -> tuple[pd.DataFrame, pd.DataFrame, float]:
    """(late events, open windows, the last capture that counts) of one camera's events and what is held of its windows.

    held: rows of start, n, last, sums. An event is late if its window is at or before the last finished one: as events finish only windows
    that end before them, those of one batch in order of time never make each other late.
    """
    late = frame[frame.window <= done]
    rest = frame[frame.window > done]
    values = np.stack([np.where(rest.category == c, rest.n, 0.0) for c in CATEGORIES], 1) if len(rest) else np.zeros((0, len(CATEGORIES)))
    rows = np.column_stack([rest.window, np.ones(len(rest)), rest.captured_at, values]).astype(float)
    rows = np.concatenate([held.reshape(-1, rows.shape[1]), rows])
    starts, of = np.unique(rows[:, 0], return_inverse=True)
    sums = np.zeros((len(starts), rows.shape[1]))
    np.add.at(sums, of, rows)
    sums[:, 0], sums[:, 2] = starts, -np.inf
    np.maximum.at(sums[:, 2], of, rows[:, 2])
    return late, sums, float(rest.captured_at.max()) if len(rest) else -np.inf


def window_means(observations: DataFrame, width: int, idle: str | None = None) -> DataFrame:
    """Means of each camera's snapshots in epoch-aligned windows, finished one by one.

    An event at t finishes its camera's windows that end at or before t, other cameras' stay open; an event of a finished window is
    reported as late and counts nowhere. observations: camera_id, captured_at (epoch seconds), category, n, as a stream or a batch.
    Append mode: completed windows and late events, each once.

    idle: an interval ("10 minutes"). The stream's watermark, the latest capture of all cameras less the interval, then also finishes the windows of
    cameras that send nothing more; events older than the watermark are dropped unreported. Without it such windows stay open.
    """
    columns = ["camera_id", "window", "status", "sample_count", "last_captured_at", *CATEGORIES]

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done, held = (state.get[0], np.array(state.get[1], float)) if state.exists else (-1, np.zeros(0))
        events = list(frames)
        frame = pd.concat(events) if events else pd.DataFrame(columns=["captured_at", "category", "n", "window"])
        late, windows, by = added_up(frame, done, held)
        if state.hasTimedOut:
            by = max(by, state.getCurrentWatermarkMs() / 1000)
        ended = windows[:, 0] + width <= by
        full, rest = windows[ended], windows[~ended]
        done = max(done, int(full[:, 0].max())) if len(full) else done
        state.update((done, rest.ravel().tolist()))
        if idle and len(rest):
            state.setTimeoutTimestamp(max(int(rest[:, 0].min() + width) * 1000, state.getCurrentWatermarkMs() + 1))
        out = [np.column_stack([full[:, :1], full[:, 1:3], full[:, 3:] / full[:, 1:2]]), np.column_stack([late.window, np.ones(len(late)), late.captured_at, *[np.where(late.category == c, late.n, 0.0) for c in CATEGORIES]])]
        if len(full) or len(late):
            rows = pd.DataFrame(np.concatenate([x.astype(float) for x in out]), columns=["window", "sample_count", "last_captured_at", *CATEGORIES])
            rows = rows.astype({c: "int64" for c in ("window", "sample_count", "last_captured_at")})
            yield rows.assign(camera_id=key[0], status=["completed"] * len(full) + ["late"] * len(late))[columns]

    rows = observations.select("camera_id", "captured_at", "category", F.col("n").cast("double").alias("n"), bucket(F.col("captured_at"), width).alias("window"))
    if idle:
        rows = rows.withColumn("captured", F.timestamp_seconds("captured_at")).withWatermark("captured", idle)
    timeout = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return rows.groupBy("camera_id").applyInPandasWithState(update, WINDOW, "done long, held array<double>", "append", timeout)


FLOW = "camera long, frame_no long, category string, n long"
#: What is kept of a track: its last box, its frames inside so far, whether it has counted.
TRACK = ["track_id", "frame_no", "category", "inside", "so_far", "counted"]


def left_tracks(boxes: pd.DataFrame, last: int, min_frames: int, exit_frames: int, forget: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(events, tracks) of one camera's boxes up to frame `last`: what counts, and what has to be known of each track later.

    boxes has a row for each track and frame in that order; the first row of a track may be what is known of it, with `so_far` and
    `counted` filled. A track absent for `forget` frames starts anew. A track's stay ends when the next box is outside, or when exit_frames frames
    pass without a box; the first end of a stay with min_frames frames inside counts.
    """
    after = boxes.groupby("track_id", sort=False)
    ahead = after[["frame_no", "inside", "category"]].shift(-1)
    until = ahead.frame_no.fillna(last + 1)
    anew = (boxes.frame_no - after.frame_no.shift(1)).gt(forget)
    life = anew.groupby(boxes.track_id).cumsum()
    whole = [boxes.track_id, life]
    known = boxes.so_far.where(~anew)
    so_far = (known.fillna(boxes.inside.astype("float"))).groupby(whole).cumsum()
    counted = boxes.counted.astype("boolean").fillna(False).astype(bool).groupby(whole).cummax()
    stays = boxes.inside & (so_far >= min_frames) & ~counted
    missing = stays & (until - boxes.frame_no - 1 >= exit_frames)
    steps_out = stays & ~missing & (ahead.inside == False) & ahead.frame_no.notna()  # noqa: E712
    ends = missing | steps_out
    first = ends & (ends.astype(int).groupby(whole).cumsum() == 1)
    events = pd.DataFrame({"frame_no": (boxes.frame_no + exit_frames).where(missing, ahead.frame_no)[first], "category": boxes.category.where(missing, ahead.category)[first]})
    done = counted | (ends.astype(int).groupby(whole).cumsum() > 0)
    tracks = boxes.assign(so_far=so_far, counted=done).groupby("track_id", sort=False).tail(1)
    return events, tracks[last - tracks.frame_no < forget][TRACK]


def flow_counts(frames: DataFrame, min_frames: int = 3, exit_frames: int = 5) -> DataFrame:
    """Vehicles that leave the region, counted once each; frames: camera, frame_no, track_id, category, inside (one row for each box).

    The streaming twin of operators.traffic.flow_exits: a batch of frames is one vectorised pass over its boxes, behind what is known of each
    track. An end by missing frames has the frame at which it is certain. Frames that a camera has passed already are ignored.
    """
    forget = max(300, 60 * exit_frames)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, *held = state.get if state.exists else (-1, *([] for _ in TRACK))
        new = pd.concat(list(batches))
        new = new[new.frame_no > last]
        if not len(new):
            return
        last = int(new.frame_no.max())
        boxes = new[new.track_id.notna() & new.category.isin(CATEGORIES)].sort_values(["track_id", "frame_no", "category"], kind="stable").drop_duplicates(["track_id", "frame_no"])
        boxes = pd.concat([pd.DataFrame(dict(zip(TRACK, held, strict=True))), boxes.reindex(columns=TRACK)], ignore_index=True).astype({"track_id": "int64", "frame_no": "int64", "inside": bool, "so_far": float})
        boxes = boxes.sort_values(["track_id", "frame_no"], kind="stable").reset_index(drop=True)
        events, tracks = left_tracks(boxes, last, min_frames, exit_frames, forget)
        state.update((last, *(tracks[c].tolist() for c in TRACK)))
        if len(events):
            out = events.groupby(["frame_no", "category"]).size().rename("n").reset_index()
            out.insert(0, "camera", key[0])
            yield out.astype({"frame_no": "int64"})

    schema = "last long, ids array<long>, frames array<long>, category array<string>, inside array<boolean>, so_far array<double>, counted array<boolean>"
    return frames.select("camera", F.col("frame_no").cast("long"), "track_id", "category", "inside").groupBy("camera").applyInPandasWithState(update, FLOW, schema, "append", GroupStateTimeout.NoTimeout)


def after_outages(frames: DataFrame, max_gap: int) -> DataFrame:
    """frames with track ids that start anew after an outage of the camera: more than max_gap frames without any box of it.

    What a counter's reset after a failed capture does, as a column: the id gets the number of outages before it.
    """
    order = Window.partitionBy("camera").orderBy("frame_no")
    per_frame = frames.select("camera", "frame_no").distinct()
    gap = F.coalesce(F.col("frame_no") - F.lag("frame_no").over(order) > max_gap, F.lit(False)).cast("int")
    outages = per_frame.withColumn("gap", gap).withColumn("outages", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("gap")
    return frames.join(outages, ["camera", "frame_no"]).withColumn("track_id", F.col("track_id") + F.col("outages") * F.lit(1 << 40)).drop("outages")


MEASURED = "camera long, ended_at double, seconds double, car double, motorcycle double, bus double, truck double"


def measured(at: np.ndarray, counts: np.ndarray, opened: float, seconds: float, max_gap: float) -> tuple[list[tuple], float, np.ndarray]:
    """(windows, start of the open one, its counts) of readings at rising times; the first reading stands for what is known, with its counts.

    Readings are cut into unbroken runs at gaps above max_gap; a run's first reading only opens it. Inside a run each window ends at the first
    reading that is `seconds` or more behind its start, found by binary search over the run.
    """
    cuts = np.flatnonzero(np.diff(at) > max_gap) + 1
    windows, start, rest = [], opened, counts[0]
    for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True):
        run, sums = at[a:b], np.cumsum(counts[a:b], axis=0)
        start, before = (opened, np.zeros(counts.shape[1])) if a == 0 else (run[0], sums[0])
        while (i := int(np.searchsorted(run, start + seconds))) < len(run):
            windows.append((run[i], run[i] - start, sums[i] - before))
            start, before = run[i], sums[i]
        rest = sums[-1] - before
    return windows, start, rest


def measured_windows(exits: DataFrame, seconds: float = 60.0, max_gap: float = 5.0) -> DataFrame:
    """Exits over measured, unbroken time: a gap outside [0, max_gap] discards what a window has, so silence never counts as no traffic.

    exits: camera, at (seconds), and a count of each category.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(batches)).sort_values("at", kind="stable")
        at, counts = new["at"].to_numpy(float), new[list(CATEGORIES)].to_numpy(float)
        opened = at[0]
        if state.exists and 0 <= at[0] - state.get[1] <= max_gap:  # the open window goes on
            opened, seen, held = state.get
            at, counts = np.append(seen, at), np.vstack([held, counts])
        else:
            counts[0] = 0
        windows, start, rest = measured(at, counts, opened, seconds, max_gap)
        state.update((float(start), float(at[-1]), rest.tolist()))
        if windows:
            yield pd.DataFrame([(key[0], end, length, *sums) for end, length, sums in windows], columns=["camera", "ended_at", "seconds", *CATEGORIES])

    return exits.groupBy("camera").applyInPandasWithState(update, MEASURED, "start double, seen double, counts array<double>", "append", GroupStateTimeout.NoTimeout)


def window_sink(table: KeyedTable, stream: str = "windows"):
    """A foreachBatch function that upserts finished windows: only the buckets of their keys are rewritten, and a batch that runs again changes nothing."""
    return sink(table, stream)


def newest_state_sink(table: KeyedTable, stream: str = "states"):
    """A foreachBatch function that keeps each key's newest (observed, processed) state; older ones are ignored, whenever they come."""
    return sink(table, stream, newest=["observed", "processed"])
