"""The latest state of each key with a time to live: a state that is not renewed goes by itself, and the stream says so."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: The state store that keeps maps, timers and times to live.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LatestState(StatefulProcessor):
    """One value a key; a timer in event time for when it ends."""

    def __init__(self, keys: list[str], columns: list[str], schema: StructType, seconds: int):
        self.keys, self.columns, self.schema, self.seconds = keys, columns, schema, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows))
        best = frame.sort_values(["observed", "processed"], kind="stable").iloc[-1]
        held = self.state.get() if self.state.exists() else None
        order = (int(best.observed), int(best.processed))
        at = [self.columns.index(c) for c in ("observed", "processed")]
        if held is not None and order <= (int(held[at[0]]), int(held[at[1]])):
            return
        self.state.update(tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in best[self.columns]))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((order[1] + self.seconds) * 1000)
        yield pd.DataFrame([best[[*self.keys, *self.columns]]]).assign(change="set")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.state.get()
        self.state.clear()
        yield pd.DataFrame([[*key, *held]], columns=[*self.keys, *self.columns]).assign(change="expired")

    def close(self) -> None:
        pass


def latest_states(states: DataFrame, keys: list[str], seconds: int = 120, delay: str = "0 seconds") -> DataFrame:
    """Changes of the latest states of a stream: change = set for a state that is newer than what was known of its key, by (observed,
    processed); change = expired for one whose `processed` time is `seconds` before the stream's watermark: without any event of the key.

    states: the keys, observed and processed (epoch seconds), anything else. The session needs the state store of PROVIDER.
    """
    rest = [c for c in states.columns if c not in keys]
    timed = states.withColumn("_at", F.timestamp_seconds("processed")).withWatermark("_at", delay)
    schema = StructType([f for f in states.schema if f.name in rest])
    out = StructType([*[states.schema[c] for c in (*keys, *rest)]]).add("change", "string")
    return timed.groupBy(*keys).transformWithStateInPandas(LatestState(keys, rest, schema, seconds), out, "Append", "EventTime")
