"""Daily profiles: 24 hours, gaps planned and filled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def densified(means: DataFrame, keys: list[str], last: int, hours: int = 24) -> DataFrame:
    """A row for every hour before and at `last` of every key that has any, with its index; `present` tells real ones."""
    wanted = F.explode(F.sequence(F.lit(0), F.lit(hours - 1)))
    grid = means.select(*keys).distinct().withColumn("i", wanted).withColumn("hour", (F.lit(last) - (hours - 1 - F.col("i")) * 3600).cast("long"))
    return grid.join(means.withColumn("present", F.lit(True)), [*keys, "hour"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def gap_plan(dense: DataFrame, keys: list[str]) -> DataFrame:
    """left and right: the nearest real hours beside a gap; method: linear between two, else forward or backward fill."""
    order = Window.partitionBy(*keys).orderBy("i")
    real = F.when(F.col("present"), F.col("i"))
    df = dense.withColumn("left", F.last(real, True).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("right", F.first(real, True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    method = F.when(F.col("present"), F.lit(None)).when(F.col("left").isNotNull() & F.col("right").isNotNull(), "linear").when(F.col("left").isNotNull(), "forward_fill").when(F.col("right").isNotNull(), "backward_fill")
    return df.withColumn("method", method)


def filled(dense: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """gap_plan() with the values of gaps: on the line between both sides, or one side's where the other is missing or null."""
    df = gap_plan(dense, keys)
    order = Window.partitionBy(*keys).orderBy("i")
    for v in values:
        at_left = F.last(F.when(F.col("present"), F.struct(F.col(v).alias("v"))), True).over(order.rowsBetween(Window.unboundedPreceding, 0))["v"]
        at_right = F.first(F.when(F.col("present"), F.struct(F.col(v).alias("v"))), True).over(order.rowsBetween(0, Window.unboundedFollowing))["v"]
        df = df.withColumn("_l", at_left).withColumn("_r", at_right)
        line = F.col("_l") + (F.col("_r") - F.col("_l")) * (F.col("i") - F.col("left")) / (F.col("right") - F.col("left"))
        df = df.withColumn(v, F.when(F.col("present"), F.col(v)).when(F.col("method") == "linear", F.when(F.col("_l").isNull(), F.col("_r")).when(F.col("_r").isNull(), F.col("_l")).otherwise(line)).otherwise(F.coalesce("_l", "_r"))).drop("_l", "_r")
    return df


def canonical_hour(hour, anchor):
    """An hour of the day on the 24-hour profile that ends at the anchor (both in epoch seconds)."""
    return (anchor - F.pmod((F.floor(anchor / 3600) % 24) - hour, F.lit(24)) * 3600).cast("long")


def anchor(samples: DataFrame) -> DataFrame:
    """One row, the start of the profile's last hour: the newest of the replayed samples, or of all where none is replayed."""
    replayed = F.max(F.when(F.col("source_mode") == "REPLAY", F.col("period_start")))
    return samples.agg(F.coalesce(replayed, F.max("period_start")).alias("anchor"))


def available_hours(anchors: DataFrame, hours: int = 24) -> DataFrame:
    """The profile's hours, oldest first; none without an anchor."""
    return anchors.where("anchor IS NOT NULL").select(F.explode(F.sequence(F.lit(hours - 1), F.lit(0))).alias("_ago"), "anchor").select((F.col("anchor") - F.col("_ago") * 3600).cast("long").alias("hour"))
