"""What is known of a road, gathered from its cells, stops and facts: evidence of a segment, segments of one name as one, and their hints.

Merging aggregates over nested records: maps add up by key, lists join, of stops the nearest sighting stays, hints go by priority. What can be
many, as keys of maps, stops and hours, is exploded and aggregated by (name, key), so that partial sums are shuffled, not whole records.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadlake.functions.scalars import half_up
from roadlake.scratch import written

# Classes that make a cell promising and a stop weak, hints by priority, how many kinds of places are named.
HIGH, WEAK = ("Sangat Tinggi", "Tinggi"), ("Rendah", "Sangat Rendah")
HINTS = ("add_new_stop", "improve_existing_stop", "increase_frequency")
TOP_PLACES = 5
#: Modes of facts that were collected once and don't move.
STATIC_MODES = ("REPLAY", "CSV_HISTORY")


def hint(gap: Column, weak: Column, label: Column) -> Column:
    """What to do: a stop where promising cells have none near, else better stops where some are weak, else more service where it is busy."""
    return F.when(F.coalesce(gap, F.lit(False)), HINTS[0]).when(F.coalesce(weak, F.lit(0)) > 0, HINTS[1]).when(label.isin(*HIGH), HINTS[2])


def some(values: Column) -> Column:
    """A list, or null instead of an empty one."""
    return F.when(F.size(values) > 0, values)


def counted(df: DataFrame, keys: list[str], by: str, name: str) -> DataFrame:
    """keys and a map from the values of `by` to how often each is there; rows without one don't count."""
    n = df.where(F.col(by).isNotNull()).groupBy(*keys, by).agg(F.count("*").alias("_n"))
    return n.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(by, "_n")))).alias(name))


def largest(df: DataFrame, keys: list[str], by: str, value: str, name: str, most: int | None = None) -> DataFrame:
    """keys and a list of (category, count): sums of value by `by`, greatest first, equal ones by name."""
    n = df.groupBy(*keys, by).agg(F.sum(value).alias("_n"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("_n")).alias("_less"), F.col(by).alias("category")))), lambda x: F.struct(x["category"].alias("category"), (-x["_less"]).alias("count")))
    return n.groupBy(*keys).agg((F.slice(listed, 1, most) if most else listed).alias(name))


def segment_evidence(segments: DataFrame, crossed: DataFrame, cells: DataFrame, near: DataFrame, stops: DataFrame, places: DataFrame, bare: DataFrame) -> DataFrame:
    """A row a segment: its cells' scores, classes and kinds of places, its stops' classes and scores, whether a promising cell lacks a stop, the hint.

    crossed: segment_id, hex_id; cells: hex_id, score, class; near: segment_id, stop_id, distance_m; stops: stop_id, intervention_class,
    ahp_score; places: hex_id, category, n; bare: hex_id of promising cells without a stop near. The first cell by (score, then id) gives the class.
    """
    own = crossed.select("segment_id", "hex_id").distinct()
    scored = own.join(cells.select("hex_id", "score", "class"), "hex_id").join(bare.select("hex_id", F.lit(True).alias("bare")), "hex_id", "left")
    place = F.struct(F.coalesce(-F.col("score"), F.lit(float("inf"))), "hex_id")
    of_cells = scored.groupBy("segment_id").agg(
        F.count("*").alias("hex_count"), F.sort_array(F.collect_list("hex_id")).alias("hex_ids"), F.round(F.avg("score"), 4).alias("avg_score"), F.max("score").alias("max_score"),
        some(F.sort_array(F.collect_set("class"))).alias("classes"), F.min_by("class", place).alias("activity_class"), F.count_if("bare").alias("gaps"),
    )
    seen = near.join(stops, "stop_id")
    of_stops = seen.groupBy("segment_id").agg(
        F.count("*").alias("stops"), F.count("ahp_score").alias("scored"), F.count_if(F.col("intervention_class").isin(*WEAK)).alias("weak"),
        F.round(F.min("ahp_score"), 4).alias("min_ahp"), F.round(F.avg("ahp_score"), 4).alias("avg_ahp"),
    )
    df = segments.select("segment_id").join(of_cells, "segment_id", "left").join(of_stops, "segment_id", "left")
    df = df.join(counted(seen, ["segment_id"], "intervention_class", "class_counts"), "segment_id", "left")
    df = df.join(largest(own.join(places, "hex_id"), ["segment_id"], "category", "n", "places", TOP_PLACES), "segment_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("hex_count", "stops", "scored", "weak")}
    gap = F.coalesce(F.col("gaps") > 0, F.lit(False))
    return df.withColumns(zero).withColumn("coverage_gap", gap).withColumn("hint", hint(gap, F.col("weak"), F.col("activity_class"))).drop("gaps")


def overview(segments: DataFrame, display: DataFrame, evidence: DataFrame, pollutants: list[str]) -> DataFrame:
    """A row for each name of segments: lengths and rates added up over what is there, the most active segment's class, flags, the hint.

    segments: segment_id, name, length_km; display: segment_id, the pollutants (grams an hour), semantics, observed_at, source_mode,
    interpolated, data_status, borrowed_from; evidence: segment_evidence(). Ranked by the rate of all pollutants, names without one last.
    """
    df = segments.select("segment_id", F.coalesce("name", "segment_id").alias("name"), "length_km").join(display, "segment_id", "left").join(evidence.select("segment_id", "max_score", "activity_class", "coverage_gap", "weak"), "segment_id", "left")
    known = reduce(lambda a, b: a | b, [F.col(p).isNotNull() for p in pollutants])
    total = F.when(known, reduce(lambda a, b: a + b, [F.coalesce(F.col(p), F.lit(0.0)) for p in pollutants]) / 1000)
    df = df.withColumn("_total", total).withColumn("_status", F.coalesce("data_status", F.lit("observed")))
    best = F.struct(-F.col("max_score"), "segment_id")
    has = F.col("max_score").isNotNull()
    estimated = F.col("_status") != "observed"
    out = df.groupBy("name").agg(
        F.count("*").alias("chunk_count"), F.sort_array(F.collect_list("segment_id")).alias("segment_ids"), F.round(F.sum(F.coalesce("length_km", F.lit(0.0))), 3).alias("length_km"),
        *[F.sum(F.col(p) / 1000).alias(p) for p in pollutants], F.sum("_total").alias("emission_total_kg_h"),
        F.max("max_score").alias("activity_score"), F.min_by("activity_class", F.when(has, best)).alias("activity_class"), F.min_by("semantics", F.when(has, best)).alias("data_source"),
        F.bool_or(F.coalesce("coverage_gap", F.lit(False))).alias("coverage_gap"), F.sum(F.coalesce("weak", F.lit(0))).alias("weak_stop_count"), F.max("observed_at").alias("observed_at"),
        F.when(F.bool_or(estimated), "estimated").otherwise("observed").alias("data_status"), F.min_by("borrowed_from", F.when(estimated & F.col("borrowed_from").isNotNull(), F.col("segment_id"))).alias("borrowed_from"),
        F.bool_or(F.coalesce(F.col("source_mode").isin(*STATIC_MODES), F.lit(False))).alias("is_static"), F.bool_or(F.coalesce("interpolated", F.lit(False))).alias("is_interpolated"),
    )
    return out.withColumn("intervention_hint", hint(F.col("coverage_gap"), F.col("weak_stop_count"), F.col("activity_class")))


def merged(contexts: DataFrame) -> DataFrame:
    """Segments of one name as one road.

    contexts, a row a segment: name, segment_id, length_km, activity_class, activity_score, pollutant_totals (map), data_source, observed_at,
    data_status, is_estimated, borrowed_from, is_static, is_interpolated, hex_count, hex_ids, avg_score, max_score, classes, places (list of
    category, count), stops (list of stop_id, distance_m and more), stop_count, scored, class_counts (map), weak, min_ahp, avg_ahp, coverage_gap,
    hint, hours (list of hour, values (map), interpolated, method). The most active segment's own fields stand, ties to the smaller id; lists
    follow the segments' order; a mean is the mean of the segments' means.
    """
    contexts = written(contexts, "contexts")  # read once for each part that is merged
    place = F.struct(-F.coalesce("activity_score", F.lit(-1.0)), "segment_id")
    first = lambda c: F.min_by(c, place).alias(c)
    listed = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("segment_id", F.coalesce("hex_ids", F.array().cast("array<bigint>")).alias("h")))), lambda x: x["h"]))
    n = lambda c: F.sum(F.coalesce(c, F.lit(0))).alias(c)
    any_of = lambda c: F.bool_or(F.coalesce(c, F.lit(False))).alias(c)
    hints = F.collect_set("hint")
    best_hint = reduce(lambda rest, h: F.when(F.array_contains(hints, h), h).otherwise(rest), reversed(HINTS), F.lit(None).cast("string"))
    out = contexts.groupBy("name").agg(
        F.min_by("segment_id", place).alias("segment_id"), F.sort_array(F.collect_list("segment_id")).alias("segment_ids"), F.count("*").alias("chunk_count"), F.round(F.sum(F.coalesce("length_km", F.lit(0.0))), 3).alias("length_km"),
        first("activity_class"), first("activity_score"), first("data_source"), first("data_status"), first("borrowed_from"), F.max("observed_at").alias("observed_at"),
        any_of("is_estimated"), any_of("is_static"), any_of("is_interpolated"), n("hex_count"), listed.alias("hex_ids"), half_up(F.avg("avg_score"), 4).alias("avg_score"), F.max("max_score").alias("max_score"),
        some(F.sort_array(F.array_distinct(F.flatten(F.collect_list("classes"))))).alias("classes"), n("stop_count"), n("scored"), n("weak"),
        F.min("min_ahp").alias("min_ahp"), half_up(F.avg("avg_ahp"), 4).alias("avg_ahp"), any_of("coverage_gap"), best_hint.alias("hint"),
    )

    def summed(c: str) -> DataFrame:
        """Maps added up by key."""
        entries = contexts.select("name", F.explode(c).alias("k", "v")).where("v IS NOT NULL").groupBy("name", "k").agg(F.sum("v").alias("v"))
        return entries.groupBy("name").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias(c))

    places = contexts.select("name", F.explode("places").alias("p")).select("name", F.col("p.category").alias("category"), F.col("p.count").alias("count"))
    stops = contexts.select("name", "segment_id", F.explode("stops").alias("s"))
    near = F.struct(F.coalesce("s.distance_m", F.lit(float("inf"))), "segment_id")
    nearest = stops.groupBy("name", F.col("s.stop_id").alias("_id")).agg(F.min_by("s", near).alias("s")).groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("_id", "s"))), lambda x: x["s"]).alias("stops"))
    points = contexts.select("name", "segment_id", F.explode("hours").alias("h")).select("name", "segment_id", "h.*")
    values = points.select("name", "hour", F.explode("values").alias("k", "v")).where("v IS NOT NULL").groupBy("name", "hour", "k").agg(F.sum("v").alias("v"))
    values = values.groupBy("name", "hour").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("values"))
    flags = points.groupBy("name", "hour").agg(F.bool_or(F.coalesce("interpolated", F.lit(False))).alias("interpolated"), F.min_by("method", F.when(F.col("method").isNotNull(), F.col("segment_id"))).alias("method"))
    series = flags.join(values, ["name", "hour"], "left").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("hour", "interpolated", "method", F.to_json("values").alias("_json")))).alias("hours"))
    series = series.select("name", F.transform("hours", lambda h: F.struct(h["hour"].alias("hour"), F.from_json(h["_json"], "map<string,double>").alias("values"), h["interpolated"].alias("interpolated"), h["method"].alias("method"))).alias("hours"))
    for part in (summed("pollutant_totals"), summed("class_counts"), largest(places, ["name"], "category", "count", "places"), nearest, series):
        out = out.join(part, "name", "left")
    return out


def ends_of(df: DataFrame, score: str, tie: str, top: int, bottom: int) -> DataFrame:
    """The rows of a list of scored rows that are shown: part = top, bottom or median, with rank and total; and whether the list was cut.

    A row can be in several parts. The rank comes from ranked(), so no task sees the whole list.
    """
    from roadlake.operators.scoring import ranked, with_total

    r = with_total(ranked(written(df.where(F.col(score).isNotNull()), "scored"), score, tie, True))
    parts = F.array_compact(F.array(F.when(F.col("rank") <= top, "top"), F.when(F.col("rank") > F.col("total") - bottom, "bottom"), F.when(F.col("rank") == F.floor(F.col("total") / 2) + 1, "median")))
    return r.withColumn("part", F.explode(parts)).withColumn("cut", F.col("total") > F.least(F.col("total"), F.lit(top)) + F.least(F.col("total"), F.lit(bottom)))
