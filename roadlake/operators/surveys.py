"""Matching surveyed places with stored ones: by distance, then by title, with a report of what did not match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlake.operators.facts import first_of
from roadlake.operators.spatial import within_distance


def normalized_title(title: Column) -> Column:
    """Lower case, one blank between words."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\s+", " "))


def matched_places(stops: DataFrame, sources: DataFrame, metres: float = 25.0) -> DataFrame:
    """A row a stop: stop_id, source_id, distance_m, method (coordinates, title, or null), ambiguous, reason.

    stops: stop_id, title, lon, lat; sources: source_id, title, lon, lat. The nearest source within `metres` is the match, ties to the smaller id;
    another one within that distance makes it ambiguous. A stop without such a source takes the source of the same normalised title, if no stop
    has that by its coordinates; of several sources of a title the last id counts, and a source is given to one stop only, the smallest id.
    reason says why nothing matched: no coordinates, beyond the tolerance, or no sources.
    """
    at = stops.where("lon IS NOT NULL AND lat IS NOT NULL").select("stop_id", "lon", "lat")
    places = sources.where("lon IS NOT NULL AND lat IS NOT NULL").select("source_id", F.col("lon").alias("lon_r"), F.col("lat").alias("lat_r"))
    near = within_distance(at, places, metres).groupBy("stop_id").agg(F.min(F.struct("distance_m", "source_id")).alias("best"), F.count("*").alias("n"))
    by_place = near.select("stop_id", F.col("best.source_id").alias("source_id"), F.round("best.distance_m", 3).alias("distance_m"), (F.col("n") > 1).alias("ambiguous"))
    titled = first_of(sources.select("source_id", normalized_title(F.col("title")).alias("_t")), ["_t"], F.desc("source_id")).where("_t <> ''")
    free = titled.join(by_place.select("source_id").distinct(), "source_id", "left_anti")
    rest = stops.join(by_place, "stop_id", "left_anti").select("stop_id", normalized_title(F.col("title")).alias("_t")).join(free, "_t")
    by_title = first_of(rest, ["source_id"], F.asc("stop_id")).select("stop_id", F.col("source_id").alias("titled_id"))
    df = stops.select("stop_id", "lon", "lat").join(by_place, "stop_id", "left").join(by_title, "stop_id", "left")
    method = F.when(F.col("source_id").isNotNull(), "coordinates").when(F.col("titled_id").isNotNull(), "title")
    reason = F.when(method.isNull(), F.when(F.col("lon").isNull() | F.col("lat").isNull(), "no_coordinates").otherwise("beyond_tolerance"))
    return df.select("stop_id", F.coalesce("source_id", "titled_id").alias("source_id"), "distance_m", method.alias("method"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), reason.alias("reason"))


def match_report(matches: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: how many stops and sources there are, how many stops match by which method, ambiguously or not at all, and sources that no stop has."""
    left_over = sources.join(matches.where("source_id IS NOT NULL").select("source_id").distinct(), "source_id", "left_anti").agg(F.count("*").alias("unmatched_sources"))
    one = matches.agg(
        F.count("*").alias("stops"), F.count("method").alias("matched"), F.count_if(F.col("method") == "coordinates").alias("by_coordinates"), F.count_if(F.col("method") == "title").alias("by_title"),
        F.count_if("ambiguous").alias("ambiguous"), F.count_if(F.col("reason") == "beyond_tolerance").alias("beyond_tolerance"), F.count_if(F.col("reason") == "no_coordinates").alias("no_coordinates"),
    )
    return one.crossJoin(left_over).crossJoin(sources.agg(F.count("*").alias("sources")))  # one row each


# ---- details of a survey


def yes(answer: Column) -> Column:
    """Whether an answer of a form is affirmative; an empty one is not."""
    return F.coalesce(F.lower(F.trim(answer)).isin("ya", "yes", "true", "1"), F.lit(False))


def number(text: Column) -> Column:
    """A number that may be written with a decimal comma; null if it is none."""
    return F.regexp_replace(F.trim(text), ",", ".").try_cast("double")


def coordinates(text: Column) -> Column:
    """lon and lat of "[lon, lat]"; null if the text is no such pair or off the globe."""
    pair = F.from_json(F.trim(text), "array<double>")
    lon, lat = F.get(pair, 0), F.get(pair, 1)
    good = (F.size(pair) == 2) & lon.between(-180, 180) & lat.between(-90, 90)
    return F.when(good, F.struct(lon.alias("lon"), lat.alias("lat")))


def checklist(answers: dict[str, Column]) -> Column:
    """A map from each item to whether it is there."""
    return F.create_map(*[x for k, c in answers.items() for x in (F.lit(k), yes(c))])


def breakdown(counts: dict[str, Column]) -> Column:
    """A map of counts without those that are missing or zero."""
    return F.map_filter(F.create_map(*[x for k, c in counts.items() for x in (F.lit(k), number(c.cast("string")).cast("long"))]), lambda k, v: v.isNotNull() & (v != 0))


def source_key(*parts: Column) -> Column:
    """A stable key of a row without one: SHA-1 of its parts."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def newest_first(df: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The first rows of a list by time downward, those without one last."""
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last(order), key))
    return df.orderBy(F.desc_nulls_last(order), key).limit(most).withColumn("place", rank)  # at most `most` rows in the window
