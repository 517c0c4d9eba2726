"""Vectors of segment names: which names need one again, by the hash of their content, applied as one version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlake.functions.scalars import ALIASES
from roadlake.operators.texts import name_groups
from roadlake.sources.buckets import KeyedTable


def name_contents(segments: DataFrame) -> DataFrame:
    """name_key, display_name, segment_ids, content and content_hash of each normalised name: the name, and the aliases that mean it."""
    aliases = F.create_map(*[x for key in sorted(set(ALIASES.values())) for x in (F.lit(key), F.lit(" ".join(a for a, k in ALIASES.items() if k == key)))])
    content = F.trim(F.concat_ws(" ", "name", F.try_element_at(aliases, F.col("key"))))
    groups = name_groups(segments)
    return groups.select(F.col("key").alias("name_key"), F.col("name").alias("display_name"), "segment_ids", content.alias("content"), F.sha2(content, 256).alias("content_hash"))


def name_changes(segments: DataFrame, stored: DataFrame | None) -> DataFrame:
    """name_contents with change: new, changed, same, or gone for stored names (name_key, content_hash) that no segment has."""
    own = name_contents(segments)
    if stored is None:
        return own.withColumn("change", F.lit("new"))
    both = own.join(stored.select("name_key", F.col("content_hash").alias("_stored")), "name_key", "full")
    change = F.when(F.col("content_hash").isNull(), "gone").when(F.col("_stored").isNull(), "new").when(F.col("_stored") == F.col("content_hash"), "same").otherwise("changed")
    return both.withColumn("change", change).drop("_stored")


def backfill(table: KeyedTable, segments: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
    """Brings a table of name vectors up to date and says how many names were of each kind. embed adds the column `embedding` to names by their content.

    Only new and changed names are embedded; names that are gone are removed. A second run changes nothing, and writes nothing. Names that
    embed leaves without a vector are not stored, so that the next run tries them again.
    """
    changes = name_changes(segments, table.read())
    counts = {"new": 0, "changed": 0, "same": 0, "gone": 0} | {r.change: r["count"] for r in changes.groupBy("change").count().collect()}
    if counts["new"] + counts["changed"]:
        made = embed(changes.where("change IN ('new', 'changed')").drop("change")).where("embedding IS NOT NULL").withColumn("dim", F.size("embedding"))
        table.upsert(made)
    if counts["gone"]:
        table.delete(changes.where("change = 'gone'").select("name_key"))
    return counts
