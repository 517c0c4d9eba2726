"""Joins on parts of texts: which texts hold which others, and the cascade that finds what a question names."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlake.functions.scalars import normalized_name
from roadlake.scratch import written

GRAM = 3


def parts_of(text: Column, n: int) -> Column:
    """The distinct runs of n characters of a text, by one pass of a pattern that looks ahead: no lambdas that are interpreted character by character."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), 1))  # the dot goes on by a whole character


def distinct_texts(asks: DataFrame) -> DataFrame:
    """id, q: each different text of asks (q) once, dealt to all tasks, however few files they came from."""
    parts = int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = asks.select("q").distinct().repartition(parts, F.xxhash64("q"))
    return written(each.select(F.monotonically_increasing_id().alias("id"), "q"), "texts")


def containing(longs: DataFrame, shorts: DataFrame, long_id: str, long: str, short_id: str, short: str) -> DataFrame:
    """(long_id, short_id) of every text that holds another as a part: an equi-join on posting lists of q-grams, then the exact test.

    Each short text is looked up by the one of its grams that the fewest long texts have; one with a gram that no long text has is out at once.
    Texts shorter than a gram are looked up whole. Ids are distinct on either side; empty and null texts match nothing.
    """
    l = longs.select(F.col(long_id).alias("_l"), F.col(long).alias("_long")).where("_long <> ''")  # noqa: E741
    s = shorts.select(F.col(short_id).alias("_s"), F.col(short).alias("_short")).where("_short <> ''")
    postings = l.select("_l", F.explode(parts_of(F.col("_long"), GRAM)).alias("_gram"))
    frequency = postings.groupBy("_gram").agg(F.count("*").alias("_df"))
    grams = s.where(F.length("_short") >= GRAM).select("_s", F.size(parts_of(F.col("_short"), GRAM)).alias("_all"), F.explode(parts_of(F.col("_short"), GRAM)).alias("_gram"))
    known = grams.join(frequency, "_gram").groupBy("_s", "_all").agg(F.count("*").alias("_known"), F.min_by("_gram", F.struct("_df", "_gram")).alias("_gram"))
    pairs = known.where("_known = _all").select("_s", "_gram").join(postings, "_gram").select("_l", "_s")
    tiny = l.select("_l", F.explode(F.concat(*[parts_of(F.col("_long"), n) for n in range(1, GRAM)])).alias("_short"))
    pairs = pairs.unionByName(tiny.join(s.where(F.length("_short") < GRAM), "_short").select("_l", "_s"))
    met = pairs.join(l, "_l").join(s, "_s").where(F.contains("_long", "_short"))
    return met.select(F.col("_l").alias(long_id), F.col("_s").alias(short_id))


def name_groups(segments: DataFrame) -> DataFrame:
    """key, name, segment_ids, count, first: segments of one normalised name; the first segment's name stands for all."""
    named = segments.select("segment_id", F.col("segment_name").alias("name"), normalized_name(F.col("segment_name")).alias("key")).where("key <> ''")
    return named.groupBy("key").agg(F.min_by("name", "segment_id").alias("name"), F.sort_array(F.collect_list("segment_id")).alias("segment_ids"), F.count("*").alias("count"), F.min("segment_id").alias("first"))


CANDIDATE = "array<struct<segment_id: string, name: string, count: bigint>>"


def _settled(hits: DataFrame, how: str) -> DataFrame:
    """id, method, segment_ids, candidates: one hit (segment_ids, name, count, first) settles a question, several make it ambiguous."""
    one = hits.groupBy("id").agg(F.count("*").alias("n"), F.min_by("segment_ids", "first").alias("ids"), F.sort_array(F.collect_list(F.struct(F.col("first").alias("segment_id"), "name", "count"))).alias("all"))
    several = F.col("n") > 1
    return one.select("id", F.when(several, "ambiguous").otherwise(how).alias("method"), F.when(~several, F.col("ids")).alias("segment_ids"), F.when(several, F.col("all")).otherwise(F.array().cast(CANDIDATE)).alias("candidates"))


def resolved_names(asks: DataFrame, segments: DataFrame, similar: DataFrame | None = None, fewest: int = 2, longer_than: int = 3, most: int = 5) -> DataFrame:
    """id, method, segment_ids, candidates: the segments that each question (id, q: a normalised text) means.

    In turn, each step sees what the ones before left open: an id that the question holds; a name that it holds, or that holds it; the most
    similar name by vectors, where given (similar: id, key); the name that shares the most words, `fewest` at least. Several ids or names are
    ambiguous and become the candidates; a question that nothing settles has the names of most shared words as candidates, filled up with
    the first ones. Segments of one name are one answer with all of them.
    """
    groups = written(name_groups(segments), "names")
    # each different text is settled once; ids meet their text's answer at the end, and nothing of their number is broadcast
    texts = distinct_texts(asks)
    open_ = lambda done: texts.join(done.select("id").hint("merge"), "id", "left_anti")
    ids = segments.select("segment_id", F.col("segment_name").alias("name"), normalized_name(F.col("segment_id")).alias("key"))
    by_id = containing(texts, ids, "id", "q", "segment_id", "key").join(ids, "segment_id")
    by_id = written(_settled(by_id.select("id", F.array("segment_id").alias("segment_ids"), "name", F.lit(1).cast("long").alias("count"), F.col("segment_id").alias("first")), "id"), "by-id")
    left = written(open_(by_id), "open")
    keys = groups.select("key", F.col("key").alias("text"))
    held = containing(left, keys, "id", "q", "key", "text")
    holds = containing(keys, left, "key", "text", "id", "q")
    named = held.unionByName(holds.select("id", "key")).distinct().join(groups, "key")
    by_name = written(_settled(named.select("id", "segment_ids", "name", "count", "first"), "alias"), "by-name")
    done = by_id.unionByName(by_name)
    none = F.array().cast(CANDIDATE)
    left = open_(done)
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("([a-z0-9]+)"), 1))
    asked = left.select("id", F.explode(F.filter(words("q"), lambda w: F.length(w) > longer_than)).alias("word"))
    shared = asked.join(groups.select("key", F.explode(words("key")).alias("word")), "word").groupBy("id", "key").agg(F.count("*").alias("shared"))
    first = groups.orderBy("first").limit(most).select("key")  # fills up what has too few
    filled = shared.unionByName(left.select("id").crossJoin(F.broadcast(first)).select("id", "key", F.lit(0).cast("long").alias("shared")))
    filled = filled.groupBy("id", "key").agg(F.max("shared").alias("shared")).join(groups, "key")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("shared"), "first"))
    best = filled.withColumn("rank", rank).where(F.col("rank") <= most).groupBy("id").agg(
        F.max("shared").alias("shared"), F.min_by("segment_ids", "rank").alias("ids"), F.sort_array(F.collect_list(F.struct("rank", F.struct(F.col("first").alias("segment_id"), "name", "count").alias("c")))).alias("all")
    )
    enough = F.coalesce(F.col("shared") >= fewest, F.lit(False))
    last = left.select("id").join(best.hint("merge"), "id", "left").select("id", F.lit("string").alias("method"), F.when(enough, F.col("ids")).alias("segment_ids"), F.when(enough | F.col("all").isNull(), none).otherwise(F.transform("all", lambda x: x["c"])).alias("candidates"))
    solved = texts.join(done.unionByName(written(last, "by-words")).hint("merge"), "id").select(F.col("q").alias("_q"), "method", "segment_ids", "candidates")
    found = asks.select("id", "q").join(solved.hint("merge"), F.col("q").eqNullSafe(F.col("_q"))).drop("q", "_q")
    if similar is not None:
        near = similar.select("id", "key").join(groups.select("key", F.col("segment_ids").alias("_ids")), "key").drop("key")
        alike = (F.col("method") == "string") & F.col("_ids").isNotNull()
        found = found.join(near.hint("merge"), "id", "left").select(
            "id", F.when(alike, "embedding").otherwise(F.col("method")).alias("method"), F.when(alike, F.col("_ids")).otherwise(F.col("segment_ids")).alias("segment_ids"), F.when(alike, none).otherwise(F.col("candidates")).alias("candidates")
        )
    return found


def most_similar(asks: DataFrame, names: DataFrame, threshold: float, block: int = 2048) -> DataFrame:
    """id, key, similarity: for each question (id, x) the name (key, y) of largest cosine, from the threshold on, ties of nine digits to the
    smaller key. Questions and names meet in bounded blocks; vectors of other lengths, zero or holding null or non-finite components don't meet."""
    n, m = asks.count(), names.count()
    across, down = max(1, -(-n // block)), max(1, -(-m // block))
    left = asks.select(F.pmod(F.xxhash64("id"), F.lit(across)).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("b"), "id", "x")
    right = names.select(F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("c"), F.pmod(F.xxhash64("key"), F.lit(down)).alias("d"), "key", "y")
    kind = asks.schema["id"].dataType.simpleString()
    met = left.groupBy("a", "b").cogroup(right.groupBy("c", "d")).applyInArrow(_block_best, f"id {kind}, key string, similarity double")
    best = met.groupBy("id").agg(F.min(F.struct((-F.round("similarity", 9)).alias("less"), "key", "similarity")).alias("best"))
    return best.select("id", F.col("best.key").alias("key"), F.col("best.similarity").alias("similarity")).where(F.col("similarity") >= threshold)


def _block_best(asks: pa.Table, names: pa.Table) -> pa.Table:
    out: list[tuple] = []

    def fine(t: pa.Table, vector: str, label: str) -> dict[int, tuple[list, np.ndarray]]:
        by_length: dict[int, tuple[list, list]] = {}
        for k, v in zip(t.column(label).to_pylist(), t.column(vector).to_pylist(), strict=True):
            x = np.array([np.nan if c is None else c for c in v or []], np.float64)
            if len(x) and np.isfinite(x).all() and x.any():
                own = by_length.setdefault(len(x), ([], []))
                own[0].append(k), own[1].append(x / np.linalg.norm(x))
        return {d: (ids, np.stack(rows)) for d, (ids, rows) in by_length.items()}

    rows = fine(names, "y", "key")
    for d, (ids, x) in fine(asks, "x", "id").items():
        if d not in rows:
            continue
        keys, y = rows[d]
        order = np.argsort(np.array(keys, object))  # so that the first of equal ones is the smallest key
        c = x @ y[order].T
        at = np.round(c, 9).argmax(1)
        out += [(i, keys[order[a]], float(v[a])) for i, a, v in zip(ids, at, c, strict=True)]
    kinds = (asks.schema.field("id").type, pa.string(), pa.float64())
    return pa.table({n: pa.array([o[j] for o in out], k) for j, (n, k) in enumerate(zip(("id", "key", "similarity"), kinds, strict=True))})
