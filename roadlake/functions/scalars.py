"""Scalar functions as column expressions: all stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadlake.schema import EARTH_M, QUINTILES


def half_up(x: Column, digits: int) -> Column:
    """Rounds half up as decimals would: values that differ from a tie by their binary representation only count as ties."""
    return F.floor(x * 10**digits + 0.500001) / 10**digits


def bucket(seconds: Column, width: int) -> Column:
    """The start of the epoch-aligned bucket of a time in seconds."""
    return (F.floor(seconds / width) * width).cast("long")


def source_mode(meta_mode: Column, meta_source: Column) -> Column:
    """An explicit mode wins; HISTORICAL data without one is SYNTHETIC; nothing at all is HISTORICAL."""
    return F.coalesce(meta_mode, F.when(meta_source == "HISTORICAL", "SYNTHETIC").otherwise(meta_source), F.lit("HISTORICAL"))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def min_max_100(x: Column, low: Column, high: Column) -> Column:
    """1..100; a range without width gives 100."""
    return F.when(high <= low, 100.0).otherwise(1.0 + (x - low) / (high - low) * 99.0)


def min_max_1(x: Column, low: Column, high: Column) -> Column:
    """0..1; a range without width gives 0."""
    return F.when(high <= low, 0.0).otherwise((x - low) / (high - low))


def quintile(rank: Column, total: Column) -> Column:
    """1..5: the rank's share of the total in fifths, rounded up."""
    return F.least(F.lit(5), F.greatest(F.lit(1), F.ceil(rank * 5 / total))).cast("int")


def quintile_label(tier: Column) -> Column:
    # element_at() of an array without nulls passes for never null, so a missing place has to be asked for
    return F.when(tier.isNotNull(), F.element_at(F.array(*map(F.lit, QUINTILES)), tier))


def tier_of_label(label: Column) -> Column:
    """5..1 by words in a label, the double words first, 0 if none is there."""
    x = F.lower(F.coalesce(label, F.lit("")))
    return (
        F.when(x.contains("sangat tinggi") | x.contains("merah"), 5)
        .when(x.contains("sangat rendah") | x.contains("hijau muda"), 1)
        .when(x.contains("tinggi") | x.contains("oranye") | x.contains("orange"), 4)
        .when(x.contains("sedang") | x.contains("kuning"), 3)
        .when(x.contains("rendah") | x.contains("hijau"), 2)
        .otherwise(0)
    )


def freshness(age_s: Column, fresh: int = 30, aging: int = 90) -> Column:
    age = F.greatest(F.lit(0), age_s)
    return F.when(age_s.isNull(), "unknown").when(age <= fresh, "fresh").when(age <= aging, "aging").otherwise("stale")


def weighted_available(parts: Sequence[tuple[float, Column]]) -> Column:
    """100 times the weighted mean of the parts that are there; null without any."""
    total = reduce(lambda a, b: a + b, [F.when(x.isNotNull(), w * x).otherwise(0.0) for w, x in parts])
    weight = reduce(lambda a, b: a + b, [F.when(x.isNotNull(), w).otherwise(0.0) for w, x in parts])
    return F.when(weight > 0, total / weight * 100)


# What names are called in short.
ALIASES = {"malioboro": "jalan malioboro", "jogja": "yogyakarta", "ugm": "universitas gadjah mada"}


def normalized_name(name: Column) -> Column:
    """Street abbreviations written out; punctuation and repeated blanks go."""
    x = F.lower(F.coalesce(name, F.lit("")))
    for pattern, word in ((r"\b(?:jl|jln)\.?\s+", "jalan "), (r"\bgg\.?\s+", "gang "), (r"\bkor\.?\s+", "koridor ")):
        x = F.regexp_replace(x, pattern, word)
    x = F.trim(F.regexp_replace(F.regexp_replace(x, r"[^\p{L}\p{N}_\s]+", " "), r"\s+", " "))
    return F.coalesce(F.create_map(*[F.lit(v) for p in ALIASES.items() for v in p])[x], x)


def keyword_score(text: Column, keywords: Sequence[str]) -> Column:
    """1 and the number of keywords that the text holds, 5 at most; null without any."""
    x = F.lower(text)
    hits = reduce(lambda a, b: a + b, [x.contains(k).cast("int") for k in keywords])
    return F.when(hits > 0, F.least(F.lit(5.0), 1.0 + hits))


def cosine(a: Column, b: Column) -> Column:
    """-1 for empty vectors, unequal lengths or a zero norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (norm == 0), -1.0).otherwise(dot(a, b) / norm)


def formula_guard(cell: Column) -> Column:
    """A quote before what a spreadsheet would run."""
    return F.when(cell.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def signature(*columns: Column) -> Column:
    """SHA-256 of the columns' canonical text."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def bucket_width(hours: float, requested: str | None = None, newest: bool = False) -> tuple[str, int]:
    """The automatic bucket of a time range, checked against the most buckets a request may have."""
    import math

    from roadlake.schema import MAX_BUCKETS

    widths = {"1m": 60, "5m": 300, "10m": 600, "15m": 900, "30m": 1800, "1h": 3600}
    if newest and requested is None and hours > MAX_BUCKETS:
        n = math.ceil(hours / MAX_BUCKETS)
        return f"{n}h", n * 3600
    name = requested or next((n for most, n in ((1, "1m"), (3, "5m"), (12, "15m")) if hours <= most), "1h")
    if name not in widths:
        raise ValueError(f"no such bucket: {name}")
    if hours * 3600 / widths[name] > MAX_BUCKETS:
        raise ValueError("more buckets than a request may have")
    return name, widths[name]
