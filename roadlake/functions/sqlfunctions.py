"""Domain scalars as SQL functions of the session: bodies are SQL, so Catalyst inlines them."""

from pyspark.sql import SparkSession

FUNCTIONS = {
    "rl_bucket(t BIGINT, width BIGINT) RETURNS BIGINT": "CAST(floor(t / width) * width AS BIGINT)",
    "rl_min_max_100(x DOUBLE, low DOUBLE, high DOUBLE) RETURNS DOUBLE": "CASE WHEN high <= low THEN 100D ELSE 1D + (x - low) / (high - low) * 99D END",
    "rl_quintile(r BIGINT, n BIGINT) RETURNS INT": "CAST(least(5, greatest(1, ceil(r * 5 / n))) AS INT)",
    "rl_haversine_m(lon1 DOUBLE, lat1 DOUBLE, lon2 DOUBLE, lat2 DOUBLE) RETURNS DOUBLE": "2 * 6371000D * asin(sqrt(least(1D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))",
    "rl_formula_guard(c STRING) RETURNS STRING": r"CASE WHEN c RLIKE '^[=+\\-@\\t\\r]' THEN concat('\'', c) ELSE c END",
    "rl_freshness(age BIGINT) RETURNS STRING": "CASE WHEN age IS NULL THEN 'unknown' WHEN greatest(0, age) <= 30 THEN 'fresh' WHEN age <= 90 THEN 'aging' ELSE 'stale' END",
}


def register(spark: SparkSession) -> list[str]:
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.split("(")[0] for h in FUNCTIONS]
