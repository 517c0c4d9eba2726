"""A session with the settings the operators are written for."""

from pyspark.sql import SparkSession


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; partition numbers are left to adaptive coalescing."""
    b = SparkSession.builder.master(master).appName("roadlake")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (settings | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
