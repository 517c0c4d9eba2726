"""Tables between steps: written to a folder that all executors share and read back, so that what follows does not compute them again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, else the session's checkpoint folder; a local master without either gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: it has to name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="roadlake-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def path_of(spark: SparkSession, path: str):
    """A path for Hadoop's file systems, and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table that goes when the application ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/roadlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    p, system = path_of(spark, path)
    system.deleteOnExit(p)
    return spark.read.schema(df.schema).parquet(path)
