"""Cuts of a plan by tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def fresh(name: str, spark: SparkSession) -> str:
    """A path of its own in the folder that ``spark.checkpoint.dir`` names; only where that is unset, as in local tests, a folder of our own takes its place."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="onomast-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so several readers share one run of it."""
    spark = df.sparkSession
    path = fresh(name, spark)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
