"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what ``spark.checkpoint.dir`` names.  Only where that is unset, as
    in local tests, a folder of our own takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="onomast-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, codec: str = "zstd", **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: its lineage is cut,
    and a lost executor costs no more than the tasks that ran there."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    schema = df.schema
    df.write.options(compression=codec, **options).parquet(path)
    return spark.read.schema(schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs that run within hand at most about this many bytes to Python at once, or a single row."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; the usual lower() serves where a text is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null where the id is null."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def arrow_map(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow, with this package on the workers' path.

    A cluster gets the package by --py-files or its image; where driver and
    workers share a file system, as in local mode, the path alone is enough.
    """
    env = df.sparkSession.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH", ""), root) if x)
    return df.mapInArrow(run, schema)
