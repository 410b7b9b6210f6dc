"""Resources: small files for all workers, and checked tables that a lexicon starts from."""

from __future__ import annotations

import json
import os

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"
VERSION = 1


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A file's bytes, from wherever Spark reads; an error where path is none or several files."""
    rows = spark.read.format("binaryFile").load(path).select("content").take(2)
    if len(rows) != 1:
        raise ValueError(f"{path} must be one file")
    return bytes(rows[0]["content"])


def read_text(spark: SparkSession, path: str) -> str:
    """A file's text in UTF-8, without a byte-order mark."""
    return read_bytes(spark, path).decode("utf-8-sig")


def read_json(spark: SparkSession, path: str):
    return json.loads(read_text(spark, path))


def ship(spark: SparkSession, path: str) -> str:
    """Sends a file to all workers; gives the name by which ``local_path`` finds it there."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path.rstrip("/"))


def local_path(name: str) -> str:
    """Where a shipped file lies on the driver or worker that asks."""
    return SparkFiles.get(name)


def fingerprint(df: DataFrame) -> dict:
    """rows, schema and hash of a table; the hash doesn't hang on the order of rows, and repeated rows count."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in df.columns]
    h = F.xxhash64(*cells).cast("decimal(38,0)") if cells else F.lit(0).cast("decimal(38,0)")
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0)).alias("h")).first()
    return {"rows": r["n"], "schema": ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields), "hash": f"{int(r['h']) % (1 << 64):016x}"}


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes each table as CSV in a folder of its name, and a manifest of their fingerprints last, so a broken write has none.

    Cells that are null or empty text come back as null; what was in the
    folder under these names is replaced.
    """
    if not tables:
        raise ValueError("no tables to write")
    spark = next(iter(tables.values())).sparkSession
    entries = {}
    for name, df in tables.items():
        df.write.mode("overwrite").csv(f"{folder}/{name}.csv", header=True)
        entries[name] = fingerprint(spark.read.csv(f"{folder}/{name}.csv", header=True, schema=df.schema))
    text = json.dumps({"version": VERSION, "tables": entries})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{MANIFEST}")


def read_tables(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a manifest that schemas name, each checked against its fingerprint and the schema asked for.

    schemas: name to columns and types.  A table that the manifest lacks, one
    of another schema, and one whose rows aren't those that were written, are
    errors that name it.
    """
    held = json.loads("".join(r[0] for r in spark.read.text(f"{folder}/{MANIFEST}").collect()))
    if held.get("version") != VERSION:
        raise ValueError(f"unknown version of {MANIFEST}: {held.get('version')}")
    out = {}
    for name, schema in schemas.items():
        entry = held["tables"].get(name)
        if entry is None:
            raise ValueError(f"{folder} has no table {name}")
        df = spark.read.csv(f"{folder}/{name}.csv", header=True, schema=schema, enforceSchema=False)
        found = fingerprint(df)
        for what in ("schema", "rows", "hash"):
            if found[what] != entry[what]:
                raise ValueError(f"table {name}: {what} is {found[what]}, not {entry[what]}")
        out[name] = df
    return out
