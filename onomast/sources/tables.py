"""Readers and writers of row files, by their ending, and of names in lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_rows(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """.parquet, .jsonl or .json, else CSV with a header; a byte-order mark before the header is dropped.
    Without a schema, CSV columns are strings."""
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.schema(schema) if schema else spark.read
    if path.endswith((".jsonl", ".json")):
        return reader.json(path)
    df = reader.csv(path, header=True, encoding="UTF-8")
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def write_rows(df: DataFrame, path: str) -> None:
    """A folder of part files in the format of the ending; columns stay even where there are no rows."""
    if path.endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    elif path.endswith((".jsonl", ".json")):
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    else:
        df.write.mode("overwrite").csv(path, header=True)


def require_columns(df: DataFrame, columns) -> DataFrame:
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return df


def names_from_lists(spark: SparkSession, batches: list[list[str]]) -> DataFrame:
    """(batch_id, pos, name) of lists in memory; order is kept in pos."""
    rows = [(i, k, n) for i, b in enumerate(batches) for k, n in enumerate(b)]
    return spark.createDataFrame(rows, "batch_id long, pos int, name string")


def explode_names(df: DataFrame, key: str, names: str) -> DataFrame:
    """(batch_id, pos, name) of a column of lists."""
    return df.select(F.col(key).alias("batch_id"), F.posexplode(names).alias("pos", "name"))


def read_byline_names(spark: SparkSession, path: str, column: str = "name", pattern: str = r"^\p{L}+(?:[ -]\p{L}+)+$") -> DataFrame:
    """Distinct names of one column that match a pattern; projection and filter reach the scan."""
    return spark.read.parquet(path).select(column).where(F.col(column).isNotNull() & F.col(column).rlike(pattern)).distinct()


def read_corpus_lines(spark: SparkSession, path: str, skip: int = 3) -> DataFrame:
    """Lines of text files without the first ``skip`` of each file."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    return lines.where((F.col("n") >= skip) & (F.col("line") != "")).select("line")


def _fail(message) -> Column:
    return F.raise_error(message)


def required_bool(c: str) -> Column:
    """true, t, yes, y or 1 and their contraries as boolean; anything else is an error when it is read."""
    low = F.lower(F.trim(F.col(c).cast("string")))
    low = F.regexp_replace(low, r"^([01])\.0$", "$1")
    bad = _fail(F.concat(F.lit(f"{c} must be a boolean: "), F.coalesce(low, F.lit("null")))).cast("boolean")
    return F.when(low.isin("true", "t", "1", "yes", "y"), True).when(low.isin("false", "f", "0", "no", "n"), False).otherwise(bad)


def required_number(c: str) -> Column:
    """A finite number, else an error when it is read."""
    x = F.col(c).cast("string").try_cast("double")
    good = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(good, x).otherwise(_fail(F.lit(f"{c} must be a finite number")).cast("double"))


def optional_number(c: str, default: float | None = None) -> Column:
    """A finite number, or the default for null, empty and NaN."""
    text = F.trim(F.col(c).cast("string"))
    empty = text.isNull() | (text == "") | (F.lower(text) == "nan")
    return F.when(empty, F.lit(default).cast("double")).otherwise(required_number(c))


def required_text(c: str, allowed: tuple[str, ...] = ()) -> Column:
    """Text that isn't empty and is one of ``allowed``, if given; else an error when it is read."""
    x = F.col(c).cast("string")
    good = x.isNotNull() & ~x.isin("", "NaN")
    if allowed:
        good = good & x.isin(*allowed)
    what = f"{c} must be one of {', '.join(allowed)}" if allowed else f"{c} is required"
    return F.when(good, x).otherwise(_fail(F.lit(what)))


def optional_text(c: str) -> Column:
    """Text; empty for null and NaN."""
    x = F.col(c).cast("string")
    return F.when(x.isNull() | (x == "NaN"), "").otherwise(x)


FORMATS = ("surname_first", "given_first", "mixed")
POSITIONS = ("first", "last", "internal", "unknown")


def coerce_routing(df: DataFrame) -> DataFrame:
    """Router rows from a file of any types, each known column by its kind; a bad cell is an error that names its column."""
    ends = {"success": required_bool, "threshold_met": required_bool, "result": optional_text, "selected_format": lambda c: required_text(c, FORMATS), "dominant_format": lambda c: required_text(c, FORMATS), "surname_position": lambda c: required_text(c, POSITIONS), "ratio": optional_number}
    flags = ("has_cjk", "has_latin", "cjk_has_space")

    def one(c: str) -> Column:
        if c in flags:
            return required_bool(c)
        for end, kind in ends.items():
            if c.endswith(end):
                return kind(c)
        if c.endswith(("count", "raw_tokens")):
            return required_number(c).cast("long")
        if c.endswith(("frequency", "confidence", "margin")):
            return optional_number(c, 0.0) if c.endswith("frequency") else required_number(c)
        return F.col(c)

    return df.select(*[one(c).alias(c) for c in df.columns])


def _kinds(columns) -> dict[str, tuple[str, object]]:
    """For each known column what a cell must be (bool, number, count, text), and the values allowed or the default."""
    out: dict[str, tuple[str, object]] = {}
    for c in columns:
        if c in ("has_cjk", "has_latin", "cjk_has_space") or c.endswith(("success", "threshold_met")):
            out[c] = ("bool", None)
        elif c.endswith(("selected_format", "dominant_format")):
            out[c] = ("text", FORMATS)
        elif c.endswith("surname_position"):
            out[c] = ("text", POSITIONS)
        elif c.endswith("ratio"):
            out[c] = ("optional", None)
        elif c.endswith("frequency"):
            out[c] = ("optional", 0.0)
        elif c.endswith(("count", "raw_tokens")):
            out[c] = ("count", None)
        elif c.endswith(("confidence", "margin")):
            out[c] = ("number", None)
        elif c.endswith("result"):
            out[c] = ("any", None)
    return out


def isolated_routing(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows as ``coerce_routing`` makes them, bad rows with error): a bad cell fails its own row, while the others go on.

    A bad row keeps its columns as they came; error names its first bad column
    in the order of the columns and shows the cell.  Every row is in one of the
    two; both are empty for an empty table.
    """
    faults = []
    for c, (kind, what) in _kinds(df.columns).items():
        text = F.trim(F.col(c).cast("string"))
        low = F.regexp_replace(F.lower(text), r"^([01])\.0$", "$1")
        number = text.try_cast("double")
        finite = F.coalesce(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf")), F.lit(False))
        empty = text.isNull() | (text == "") | (F.lower(text) == "nan")
        good = {
            "bool": F.coalesce(low.isin("true", "t", "1", "yes", "y", "false", "f", "0", "no", "n"), F.lit(False)),
            "number": finite,
            "count": finite,
            "optional": empty | finite,
            "text": F.coalesce(F.col(c).cast("string").isin(*(what or ())), F.lit(False)),
            "any": F.lit(True),
        }[kind]
        faults.append(F.when(~good, F.concat(F.lit(f"{c}: "), F.coalesce(text, F.lit("null")))))
    rows = df.withColumn("_fault", F.coalesce(*faults, F.lit(None).cast("string")) if faults else F.lit(None).cast("string"))
    good = coerce_routing(rows.where("_fault is null").drop("_fault"))
    return good, rows.where("_fault is not null").withColumn("error", F.col("_fault")).drop("_fault")
