"""Served payloads: predictions and patterns as JSON, read back with what older payloads lack derived.

A payload has a version.  Writing is strict: a row without a required value is
an error.  Reading is per row: a payload that can't be read, or lacks what a
reader needs, becomes a row with its error, and the others go on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lexicon.data import Lexicon
from . import names as plans

VERSION = 2
FORMATS = ("surname_first", "given_first", "mixed")
PATTERN = "struct<dominant_format:string,confidence:double,decision_confidence:double,surname_first_count:bigint,given_first_count:bigint,total_count:bigint,voting_count:bigint,vote_margin_count:bigint,vote_margin:double,threshold_met:boolean>"
PREDICTION = f"struct<success:boolean,error_message:string,given_name:string,surname:string,middle_name:string,confidence:double,format_pattern:{PATTERN}>"
BATCH = f"struct<version:int,batch_id:string,names:array<string>,results:array<{PREDICTION}>,format_pattern:{PATTERN},improvements:array<int>>"
#: What every version of a pattern has.
REQUIRED = ("dominant_format", "confidence", "surname_first_count", "given_first_count", "total_count", "threshold_met")
#: Reason of a result that stands in for one that couldn't be worked out.
UNAVAILABLE = "batch analysis is not available"


def pattern_struct() -> Column:
    """Of rows of patterns (``batch.pattern``): the pattern as it is served."""
    sf, gf, total = F.col("surname_first_count").cast("long"), F.col("given_first_count").cast("long"), F.col("total_count").cast("long")
    gap = F.abs(sf - gf)
    margin = F.when(total > 0, gap / total).otherwise(0.0)
    cells = (F.col("dominant_format"), F.col("confidence"), F.coalesce("decision_confidence", "confidence"), sf, gf, total, sf + gf, gap, margin, F.col("threshold_met"))
    names = [x.split(":")[0] for x in PATTERN[len("struct<") : -1].split(",")]
    return F.struct(*[c.alias(n) for c, n in zip(cells, names)]).cast(PATTERN)


def derived(pattern: Column) -> Column:
    """A pattern that was read, of any version, with the fields that six-field payloads lack; null if it lacks one that all have."""
    p = pattern
    sf, gf, total = p["surname_first_count"], p["given_first_count"], p["total_count"]
    gap = F.coalesce(p["vote_margin_count"], F.abs(sf - gf))
    whole = p.withField("decision_confidence", F.coalesce(p["decision_confidence"], p["confidence"])).withField("voting_count", F.coalesce(p["voting_count"], sf + gf)).withField("vote_margin_count", gap)
    whole = whole.withField("vote_margin", F.coalesce(p["vote_margin"], F.when(total > 0, F.abs(sf - gf) / total).otherwise(0.0)))
    return F.when(fault(p).isNull(), whole)


def fault(pattern: Column) -> Column:
    """Why a pattern can't be served, or null."""
    lacks = [F.when(pattern[c].isNull(), F.lit(f"format_pattern lacks {c}")) for c in REQUIRED]
    odd = F.when(~pattern["dominant_format"].isin(*FORMATS), F.concat(F.lit("no such format: "), pattern["dominant_format"]))
    return F.coalesce(F.when(pattern.isNull(), "no format_pattern"), *lacks, odd)


def prediction(pattern: Column) -> Column:
    """Of rows of results: one name's prediction."""
    ok = F.col("success")
    some = lambda c: F.when(ok & (F.col(c) != ""), F.col(c))
    return F.struct(ok.alias("success"), F.when(~ok, F.col("error")).alias("error_message"), F.when(ok, F.col("given")).alias("given_name"), F.when(ok, F.col("surname")).alias("surname"), some("middle").alias("middle_name"), F.col("confidence").alias("confidence"), pattern.alias("format_pattern")).cast(PREDICTION)


def predictions(results: DataFrame, patterns: DataFrame) -> DataFrame:
    """(batch_id, pos, prediction): each name's prediction with its batch's pattern."""
    p = patterns.select("batch_id", pattern_struct().alias("_p"))
    return results.join(p, "batch_id").select("batch_id", "pos", prediction(F.col("_p")).alias("prediction"))


def batch_payloads(results: DataFrame, patterns: DataFrame) -> DataFrame:
    """(batch_id, payload): one JSON text for each batch, its names in order; a batch is as long as its author list."""
    none = F.lit(None).cast(PATTERN)
    rows = results.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", prediction(none).alias("prediction"), "changed")), lambda a, b: a["pos"] - b["pos"]).alias("x"))
    rows = rows.join(patterns.select("batch_id", pattern_struct().alias("_p")), "batch_id")
    at = F.filter(F.transform("x", lambda r, i: F.when(r["changed"], i)), lambda i: i.isNotNull())
    body = F.struct(F.lit(VERSION).alias("version"), F.col("batch_id").cast("string").alias("batch_id"), F.transform("x", lambda r: r["name"]).alias("names"), F.transform("x", lambda r: r["prediction"]).alias("results"), F.col("_p").alias("format_pattern"), at.cast("array<int>").alias("improvements"))
    return rows.select("batch_id", strict(body, F.col("_p")).alias("payload"))


def strict(body: Column, pattern: Column) -> Column:
    """body as JSON, nulls left out; an error where its pattern can't be served."""
    why = fault(pattern)
    return F.when(why.isNull(), F.to_json(body)).otherwise(F.raise_error(why).cast("string"))


def read_payloads(rows: DataFrame, column: str = "payload") -> DataFrame:
    """rows with version, names, results, format_pattern, improvements and error, read from JSON of any version.

    A payload without a version is of version 1, whose pattern has six fields;
    what it lacks is derived.  Text that is null or no JSON object, a newer
    version, a pattern that lacks a field of all versions, and as many results
    as names not, give a row with error and nothing else.
    """
    text = F.col(column)
    x = F.from_json(text, BATCH)
    head = F.from_json(text, "struct<version:int>", {"mode": "PERMISSIVE"})
    version = F.coalesce(head["version"], F.lit(1))
    bad = (
        F.when(text.isNull() | ~F.coalesce(F.typeof(F.try_parse_json(text)).isNotNull() & F.try_parse_json(text).isNotNull() & text.rlike(r"^\s*\{"), F.lit(False)), "no JSON object")
        .when(version > VERSION, F.concat(F.lit("unknown version "), version.cast("string")))
        .otherwise(F.coalesce(fault(x["format_pattern"]), F.when(F.size(x["names"]) != F.size(x["results"]), "names and results differ in number")))
    )
    rows = rows.withColumns({"_x": x, "error": bad}).withColumn("version", F.when(F.col("error").isNull(), version))
    ok = F.col("error").isNull()
    cells = {c: F.when(ok, F.col("_x")[c]) for c in ("names", "results")}
    improved = F.when(ok, F.coalesce(F.col("_x.improvements"), F.array().cast("array<int>")))
    return rows.withColumns({**cells, "format_pattern": F.when(ok, derived(F.col("_x.format_pattern"))), "improvements": improved}).drop("_x")


def fallback(names: DataFrame, lex: Lexicon | None = None, singles: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, patterns) of batches where votes aren't available: each name by itself, and a mixed pattern that counts names alone.

    names: (batch_id, pos, name); singles: results of ``normalize_names``, if
    they are at hand.  Null names fail like empty ones; confidence is 0.
    """
    singles = singles if singles is not None else plans.normalize_names(names, lex)
    results = singles.withColumns({"confidence": F.lit(0.0), "changed": F.lit(False)})
    zero = lambda c: F.lit(0).cast("long").alias(c)
    patterns = names.groupBy("batch_id").agg(F.count("*").alias("total_count")).select(
        "batch_id", F.lit("mixed").alias("dominant_format"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("decision_confidence"), zero("surname_first_count"), zero("given_first_count"), "total_count", F.lit(0.0).alias("vote_margin"), F.lit(False).alias("threshold_met"), F.lit("unavailable").alias("regime"),
    )
    return results, patterns


def with_failures(names: DataFrame, results: DataFrame, reason: str = UNAVAILABLE) -> DataFrame:
    """results, and a failed row for each of names (batch_id, pos, name) that has none: no name goes without an answer."""
    lost = names.select("batch_id", "pos", "name").join(results.select("batch_id", "pos"), ["batch_id", "pos"], "left_anti")
    empty = {"success": F.lit(False), "result": F.lit(""), "surname": F.lit(""), "given": F.lit(""), "middle": F.lit(""), "order": F.lit("mixed"), "error": F.lit(reason)}
    return results.unionByName(lost.withColumns(empty), allowMissingColumns=True)
