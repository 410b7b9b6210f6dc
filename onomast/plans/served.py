"""Registered queries of served payloads and of rows that fail by themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from . import payloads
from .catalogue import VOTE_SQL, made_votes, query, quoted

# Payloads of three kinds by key: whole ones, old ones of six fields, and bad ones of four sorts.
KIND = "CASE WHEN batch_id % 7 = 0 THEN 'bad' WHEN batch_id % 3 = 0 THEN 'old' ELSE 'new' END"
TRIP_SQL = f"""{VOTE_SQL}, c AS (SELECT batch_id, {KIND} AS kind, fmt, round(CASE WHEN t = 0 THEN 0 WHEN fmt = 'surname_first' THEN sf / t WHEN fmt = 'given_first' THEN gf / t ELSE 0 END, 6)::DOUBLE AS confidence, sf::BIGINT AS sf, gf::BIGINT AS gf, t::BIGINT AS t, round(dc, 6)::DOUBLE AS dc FROM b)
SELECT batch_id, CASE WHEN kind <> 'bad' THEN CASE kind WHEN 'old' THEN 1 ELSE 2 END END AS version, CASE WHEN kind <> 'bad' THEN fmt END AS dominant_format, CASE kind WHEN 'old' THEN confidence WHEN 'new' THEN dc END AS decision_confidence,
  CASE WHEN kind <> 'bad' THEN sf + gf END AS voting_count, CASE WHEN kind <> 'bad' THEN abs(sf - gf) END AS vote_margin_count, CASE WHEN kind <> 'bad' THEN round(CASE WHEN t > 0 THEN abs(sf - gf) / t ELSE 0 END, 6)::DOUBLE END AS vote_margin,
  CASE WHEN kind = 'bad' THEN CASE batch_id % 4 WHEN 0 THEN 'no JSON object' WHEN 1 THEN 'unknown version 9' WHEN 2 THEN 'format_pattern lacks total_count' ELSE 'no such format: sideways' END END AS error FROM c"""


@query("dto_roundtrip", TRIP_SQL)
def _(spark, sf_dir):
    """Patterns of made votes written as JSON of both versions, or badly, and read back."""
    from ..operators import batch

    p = batch.pattern(made_votes(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("confidence", "decision_confidence")})
    kind, full = F.expr(KIND), payloads.pattern_struct()
    old = F.struct(*[full[c].alias(c) for c in payloads.REQUIRED])
    body = lambda version, pattern: F.to_json(F.struct(F.lit(version).alias("version"), F.lit("b").alias("batch_id"), F.array(F.lit("Wei Li")).alias("names"), F.array(F.struct(F.lit(True).alias("success"))).alias("results"), pattern.alias("format_pattern")))
    four = F.col("batch_id") % 4
    bad = F.when(four == 0, "[1, 2").when(four == 1, body(9, full)).when(four == 2, body(2, full.dropFields("total_count"))).otherwise(body(2, full.withField("dominant_format", F.lit("sideways"))))
    rows = p.select("batch_id", F.when(kind == "bad", bad).when(kind == "old", body(None, old)).otherwise(payloads.strict(F.from_json(body(2, full), payloads.BATCH), full)).alias("payload"))
    got = payloads.read_payloads(rows)
    q = F.col("format_pattern")
    return got.select("batch_id", "version", q["dominant_format"].alias("dominant_format"), q["decision_confidence"].alias("decision_confidence"), q["voting_count"].alias("voting_count"), q["vote_margin_count"].alias("vote_margin_count"), F.round(q["vote_margin"], 6).alias("vote_margin"), "error")


BOOLS, NUMBERS, PLACES = ["yes", "0", "maybe", "TRUE"], ["1.5", "nan", "2", "inf", "x"], ["first", "last", "middle"]
CELLS = f"cells AS (SELECT l_orderkey AS k, l_linenumber::INT AS i, [{quoted(BOOLS)}][1 + l_suppkey % {len(BOOLS)}] AS pp_success, [{quoted(NUMBERS)}][1 + l_partkey % {len(NUMBERS)}] AS pp_batch_confidence, [{quoted(PLACES)}][1 + l_orderkey % {len(PLACES)}] AS selected_surname_position FROM lineitem)"


def made_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    of = lambda words, c: F.get(F.array(*map(F.lit, words)), (F.col(c) % len(words)).cast("int"))
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), of(BOOLS, "l_suppkey").alias("pp_success"), of(NUMBERS, "l_partkey").alias("pp_batch_confidence"), of(PLACES, "l_orderkey").alias("selected_surname_position"))


@query("fallback_row", f"""WITH {CELLS}, f AS (SELECT *, CASE WHEN pp_success = 'maybe' THEN 'pp_success: maybe' WHEN pp_batch_confidence IN ('nan', 'inf', 'x') THEN 'pp_batch_confidence: ' || pp_batch_confidence WHEN selected_surname_position = 'middle' THEN 'selected_surname_position: middle' END AS error FROM cells)
SELECT k, i, CASE WHEN error IS NULL THEN pp_success <> '0' ELSE false END AS success, CASE WHEN error IS NULL THEN pp_batch_confidence::DOUBLE END AS confidence, error FROM f""")
def _(spark, sf_dir):
    """Router rows of which some have a bad cell: each of those is a failed row, and the others are read."""
    good, bad = tables.isolated_routing(made_cells(spark, sf_dir))
    ok = good.select("k", "i", F.col("pp_success").alias("success"), F.col("pp_batch_confidence").alias("confidence"), F.lit(None).cast("string").alias("error"))
    return ok.unionByName(bad.select("k", "i", F.lit(False).alias("success"), F.lit(None).cast("double").alias("confidence"), "error"))
