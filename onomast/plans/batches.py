"""Registered queries of batches from candidates to readings, over candidates that the driver's keys make up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import batch
from ..operators.render import NOT_PLAUSIBLE
from . import names as plans
from .catalogue import query

THRESHOLD, MINIMUM = 0.67, 3
R = "struct<result:string,surname:string,given:string,middle:string,surname_tokens:array<string>,given_tokens:array<string>,middle_tokens:array<string>,order:array<string>>"
CAND = f"struct<k:int,s:array<int>,g:array<int>,kind:string,form:string,score:double,plain:double,r:{R}>"
# Of each row: plain score surname-first and given-first, null where there is no such candidate; the guarded bonus of the latter; what the token facts would say.
MADE = f"""r AS (SELECT l_orderkey AS batch_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(plans.ORDER_BY)}) - 1 AS pos, l_partkey AS p, l_suppkey AS s, l_linenumber AS n FROM lineitem),
e AS (SELECT *, CASE WHEN p % 3 <> 1 THEN p % 7 END AS sf, CASE WHEN p % 3 <> 0 THEN s % 7 END AS gf, CASE WHEN n % 5 = 0 THEN 4 ELSE 0 END AS bonus, s % 11 = 0 AS failed, p % 13 <> 0 AS latin, n % 6 = 1 AS caps, 3 + s % 6 AS letters, p % 300 AS ev, (p % 40) * 50 AS ppm0, (s % 40) * 50 AS ppm1 FROM r),
o AS (SELECT *, latin AND NOT failed AS ok, CASE WHEN sf IS NULL THEN 'given_first' WHEN gf > sf THEN 'given_first' ELSE 'surname_first' END AS own0, CASE WHEN sf IS NULL THEN 'given_first' WHEN gf + bonus > sf THEN 'given_first' ELSE 'surname_first' END AS alone0 FROM e),
v AS (SELECT *, CASE WHEN ok THEN own0 END AS own, CASE WHEN ok THEN alone0 END AS alone, ok AND NOT caps AS votes, CASE WHEN sf IS NULL OR gf IS NULL THEN 1.0 ELSE greatest(0.1, 2.0 * abs(sf - gf)) END AS weight, (sf IS NULL OR gf IS NULL) AS sole FROM o),
t AS (SELECT *, votes AND own = 'surname_first' AND alone = 'given_first' AS turned FROM v),
g AS (SELECT batch_id, sum(turned::INT) > 0 AND sum(turned::INT) + sum((votes AND own = 'given_first')::INT) >= 0.75 * sum(votes::INT) AND (sum((turned AND letters >= 6)::INT) >= 0.5 * sum(turned::INT) OR coalesce(quantile_cont(ev, 0.5) FILTER (turned) < 130, false)) AS promote FROM t GROUP BY batch_id),
w AS (SELECT t.*, CASE WHEN votes THEN CASE WHEN promote AND turned THEN 'given_first' ELSE own END END AS vote FROM t JOIN g USING (batch_id)),
a AS (SELECT batch_id, count(*) AS size, sum(votes::INT) AS total, sum((vote = 'surname_first')::INT) AS nsf, sum((vote = 'given_first')::INT) AS ngf, round(coalesce(sum(weight) FILTER (vote = 'surname_first'), 0), 6) AS sw, round(coalesce(sum(weight) FILTER (vote = 'given_first'), 0), 6) AS gw,
  sum((vote = 'surname_first' AND sole)::INT) AS sa, sum((vote = 'given_first' AND sole)::INT) AS ga, sum(CASE WHEN votes THEN CASE WHEN ppm0 > 1000 THEN 2 WHEN ppm0 > 100 THEN 1 ELSE 0 END ELSE 0 END) AS s0, sum(CASE WHEN votes THEN CASE WHEN ppm1 > 1000 THEN 2 WHEN ppm1 > 100 THEN 1 ELSE 0 END ELSE 0 END) AS s1 FROM w GROUP BY batch_id),
b0 AS (SELECT * REPLACE (coalesce(nsf, 0) AS nsf, coalesce(ngf, 0) AS ngf, coalesce(sa, 0) AS sa, coalesce(ga, 0) AS ga) FROM a),
b1 AS (SELECT *, CASE WHEN total = 0 THEN 'mixed' WHEN nsf > ngf THEN 'surname_first' WHEN ngf > nsf THEN 'given_first' WHEN sw > gw THEN 'surname_first' WHEN gw > sw THEN 'given_first' WHEN s0 + 0.5 >= s1 THEN 'surname_first' ELSE 'given_first' END AS fmt,
  CASE WHEN total = 0 THEN 0.0::DOUBLE WHEN nsf <> ngf THEN greatest(nsf, ngf) / (nsf + ngf) WHEN sw <> gw THEN greatest(sw, gw) / (sw + gw) ELSE 0.5 END AS dc FROM b0),
b AS (SELECT *, total > 0 AND dc >= CASE WHEN size < {MINIMUM} THEN {batch.THRESHOLD} ELSE {THRESHOLD} END AND dc > 0.5 AND (nsf <> ngf OR CASE WHEN fmt = 'surname_first' THEN sa > 0 ELSE ga > 0 END) AND nsf + ngf >= 2 AND nsf + ngf >= 0.5 * total AS would FROM b1),
c AS (SELECT w.*, fmt, would AND size >= {MINIMUM} AS met FROM w JOIN b USING (batch_id)),
d AS (SELECT *, CASE WHEN met THEN CASE WHEN votes THEN CASE WHEN (fmt = 'surname_first' AND sf IS NOT NULL) OR (fmt = 'given_first' AND gf IS NOT NULL) THEN fmt ELSE own END END WHEN ok THEN alone END AS chosen FROM c),
f AS (SELECT *, CASE WHEN chosen IS NOT NULL THEN CASE WHEN chosen = 'given_first' AND p % 17 = 0 THEN '{NOT_PLAUSIBLE}' END WHEN failed THEN 'failed' END AS error FROM d),
h AS (SELECT *, CASE WHEN error IS NOT NULL THEN '' WHEN chosen IS NOT NULL THEN chosen || '-' || p ELSE 'single-' || p END AS result, CASE WHEN error IS NOT NULL THEN 'mixed' ELSE coalesce(chosen, 'given_first') END AS form FROM f),
i AS (SELECT *, met AND votes AND error IS NULL AND alone <> form AS changed FROM h)"""


def made_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch_id, pos, and the keys p, s and n of lineitem), dealt by batch_id in an exchange that all parts of a plan share."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    li = li.select(F.col("l_orderkey").alias("batch_id"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n")).repartition("batch_id")
    # Lines that the other columns of plans.ORDER_BY would put in order are made alike, so their places may change.
    return li.withColumn("pos", F.row_number().over(Window.partitionBy("batch_id").orderBy("n", "s", "p")) - 1)


def made_entries(rows: DataFrame) -> DataFrame:
    """``made_rows`` (and what else they have) as ``batch.entries`` takes them."""
    p, s, n = F.col("p"), F.col("s"), F.col("n")
    text = lambda form: F.when((F.lit(form) == "given_first") & (p % 17 == 0), None).otherwise(F.concat(F.lit(f"{form}-"), p))
    none = F.array().cast("array<string>")
    part = lambda result: F.struct(result.alias("result"), F.lit("S").alias("surname"), F.lit("G").alias("given"), F.lit("").alias("middle"), F.array(F.lit("S")).alias("surname_tokens"), F.array(F.lit("G")).alias("given_tokens"), none.alias("middle_tokens"), F.array(F.lit("surname"), F.lit("given")).alias("order")).cast(R)

    def cand(k: int, form: str, plain, bonus, fits):
        return F.when(fits, F.struct(F.lit(k).alias("k"), F.array(F.lit(0)).alias("s"), F.array(F.lit(1)).alias("g"), F.lit("single").alias("kind"), F.lit(form).alias("form"), (plain + bonus).cast("double").alias("score"), plain.cast("double").alias("plain"), part(text(form)).alias("r")).cast(CAND))

    cands = F.filter(F.array(cand(3, "surname_first", p % 7, F.lit(0), p % 3 != 1), cand(4, "given_first", s % 7, F.when(n % 5 == 0, 4).otherwise(0), p % 3 != 0)), lambda c: c.isNotNull())
    fact = lambda ppm, ev: F.struct(ppm.cast("double").alias("ppm"), ev.cast("double").alias("ev_ppm"))
    failed = F.when(s % 11 == 0, "failed")
    return rows.select(
        *[c for c in rows.columns if c not in ("p", "s", "n")], F.concat(F.lit("name-"), p, F.lit("-"), s).alias("name"), failed.alias("failed"), failed.alias("error"), F.when(p % 13 == 0, "han_only").otherwise("latin_only").alias("script"),
        (n % 6 == 1).alias("caps"), cands.alias("cands"), F.array(F.substring(F.lit("abcdefghij"), F.lit(1), (3 + s % 6).cast("int")), F.lit("x")).alias("roman"), F.array(fact((p % 40) * 50, p % 300), fact((s % 40) * 50, s)).alias("facts"),
        F.struct(F.array(F.lit(0)).alias("s"), F.lit("given_first").alias("form")).alias("choice"), part(F.concat(F.lit("single-"), p)).alias("r"),
    )


def voted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.promote(batch.entries(made_entries(made_rows(spark, sf_dir))))


def patterns(rows: DataFrame) -> DataFrame:
    """The patterns of ``made_rows``."""
    return batch.pattern(batch.tally(batch.ballots(batch.entries(made_entries(rows)), "batch_id")), THRESHOLD, MINIMUM)


def applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows meet their batch's pattern as keys; entries are made of them after it."""
    rows = made_rows(spark, sf_dir)
    return batch.read_under(batch.entries(made_entries(batch.under(rows, patterns(rows)))))


@query("batch_promote", f"WITH {MADE} SELECT batch_id, pos, votes, turned, vote FROM w")
def _(spark, sf_dir):
    """The vote of each name, after guarded given-first readings were promoted."""
    return voted(spark, sf_dir).select("batch_id", "pos", "votes", "turned", "vote")


@query("batch_individual", f"""WITH {MADE} SELECT batch_id, size, total::BIGINT AS total_count, fmt AS dominant_format, round(dc, 6) AS decision_confidence, would AS would_meet, would AND size >= {MINIMUM} AS threshold_met,
  CASE WHEN size < {MINIMUM} THEN 'individual' WHEN would THEN 'batch' ELSE 'weak' END AS regime FROM b""")
def _(spark, sf_dir):
    """Patterns of batches under the threshold of their size, and how each batch is read."""
    return patterns(made_rows(spark, sf_dir)).select("batch_id", "size", "total_count", "dominant_format", F.round("decision_confidence", 6).alias("decision_confidence"), "would_meet", "threshold_met", "regime")


@query("batch_apply", f"WITH {MADE} SELECT batch_id, pos, error IS NULL AS success, result, error, form AS format, changed FROM i")
def _(spark, sf_dir):
    """The reading of each name under its batch's pattern, or by itself."""
    return applied(spark, sf_dir).select("batch_id", "pos", "success", "result", "error", F.col("order").alias("format"), "changed")


@query("batch_improvements", f"WITH {MADE} SELECT batch_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM i WHERE changed GROUP BY batch_id")
def _(spark, sf_dir):
    """The places of the names whose format their batch changed."""
    return batch.improvements(applied(spark, sf_dir)).select("batch_id", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


@query("batch_lineage", f"WITH {MADE} SELECT batch_id, pos, 'name-' || p || '-' || s AS name, alone AS \"from\", form AS \"to\", CASE WHEN alone = 'given_first' AND p % 17 = 0 THEN NULL ELSE alone || '-' || p END AS single, result FROM i WHERE changed")
def _(spark, sf_dir):
    """Those names with both readings."""
    return batch.lineage(applied(spark, sf_dir))


@query("batch_confidence", f"""WITH {MADE} SELECT batch_id, pos, round(CASE WHEN NOT ok THEN CASE WHEN error IS NULL THEN 1.0 ELSE 0.0 END WHEN sole THEN 1.0
  ELSE 1 / (exp(sf - greatest(sf, gf + bonus)) + exp(gf + bonus - greatest(sf, gf + bonus))) END, 6)::DOUBLE AS confidence FROM i""")
def _(spark, sf_dir):
    """How sure the best candidate of each name is among all."""
    return applied(spark, sf_dir).select("batch_id", "pos", F.round("confidence", 6).alias("confidence"))
