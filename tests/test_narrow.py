"""Rows of batches stay narrow: counts and readings come from distinct names, and nothing wide is dealt or sorted."""

import re

import pytest
from pyspark.sql import functions as F

from onomast.operators import batch
from onomast.plans import batches, catalogue, serve
from onomast.plans import names as plans

SMOKE = "/root/testdata/sf0.001"
WIDE = r"\b(cands|facts|fore|pairs|choice)#"


def dealt(df):
    """The exchanges of the plan that ran, those that are used again left out, and what each deals."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [x for x in re.findall(r"\(\d+\) Exchange.*?\nInput \[\d+\]: \[(.*?)\]\nArguments", plan, re.S)]


@pytest.fixture(scope="module")
def papers(spark):
    return catalogue.papers(spark, SMOKE)


def test_tally_is_votes_after_promote(spark):
    rows = batches.made_rows(spark, SMOKE).withColumn("batch_id", F.when(F.col("batch_id") % 50 > 0, F.col("batch_id") % 300))
    e = batch.entries(batches.made_entries(rows))
    r = lambda df: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in row) for row in df.collect())
    want = r(batch.votes(batch.promote(e)))
    assert r(batch.tally(batch.ballots(e, "batch_id"))) == want and len(want) > 200
    assert batch.promote(e).where("promote and turned").count() > 0


def test_made_batches(spark):
    rows = batches.made_rows(spark, SMOKE)
    e = batch.entries(batches.made_entries(rows))
    p = batch.pattern(batch.votes(batch.promote(e)), batches.THRESHOLD, batches.MINIMUM)
    columns = ["batch_id", "pos", "result", "error", "order", "changed"]
    want = batch.apply(e, p).select(columns)
    got = batches.applied(spark, SMOKE).select(columns)
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()
    assert not [x for x in dealt(catalogue.QUERIES["batch_lineage"](spark, SMOKE)) if re.search(WIDE, x)]


@pytest.mark.parametrize("of", ["results", "evidence", "papers"])
def test_rows_of_papers_are_narrow(spark, papers, small, of):
    rows, patterns = small
    df = {"results": rows.select(*plans.RESULT, *plans.PARSED), "evidence": plans.evidence(rows), "papers": plans.pp_rows(rows)}[of]
    found = dealt(df)
    assert found and not [x for x in found if re.search(WIDE, x)]
    # One exchange of the rows, of four keys, which counts and rows share.
    assert len([x for x in found if "l_suppkey" in x]) <= 2 and all(len(x.split(", ")) == 4 for x in found if "l_suppkey" in x)
    assert df.count() == spark.read.parquet(f"{SMOKE}/lineitem.parquet").count()


@pytest.fixture(scope="module")
def small(spark, papers):
    return plans.analysed(lex=catalogue.lex(spark), also=serve.as_typed, **papers)


def test_states_are_readings_under_patterns(spark, papers, small):
    """A name's reading in the state of its batch is what its entry gives under the pattern itself."""
    rows, patterns = small
    table = batch.entries(plans.single_result(plans.name_table(papers["known"], catalogue.lex(spark))))
    whole = papers["names"].join(table, "name").withColumn("pos", F.col("pos"))
    columns = ["batch_id", "pos", "name", "success", "result", "error", "order", "changed", "surname_tokens", "components"]
    want, got = batch.apply(whole, patterns).select(columns), rows.select(columns)
    assert want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()
    assert {r[0] for r in rows.select("state").distinct().collect()} == {0, 1, 2}


def test_evidence_of_a_batch_comes_from_its_pattern(spark, small):
    rows, patterns = small
    p = patterns.select("batch_id", F.struct("dominant_format", "threshold_met", "total_count", "decision_confidence", "vote_margin").alias("want"))
    ev = plans.evidence(rows)
    got = ev.select("batch_id", F.struct(*[F.col(c) for c in ev.columns[-5:]]).alias("got")).distinct().join(p, "batch_id")
    assert got.count() == patterns.count() and got.where("to_json(struct(got.*)) IS NULL OR hash(got) <> hash(want)").isEmpty()
    assert ev.where("batch_applied <> (batch_threshold_met AND batch_participant AND selected_format <> 'mixed')").isEmpty()
