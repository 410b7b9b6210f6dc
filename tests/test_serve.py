"""Routing of papers alone and against pools, readings as typed, and strict cells."""

import os

import pytest
from pyspark.sql import functions as F

from onomast.plans import serve
from onomast.sources import tables

ROWS = [
    ("Zhang Wei", True, ["Zhang"], ["Wei"], [], ["surname", "given"], "Wei Zhang", "Zhang", "Wei", "", "Zhang Wei"),
    ("Wei Zhang", True, ["Zhang"], ["Wei"], [], ["given", "surname"], "Wei Zhang", "Zhang", "Wei", "", "Wei Zhang"),
    ("J. Ming K. Zhang", True, ["Zhang"], ["Ming"], ["J", "K"], ["middle", "given", "middle", "surname"], "Ming J K Zhang", "Zhang", "Ming", "J K", "Ming J K Zhang"),
    ("Ouyang Ming", True, ["Ou", "Yang"], ["Ming"], [], ["surname", "given"], "Ming Ouyang", "Ouyang", "Ming", "", "Ouyang Ming"),
    ("Zhang Ming K", True, ["Zhang"], ["Ming"], ["K"], ["surname", "given", "middle"], "Ming K Zhang", "Zhang", "Ming", "K", None),
    ("failed", False, None, None, None, None, "", "", "", "", None),
]


def test_as_typed(spark):
    df = spark.createDataFrame(
        [r[:10] for r in ROWS],
        "name string, success boolean, surname_tokens array<string>, given_tokens array<string>, middle_tokens array<string>, components array<string>, result string, surname string, given string, middle string",
    )
    got = {r["name"]: r["typed"] and r["typed"]["result"] for r in serve.as_typed(df).collect()}
    assert got == {r[0]: r[10] for r in ROWS}


def test_pools_and_papers(spark):
    names = [(1, 0, "Zhang Wei"), (1, 1, "Wang Hao"), (1, 2, "Yan Li"), (2, 0, "Li Ming"), (2, 1, "北京大学")]
    df = spark.createDataFrame(names, "paper_id long, pos int, name string")
    pools = df.withColumns({"pool_id": F.lit("x"), "pool_pos": (F.col("paper_id") * 10 + F.col("pos")).cast("long")})
    got = {(r["paper_id"], r["pos"]): r for r in serve.papers_and_pools(df.withColumn("pos", F.col("pos").cast("long")), pools.withColumn("pos", F.col("pos").cast("long"))).collect()}
    assert len(got) == 5
    assert got["2", 1]["router_prediction"] == "not_person" and got["2", 1]["final_result"] is None
    assert got["1", 0]["final_result"] == "Wei Zhang"


def test_strict_cells(spark):
    df = spark.createDataFrame([("yes", "1.5", "first", None), ("0", "2", "last", "NaN")], "pp_success string, pp_batch_confidence string, selected_surname_position string, pp_result string")
    rows = tables.coerce_routing(df).collect()
    assert [tuple(r) for r in rows] == [(True, 1.5, "first", ""), (False, 2.0, "last", "")]
    for bad in (("maybe", "1", "first", ""), ("yes", "inf", "first", ""), ("yes", "1", "middle", "")):
        with pytest.raises(Exception, match="must be"):
            tables.coerce_routing(spark.createDataFrame([bad], df.schema)).collect()


@pytest.mark.skipif("ONOMAST_GOLDEN" not in os.environ, reason="a JSON file of [name, success, text] is named by ONOMAST_GOLDEN")
def test_all_golden_names(spark):
    import json

    from onomast.plans.names import normalize_names

    golden = json.load(open(os.environ["ONOMAST_GOLDEN"]))
    df = spark.createDataFrame([(i, 0, g[0]) for i, g in enumerate(golden)], "batch_id long, pos int, name string")
    got = {r["name"]: r for r in normalize_names(df).collect()}
    right = sum(got[g[0]]["success"] == g[1] and (not g[1] or got[g[0]]["result"] == g[2]) for g in golden)
    assert right >= 800 * len(golden) / 826
