"""Batches read by pattern or name by name, what a batch changes, served payloads, and rows that fail alone."""

import json

import pytest
from pyspark.sql import functions as F

from onomast.plans import names as plans
from onomast.plans import payloads
from onomast.sources import tables

BATCHES = {
    1: ["Zhang Wei", "Liu Yuehua", "Gao Shan", "Li Xiaoming"],
    2: ["Zhang Wei"],
    3: ["Zhang Wei", "Wang Hao"],
    4: ["Wang An", "Yan Li", "Wu Gang", "Li Bao"],
    5: ["北京大学", None, ""],
}
READ = ["Wei Zhang", "Yue-Hua Liu", "Shan Gao", "Xiao-Ming Li"]


@pytest.fixture(scope="module")
def run(spark):
    rows = [(b, i, n) for b, ns in BATCHES.items() for i, n in enumerate(ns)]
    names = spark.createDataFrame(rows, "batch_id long, pos int, name string")
    out = plans.analyze_batches(names, minimum=3)
    return names, *(df.cache() for df in out)


def test_small_batches_are_read_name_by_name(spark, run):
    names, results, patterns, _ = run
    by = {r["batch_id"]: r for r in patterns.collect()}
    assert {k: r["regime"] for k, r in by.items()} == {1: "batch", 2: "individual", 3: "individual", 4: "batch", 5: "weak"}
    assert by[3]["would_meet"] and not by[3]["threshold_met"] and by[3]["surname_first_count"] == 2
    assert [by[1][c] for c in ("surname_first_count", "given_first_count", "dominant_format")] == [4, 0, "surname_first"]
    single = {(r["batch_id"], r["pos"]): r for r in plans.normalize_names(names).collect()}
    for r in results.where("batch_id in (2, 3, 5)").collect():
        assert (r["success"], r["result"], r["error"]) == tuple(single[r["batch_id"], r["pos"]][c] for c in ("success", "result", "error"))
    got = {(r["batch_id"], r["pos"]): r["result"] for r in results.collect()}
    assert [got[1, i] for i in range(4)] == READ
    # The default minimum reads the batch of two by its pattern.
    assert {r["batch_id"]: r["regime"] for r in plans.analyze_batches(names)[1].collect()}[3] == "batch"


def test_improvements(run):
    names, results, _, evidence = run
    rows = plans.batch_improvements(names, minimum=3).collect()
    changed = {(r["batch_id"], r["pos"]) for r in results.where("changed").collect()}
    assert {(r["batch_id"], r["pos"]) for r in rows} == changed == {(r["batch_id"], r["pos"]) for r in evidence.where("batch_changed_format").collect()}
    assert all(r["from"] != r["to"] and r["single"] != r["result"] for r in rows)
    assert (4, 1) in changed


def test_payloads_round_trip(run):
    _, results, patterns, _ = run
    rows = payloads.batch_payloads(results, patterns)
    text = {r["batch_id"]: json.loads(r["payload"]) for r in rows.collect()}
    assert text[1]["names"] == BATCHES[1] and text[1]["version"] == payloads.VERSION
    assert [p["given_name"] + " " + p["surname"] for p in text[1]["results"]] == READ
    assert text[5]["results"][0] == {"success": False, "error_message": "not a personal name", "confidence": 0.0}
    back = {r["batch_id"]: r for r in payloads.read_payloads(rows).collect()}
    assert all(r["error"] is None for r in back.values()) and back[1]["names"] == BATCHES[1]
    want = {r["batch_id"]: r["p"] for r in patterns.select("batch_id", payloads.pattern_struct().alias("p")).collect()}
    assert {k: r["format_pattern"] for k, r in back.items()} == want
    assert back[4]["improvements"] == [r["pos"] for r in results.where("batch_id = 4 and changed").orderBy("pos").collect()]
    one = payloads.predictions(results, patterns).where("batch_id = 1 and pos = 0").first()["prediction"]
    assert (one["given_name"], one["surname"], one["middle_name"], one["format_pattern"]["voting_count"]) == ("Wei", "Zhang", None, 4)


def test_payloads_that_fail_alone(spark):
    six = {"dominant_format": "given_first", "confidence": 0.75, "surname_first_count": 1, "given_first_count": 3, "total_count": 4, "threshold_met": True}
    body = lambda p, **more: json.dumps({"names": ["a"], "results": [{"success": True}], "format_pattern": p} | more)
    cases = [body(six), body(six | {"vote_margin": 0.125}), None, "", "{", "[]", "null", body(None), body(six, version=3), body(six, names=[]), body(six | {"total_count": 0}), body({k: v for k, v in six.items() if k != "threshold_met"})]
    df = spark.createDataFrame([(i, c, "clash") for i, c in enumerate(cases)], "id int, payload string, error string")
    got = {r["id"]: r for r in payloads.read_payloads(df).collect()}
    assert [i for i in got if got[i]["error"] is None] == [0, 1, 10]
    assert got[0]["format_pattern"].asDict() == six | {"decision_confidence": 0.75, "voting_count": 4, "vote_margin_count": 2, "vote_margin": 0.5}
    assert got[1]["format_pattern"]["vote_margin"] == 0.125 and got[10]["format_pattern"]["vote_margin"] == 0.0
    assert {got[i]["error"] for i in (2, 3, 4, 5, 6)} == {"no JSON object"}
    assert got[8]["error"] == "unknown version 3" and got[9]["error"] == "names and results differ in number" and got[11]["error"] == "format_pattern lacks threshold_met"
    assert payloads.read_payloads(df.where("1 = 0")).count() == 0
    bad = spark.createDataFrame([("sideways", 0.5, 1, 1, 2, True, 0.5)], "dominant_format string, confidence double, surname_first_count long, given_first_count long, total_count long, threshold_met boolean, decision_confidence double")
    with pytest.raises(Exception, match="no such format"):
        bad.select(payloads.strict(payloads.pattern_struct(), payloads.pattern_struct())).collect()


def test_poison_names_fail_alone(spark):
    poison = ["Aa" * 200_000, "(" * 50_000, "A.-" * 40_000, "\u0000", "李" * 30_000, "a-" * 60_000]
    rows = [(0, i, n) for i, n in enumerate([*poison, "Zhang Wei", None])]
    got = {r["pos"]: r for r in plans.normalize_names(spark.createDataFrame(rows, "batch_id long, pos int, name string")).collect()}
    assert len(got) == len(rows)
    assert [got[i]["success"] for i in range(len(rows))] == [False] * 6 + [True, False]
    assert {got[i]["error"] for i in (0, 1, 2, 4, 5, 7)} == {"invalid input length"}


def test_fallback(spark):
    names = spark.createDataFrame([(1, 0, "Zhang Wei"), (1, 1, "John Smith"), (2, 0, "Li Ming")], "batch_id long, pos int, name string")
    results, patterns = payloads.fallback(names)
    assert {r["batch_id"]: (r["dominant_format"], r["total_count"], r["threshold_met"]) for r in patterns.collect()} == {1: ("mixed", 2, False), 2: ("mixed", 1, False)}
    assert {r["result"] for r in results.collect()} == {"Wei Zhang", "", "Ming Li"}
    assert len(payloads.batch_payloads(results, patterns).collect()) == 2
    some = results.where("batch_id = 2")
    rows = {(r["batch_id"], r["pos"]): r for r in payloads.with_failures(names, some).collect()}
    assert len(rows) == 3 and rows[1, 1]["error"] == payloads.UNAVAILABLE and not rows[1, 0]["success"] and rows[2, 0]["success"]


def test_bad_cells_fail_alone(spark):
    rows = [("yes", "1.5", "first", None, 3), ("maybe", "1", "first", "", 1), ("no", None, "last", "x", 2), ("1.0", "2", None, "x", 2), ("0", "-inf", "middle", "x", 2)]
    df = spark.createDataFrame(rows, "pp_success string, pp_batch_confidence string, selected_surname_position string, pp_result string, other int")
    good, bad = tables.isolated_routing(df)
    assert [tuple(r) for r in good.collect()] == [(True, 1.5, "first", "", 3)]
    assert sorted(r["error"] for r in bad.collect()) == ["pp_batch_confidence: -inf", "pp_batch_confidence: null", "pp_success: maybe", "selected_surname_position: null"]
    good, bad = tables.isolated_routing(df.where("1 = 0"))
    assert good.count() == bad.count() == 0
    good, bad = tables.isolated_routing(df.select("other"))
    assert good.count() == 5 and bad.count() == 0
