"""The pipeline and registered queries on small tables, stage by stage against brute force."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from onomast.llm.queries import QUERIES

RNG = random.Random(9)
PARTS = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "st"]
PASSAGE = " ".join(f"bench{i}" for i in range(14))


def prose(n=60):
    return " ".join("".join(RNG.choice(PARTS) for _ in range(RNG.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    texts = [prose() for _ in range(120)] + [" | ".join(prose(1) for _ in range(80)) for _ in range(40)]
    texts += [texts[3], texts[3], prose(30) + " " + PASSAGE, prose(30) + " password=abcdefgh12", None, "", prose(9000)]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int(i < 120), 0) for i in range(160) if i % 4], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top), texts


def test_stages(spark, folder):
    top, texts = folder
    docs, seen = spark.read.parquet(f"{top}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{top}/{name}"
        stage(spark, docs, top).write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        seen[name] = {r["doc_id"]: r for r in docs.collect()} if name != "packing" else docs.collect()
    assert not set(range(120, 160)) & set(seen["quality"]) and set(range(120)) <= set(seen["quality"])
    assert {160, 161} & set(seen["simhash"]) == set() and 3 in seen["simhash"]
    assert set(range(120)) <= set(seen["simhash"])
    assert set(seen["simhash"]) - set(seen["decontamination"]) == {162}
    assert seen["secrets"][163]["text"] == texts[163].replace("password=abcdefgh12", "[secret]")
    assert {i: r["text"] for i, r in seen["secrets"].items() if i != 163} == {i: r["text"] for i, r in seen["decontamination"].items() if i != 163}
    bins = defaultdict(list)
    for r in seen["packing"]:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {r["doc_id"] for r in seen["packing"]} == set(seen["secrets"])
    for items in bins.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= 4096


def test_run_and_entry(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).count() > 0
    assert {int(q[2:].split("_")[0]) for q in QUERIES} == set(range(1, 11))
