"""The model of names in Han characters: features, training, saving, and the names it rejects."""

import math

import pytest
from pyspark.sql import functions as F

from onomast.operators import japanese
from onomast.plans.names import normalize_names

# Names that must be rejected, and Chinese ones that must pass.
JAPANESE = "安倍晋三 小泉纯一郎 井普源 山展源 田相吉 田弘光 山一鼎 田一博 福田康夫 菅義偉 黒田東彦 松下幸之助 本田勝 渡邊愛子".split()
CHINESE = {"张三": "San Zhang", "王五": "Wu Wang", "赵六": "Liu Zhao", "周十": "Shi Zhou", "李明华": "Ming-Hua Li", "欧阳明": "Ming Ou Yang", "張偉": "Wei Zhang", "林林": "Lin Lin"}


def test_goldens(spark):
    rows = [(i, 0, n) for i, n in enumerate([*JAPANESE, "原田 泰夫", "山田-太郎", *CHINESE])]
    got = {r["name"]: r for r in normalize_names(spark.createDataFrame(rows, "batch_id long, pos int, name string")).collect()}
    assert {n for n in [*JAPANESE, "原田 泰夫", "山田-太郎"] if got[n]["success"]} == set()
    assert {n: got[n]["result"] for n in CHINESE} == CHINESE
    assert got["福田康夫"]["error"] == "Japanese name detected by ML classifier"


@pytest.fixture(scope="module")
def made(spark):
    names = japanese.labelled(spark.range(4000)).groupBy("name").agg(F.min("label").alias("label")).cache()
    train = names.where(F.crc32(F.col("name").cast("binary")) % 3 != 1)
    return names, train, japanese.train(train.where("label = 0"), train.where("label = 1"), regularisation=20.0)


def test_held_out_accuracy(made):
    names, _, model = made
    held = names.where(F.crc32(F.col("name").cast("binary")) % 3 == 1)
    p = {r[0]: r[1] for r in japanese.probabilities(model, held).collect()}
    rows = held.collect()
    assert sum((p[r["name"]] >= 0.5) == (r["label"] == 1) for r in rows) >= 0.98 * len(rows)
    # A few thousand names leave some rare surnames unseen.
    assert sum(r["label"] == 0 and p[r["name"]] >= 0.8 for r in rows) <= 0.02 * len(rows)


def test_probability_from_its_parts(made):
    """The probability again, from n-grams, document frequencies and weights, in plain Python."""
    names, train, model = made
    grams = lambda s: {" ".join(s[i : i + n]) for n in (1, 2, 3) for i in range(len(s) - n + 1)}
    docs = [grams(r["name"]) for r in train.collect()]
    counter, lr = model.stages[4], model.stages[-1]
    df = {t: sum(t in d for d in docs) for t in counter.vocabulary}
    assert min(df.values()) >= japanese.MIN_DF and max(df.values()) <= japanese.MAX_DF * len(docs)
    some = names.orderBy("name").limit(40)
    flags = {r["name"]: [r[c] for c in japanese.flags(F.lit(""))] for r in japanese.featured(some).collect()}
    got = {r[0]: r[1] for r in japanese.probabilities(model, some).collect()}
    weights = lr.coefficients.toArray()
    for name, own in flags.items():
        at = {i: math.log((1 + len(docs)) / (1 + df[t])) + 1 for i, t in enumerate(counter.vocabulary) if t in grams(name)}
        length = math.sqrt(sum(v * v for v in at.values())) or 1.0
        z = lr.intercept + sum(weights[i] * v / length for i, v in at.items()) + sum(w * f for w, f in zip(weights[len(counter.vocabulary) :], own))
        assert got[name] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_saved_and_loaded(spark, made, tmp_path):
    names, _, model = made
    path = f"file://{tmp_path}/model"
    japanese.save(model, path)
    a, b = (dict(map(tuple, japanese.probabilities(m, names).collect())) for m in (model, japanese.load(path)))
    assert a == b


def test_edges(spark, made):
    _, _, model = made
    odd = spark.createDataFrame([("",), (None,), ("龘龘",), ("abc",), ("王" * 500,)], "name string")
    got = japanese.probabilities(model, odd).collect()
    assert {r["name"] for r in got} == {"", "龘龘", "abc", "王" * 500} and all(0 <= r["probability"] <= 1 for r in got)
    one = spark.createDataFrame([("王明",)], "name string")
    with pytest.raises(ValueError, match="both kinds"):
        japanese.train(one, one.where("1 = 0"))
    with pytest.raises(ValueError, match="both kinds"):
        japanese.train(one, spark.createDataFrame([(None,), ("",)], "name string"))


def test_model_folder(spark, tmp_path, monkeypatch):
    """The model is fitted once, saved where the setting says, and loaded from there."""
    path = f"file://{tmp_path}/builtin"
    monkeypatch.setattr(japanese, "BUILTIN_ROWS", 2000)
    monkeypatch.setattr(japanese, "_MODEL", {})
    spark.conf.set(japanese.MODEL_KEY, path)
    try:
        japanese.builtin_model(spark)
        assert (tmp_path / "builtin").exists()
        japanese._MODEL.clear()
        monkeypatch.setattr(japanese, "train", None)
        some = spark.createDataFrame([("山田太郎",)], "name string")
        assert japanese.probabilities(japanese.builtin_model(spark), some).first()["probability"] > 0.8
    finally:
        spark.conf.unset(japanese.MODEL_KEY)
