"""Quality, toxicity and language: held-out accuracy on made texts, and hard inputs."""

import random

import numpy as np

from onomast.llm import langid, quality, toxicity

RNG = random.Random(4)
SYLLABLES = ["the", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]
OTHER = ["der", "ch", "ung", "ge", "ei", "sch", "ü", "ver", "be", "keit"]


def prose(parts, n=80, rng=RNG):
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def junk(i):
    if i % 2:
        return " | ".join(prose(SYLLABLES, 1) for _ in range(60))
    return "\n".join(" ".join([prose(SYLLABLES, 1)] * 30) for _ in range(3))


HARD = [None, "", " ", "\x00", "𝒳 🙂", "x" * 200_000, "a | b"]


def tables(spark, rows, column):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, (t, _) in enumerate(rows)], f"doc_id long, text string, {column} string, label int")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows) if y is not None] + [(None, 1), (0, rows[0][1])], f"doc_id long, {column} int")
    return docs, labels


def test_quality(spark):
    rows = [(junk(i), 0) if i % 4 == 0 else (prose(SYLLABLES), 1) for i in range(400)] + [(t, None) for t in HARD * 2]
    docs, labels = tables(spark, rows, "quality")
    model = quality.train_quality(docs, labels)
    got = {r["doc_id"]: r["quality_score"] for r in quality.score_quality(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, (_, y) in enumerate(rows) if y is not None]) > 0.98
    assert got[400] == got[401] == got[407]
    assert quality.score_quality(docs.where("1 = 0"), model).count() == 0
    one = quality.train_quality(docs, labels.where("quality = 1"))
    assert all(0.5 < r["quality_score"] <= 1 for r in quality.score_quality(docs, one).collect())


def test_dual_descent_reaches_the_primal_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    y = np.where(x[:, 0] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    w = quality.dual_descent([(np.arange(5), r) for r in x], y, 5, 1.0, rounds=500)
    cost = lambda v: v @ v / 2 + np.maximum(0, 1 - y * (x @ v)).sum()
    assert all(cost(w) <= cost(w + 0.05 * d) + 1e-2 for d in rng.normal(size=(200, 5)))


def test_toxicity(spark):
    def bad():
        w = prose(SYLLABLES).split()
        for k in range(5):
            w.insert(RNG.randrange(len(w)), "you idiot" if k % 2 else RNG.choice(["moron", "zzugu", "zzuga"]))
        return " ".join(w)

    rows = [(bad(), 1) if i % 5 == 0 else (prose(SYLLABLES), 0) for i in range(400)] + [(t, None) for t in HARD * 2]
    docs, labels = tables(spark, rows, "toxic")
    model = toxicity.train_toxicity(docs, labels)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.3) == bool(y) for i, (_, y) in enumerate(rows) if y is not None]) > 0.97
    assert toxicity.score_toxicity(docs.where("1 = 0"), model).count() == 0


def test_isotonic_levels_ascend_and_keep_the_mean():
    rng = np.random.default_rng(3)
    s = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * s))).astype(float)
    at, level = toxicity.isotonic(s, y, np.ones(500))
    assert (np.diff(level) >= 0).all() and (np.diff(at) > 0).all()


def test_langid(spark):
    rows = [(prose(SYLLABLES, 40), "aa") if i % 2 else (prose(OTHER, 40), "bb") for i in range(300)]
    docs = spark.createDataFrame([(i, t, g, "c") for i, (t, g) in enumerate(rows)] + [(1000 + i, t, None, "c") for i, t in enumerate(HARD)], "doc_id long, text string, lang string, lang_pred string")
    model = langid.train_langid(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in langid.identify(docs, model).collect()}
    assert np.mean([got[i][0] == g for i, (_, g) in enumerate(rows)]) > 0.99
    assert [got[1000 + i][0] for i in range(4)] == ["und"] * 4
    assert all(0 <= s <= 1 for _, s in got.values())
    assert langid.identify(docs.where("1 = 0"), model).count() == 0
    assert langid.train_langid(docs.where("1 = 0")).predict("abc") == ("und", 0.0)


def test_ppm_codes_are_proper_and_exclude():
    """In every context the code lengths are those of a distribution; longer texts than a block add up."""
    m = langid.learn({"x": ["abracadabra " * 30], "y": ["the cat sat on the mat " * 30]})
    p = np.exp2(-m.costs.reshape(-1, m.size, 2).astype(float)).sum(axis=1)
    assert np.allclose(p, 1, atol=1e-3)
    t = "the cat " * 60_000
    assert abs(m.lengths(t)[1] - (m.lengths(t + t)[1] - m.lengths(t)[1])) < 0.01 * m.lengths(t)[1]
