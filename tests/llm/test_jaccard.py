import random

import numpy as np
import pytest

import corpus_pipeline
from onomast.llm import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(texts, least=0.8):
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both >= least * either - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def planted():
    """Groups of copies with 0 to 6 words changed, chains, a common passage, and texts of few words."""
    rng = random.Random(4)
    word = lambda: "w" + str(rng.randrange(10**6))
    passage = [word() for _ in range(30)]
    texts = [None, "", " ", "one", "ONE", "a b c d", "a b c d e"]
    for k in range(60):
        base = [word() for _ in range(rng.choice((20, 60, 100, 200)))] + passage * (k % 2)
        texts.append(" ".join(base))
        for _ in range(5):
            copy = base if rng.random() < 0.5 else texts[-1].split()
            copy = list(copy)
            for at in rng.sample(range(len(copy)), rng.randint(0, 6) if len(copy) > 50 else rng.randint(0, 1)):
                copy[at] = word()
            texts.append(" ".join(copy))
    hot = [word() for _ in range(150)]
    texts += [" ".join(hot[:k] + [word()] + hot[k + 1 :]) for k in range(0, 150, 2)]
    texts += [" ".join(passage + [word() for _ in range(rng.randint(3, 12))]) for _ in range(60)]
    # A chain whose ends share little.
    chain = [word() for _ in range(300)]
    return texts + [" ".join(chain[k : k + 100]) for k in range(0, 200, 10)]


def stage(spark, rows):
    return corpus_pipeline.simhash(spark, spark.createDataFrame(rows, SCHEMA), "").collect()


def test_near_copies_from_080_on_go_and_chains_are_followed(spark):
    texts = planted()
    want = components(texts)
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    assert {r["doc_id"] for r in stage(spark, rows)} == set(want)


def test_groups_match_brute_force_with_common_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COUNTERS", 1 << 14)
    monkeypatch.setattr(jaccard, "PAIRS", 40)
    texts = planted()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert len(jaccard.common_shingles(docs, 5)[0])
    got = {r["doc_id"]: r["component"] for r in jaccard.near_components(docs).collect()}
    first = {}
    for i in range(len(texts)):
        first.setdefault(got[i], i)
    assert [first[got[i]] for i in range(len(texts))] == components(texts)


@pytest.mark.parametrize("words, changed", [(46, 1), (100, 1), (100, 2), (300, 6)])
def test_pairs_of_080_to_095(spark, words, changed):
    base = [f"v{i}" for i in range(words)]
    copy = [f"x{i}" if i % (words // changed) == words // changed // 2 else w for i, w in enumerate(base)]
    a, b = shingle_set(" ".join(base)), shingle_set(" ".join(copy))
    assert 0.78 < len(a & b) / len(a | b) < 0.96
    rows = [(1, " ".join(base), "en", "s", 0), (2, " ".join(copy), "en", "s", 0)]
    want = 1 if len(a & b) >= 0.8 * len(a | b) else 2
    assert len(stage(spark, rows)) == want
    assert stage(spark, []) == []


def test_repeated_lines_do_not_part_similar_texts(spark):
    rows = []
    for k in range(4):
        x, y = (" ".join(f"{c}{k}w{i}" for i in range(30)) for c in "xy")
        rows += [(2 * k, " ".join([x] * 40 + [y]), "en", "s", 0), (2 * k + 1, " ".join([x] + [y] * 40), "en", "s", 0)]
    assert components([r[1] for r in rows]) == [0, 0, 2, 2, 4, 4, 6, 6]
    assert {r["doc_id"] for r in stage(spark, rows)} == {0, 2, 4, 6}


def test_sketches_part_unlike_sets_and_no_similar_ones():
    rng = np.random.default_rng(3)
    passed = 0
    for k in range(2000):
        n = int(rng.integers(1, 1200))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        lost = int(rng.integers(0, n // 4 + 1))
        b = np.unique(np.concatenate([a[lost:], rng.integers(0, 2**63, int(rng.integers(0, n // 4 + 1))).astype(np.uint64)]))
        fits = jaccard.may_be_similar(jaccard.sketch(a), len(a), jaccard.sketch(b), len(b), 0.8)
        assert fits or not jaccard.similar(a, b, 0.8)
        c = np.unique(rng.integers(0, 2**63, max(n, 200)).astype(np.uint64))
        d = np.unique(rng.integers(0, 2**63, max(n, 200)).astype(np.uint64))
        passed += jaccard.may_be_similar(jaccard.sketch(c), len(c), jaccard.sketch(d), len(d), 0.8)
    assert passed < 20


def test_texts_of_unlike_pairs_are_not_sent(spark, monkeypatch):
    """Unlike texts that share a rare line were all read, written and sent as text before."""
    rng, sent = random.Random(8), []
    word = lambda: "w" + str(rng.randrange(10**6))
    lines = [" ".join(word() for _ in range(20)) for _ in range(10)]
    texts = [" ".join([lines[k % 10]] + [word() for _ in range(60)]) for k in range(120)]
    texts += [t + " more" for t in texts[:3]]
    compared = jaccard._compared

    def spy(pairs, known, *rest):
        sent.append((known.columns, pairs.count()))
        return compared(pairs, known, *rest)

    monkeypatch.setattr(jaccard, "_compared", spy)
    monkeypatch.setattr(jaccard, "BITS", 64)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component"] for r in jaccard.near_components(docs).collect()}
    assert all(got[i] == got[120 + i] for i in range(3)) and len(set(got.values())) == 120
    pairs = {kind: sum(n for columns, n in sent if kind in columns) for kind in ("sketch", "text")}
    assert pairs["sketch"] > 60 and pairs["text"] <= 6
