import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from onomast.llm import lexical
from onomast.llm.lexical import best, build_index, search, terms_of

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return TERM.findall((text or "").translate(SMALL))


def brute(docs, items, k):
    found = [(d, Counter(w), len(w)) for d, t in docs if (w := words(t))]
    n, total = len(found), sum(f[2] for f in found)
    df = Counter(t for _, c, _ in found for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        scored = []
        for d, tf, length in found:
            m = 75 + 25 * length * n // total
            scored.append((sum(weight[t] * (1000000000 * tf[t] // (1000 * tf[t] + 12 * m)) for t in words(text) if t in tf), d))
        scored = sorted((-s, d is None, d or 0) for s, d in scored if s > 0)[:k]
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(scored)]
    return sorted(out, key=str)


def test_terms_match_the_pattern():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("aZ09 _-é数ÀK\x00\n\x7f[`{🙂İ") for _ in range(rng.randint(0, 30)))
        assert [t.decode() for t in terms_of(text.encode())] == words(text)
    assert terms_of(None) == []


def test_best_is_safe_on_ties():
    rng = np.random.default_rng(2)
    for _ in range(200):
        scores, ids = rng.integers(0, 4, 40), rng.permutation(40)
        k = int(rng.integers(1, 12))
        want = sorted(((-s, i) for s, i in zip(scores, ids) if s > 0))[:k]
        at = best(scores, ids, k)
        assert sorted((-scores[a], ids[a]) for a in at) == want


@pytest.mark.parametrize("bounds", [(1 << 18, 1 << 14, 4 << 20), (40, 3, 30)])
def test_search_matches_brute_force(spark, monkeypatch, bounds):
    for name, value in zip(("POSTINGS", "DOCS", "BLOCK_BYTES"), bounds):
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(25)] + ["Été", "数据", "A1"]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 30)))) for i in range(120)]
    docs += [(500 + i, docs[0][1]) for i in range(40)] + [docs[3]] * 3
    docs += [(900, None), (901, ""), (902, " ,;!"), (None, docs[5][1]), (None, docs[5][1]), (903, "w1 " * 20_000)]
    items = [(1, "w1 w2 W2, w3 été"), (2, docs[0][1]), (3, None), (4, ""), (5, "unseen"), (None, "a1 数据"), (2, "w9 w9 unseen"), (7, docs[5][1])]
    d = spark.createDataFrame([(*x, "clash", 1) for x in docs], "doc_id long, text string, score string, rank int").repartition(5)
    i = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    index = build_index(d)
    got = [tuple(r) for r in search(index, i, k=20).select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(got, key=str) == brute(docs, items, 20)
    assert search(build_index(d.where("1 = 0")), i).count() == 0
    assert search(index, i.where("1 = 0")).count() == 0


def test_shards_are_handed_over_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BATCH_BYTES", 100, raising=False)
    docs = spark.range(60).selectExpr("id AS doc_id", "array_join(transform(sequence(0, 19999), x -> 'w' || x), ' ') AS text").coalesce(1)
    index, found, key = build_index(docs), [], "spark.sql.execution.arrow.maxBytesPerBatch"
    assert index.shards.count() == 5 and index.shards.rdd.getNumPartitions() == 1
    # A byte a posting for the document, and one for the count; scores are made of them, nothing else is written.
    assert index.shards.where("length(docs) > 280000 or length(tfs) > 280000").count() == 0 and "impacts" not in index.shards.columns

    def sizes(_wanted):
        def run(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.record_batch([pa.array([b"rows %d" % b.num_rows], pa.binary()), pa.array([1], pa.int64())], names=["term", "df"])

        return run

    search_in, before = lexical._search, spark.conf.get(key)
    monkeypatch.setattr(lexical, "_frequencies", sizes)
    monkeypatch.setattr(lexical, "_search", lambda queries, weights, *rest: found.extend(weights) or search_in(queries, weights, *rest))
    assert search(index, spark.createDataFrame([(1, "w1")], "item_id long, text string")).count() == 0
    assert found == [b"rows 1"] and spark.conf.get(key) == before
