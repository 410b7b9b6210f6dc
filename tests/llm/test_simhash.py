import random

import numpy as np
import xxhash

from onomast.llm.components import connected_components
from onomast.llm.simhash import block_keys, fingerprint, fingerprint_links, simhash_components, trie_pairs


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprint():
    for t in [None, "", " \t\n", "one", "One two THREE", "a b c d", "É a b C d e f g " * 9, "x y " * 70_000, "a\x1fb c\x85d e f g"]:
        assert fingerprint(t) == brute_fingerprint(t)


def test_trie_pairs_match_brute_force():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    bits = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(30)})
    arr = np.array(bits, dtype=np.uint64)
    got = {(int(i), int(j)) for a, b in trie_pairs(arr, np.full(len(arr), 2), np.array([0, len(arr)]), 4) for i, j in zip(a, b)}
    assert got == {(i, j) for i in range(len(bits)) for j in range(i + 1, len(bits)) if bin(bits[i] ^ bits[j]).count("1") <= 4}


def test_links_join_all_within_budget_also_in_hot_buckets(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    vals = {base ^ sum(1 << k for k in rng.sample(range(20), rng.randint(0, 9))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(200)}
    vals = sorted(v - (1 << 64) if v >= 1 << 63 else v for v in vals)
    df = spark.createDataFrame([(v,) for v in vals], "fp long")
    roots = {r["node"]: r["root"] for r in connected_components(fingerprint_links(df, 4, chunk=32)).collect()}
    unsigned = [v & ((1 << 64) - 1) for v in vals]
    want = brute_components(unsigned)
    got = [roots.get(v, v) for v in vals]
    assert [got.index(g) for g in got] == want


def test_near_fingerprints_share_a_choice_of_blocks():
    rng = random.Random(3)
    for count, least in ((1000, 12), (10**8, 21), (10**10, 26), (10**12, 32)):
        keys = block_keys(count, 4, 1024)
        assert min(sum(w for _, w in pick) for pick in keys) >= least - 3
        assert len({len(pick) for pick in keys}) == 1 and {b for pick in keys for low, w in pick for b in range(low, low + w)} == set(range(64))
        for _ in range(300):
            apart = sum(1 << k for k in rng.sample(range(64), 4))
            assert any(all(apart >> low & ((1 << w) - 1) == 0 for low, w in pick) for pick in keys)


def test_links_by_several_blocks(spark, monkeypatch):
    from onomast.llm import simhash

    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    vals = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(12)})
    monkeypatch.setattr(simhash, "block_keys", lambda count, budget, chunk: block_keys(10**8, budget, chunk))
    df = spark.createDataFrame([(v - (1 << 64) if v >= 1 << 63 else v,) for v in vals], "fp long")
    roots = {r["node"] & ((1 << 64) - 1): r["root"] for r in connected_components(fingerprint_links(df, 4)).collect()}
    got = [roots.get(v, -v) for v in vals]
    assert [got.index(g) for g in got] == brute_components(vals)


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and all(got[i] == 100 for i in range(100, 140))
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_documents(spark):
    long = "the quick brown fox jumps over the lazy dog and runs far away from here to there " * 30
    texts = [None, "", long, long + "end", long.upper(), "other words entirely in this text here", None, long]
    rows = [(i + 10, t, 1, "x") for i, t in enumerate(texts)] + [(10, None, 1, "x")]
    out = simhash_components(spark.createDataFrame(rows, "doc_id long, text string, fp int, component_id string")).collect()
    assert len(out) == len(rows)
    prints = [brute_fingerprint(t) for t in texts]
    want = brute_components(prints)
    for r in out:
        i = r["doc_id"] - 10
        assert r["fp"] & ((1 << 64) - 1) == prints[i]
        assert r["component_id"] == want[i] + 10
    assert simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
