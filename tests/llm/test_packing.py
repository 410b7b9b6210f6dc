import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from onomast.llm.packing import encode_pieces, pack, plan_packing


def check(counts, size):
    """Unrolls a plan: every item has one place, sequences are gapless and not too long."""
    plan = plan_packing(counts, size)
    seen, bins = defaultdict(list), defaultdict(list)
    for length, lo, hi, base, each, offset in plan.arrays().tolist():
        for r in range(lo, hi):
            seen[length].append(r)
            bins[base + (r - lo) // each].append((offset + (r - lo) % each * length, length))
    assert {s: sorted(r) for s, r in seen.items()} == {s: list(range(n)) for s, n in counts.items() if n}
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


@pytest.mark.parametrize("seed", range(12))
def test_plans_hold(seed):
    rng = random.Random(seed)
    size = rng.choice([10, 64, 500, 4096])
    counts = Counter(min(size, max(1, int(rng.choice([rng.random(), rng.random() ** 4, 1.0]) * size))) for _ in range(rng.choice([1, 5, 300, 5000])))
    check(counts, size)


def test_few_sequences():
    assert check({4: 30, 3: 30, 3 + 4: 10, 10: 7}, 10) <= 37 + 1  # the best is 37
    rng = np.random.default_rng(1)
    lengths = np.clip(rng.lognormal(6, 1, 30_000), 1, 4096).astype(int)
    n = check(Counter(lengths.tolist()), 4096)
    assert n <= 1.01 * -(-int(lengths.sum()) // 4096)
    assert check({}, 4096) == 0


def test_pieces_and_places(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    texts = [None, "", "a b c", "word " * 9000, "x" * 50_000] + ["the same text again"] * 40
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, length int").repartition(5)
    pieces = encode_pieces(docs, path)
    rows = pack(pieces).collect()
    made, bins = defaultdict(dict), defaultdict(list)
    for r in rows:
        made[r["doc_id"]][r["piece"]] = r
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        got = [made[i][k] for k in sorted(made[i])]
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in got]).tolist() == ids
        assert [r["start"] for r in got] == list(range(0, len(ids), 4096))
    for items in bins.values():
        ends = np.cumsum([n for _, n in sorted(items)])
        assert [o for o, _ in sorted(items)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert pack(pieces.where("1 = 0")).count() == 0
    assert pack(pieces.select("doc_id", "length", "_part", "_i", F.crc32("ids").alias("c"))).count() == len(rows)
