import random
import re

import pytest

from onomast.llm import substrings
from onomast.llm.substrings import factors, gram_of, remove_substrings, segments

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    oldest = {}
    split = [(d, WORD.findall(t or "")) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - size + 1):
                key = tuple(w[i : i + size])
                oldest[key] = min(oldest.get(key, d), d)
    out = []
    for d, w in split:
        gone = set()
        if d is not None:
            for i in range(len(w) - size + 1):
                if oldest[tuple(w[i : i + size])] < d:
                    gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=str)


def made(rng, size):
    word = lambda: rng.choice("abcdefghij") + rng.choice(["", "é", "0", "B"])
    prose = lambda n: [word() for _ in range(n)]
    passage, base = prose(2 * size), prose(6 * size)
    texts = [base, list(base), [*base[:size], "X", *base[size:]]]
    for _ in range(40):
        a = rng.randint(0, size)
        texts.append(prose(rng.randint(0, 2 * size)) + passage[a : a + size + rng.randint(-1, size)] + prose(rng.randint(0, size)))
    texts += [prose(3) * size, prose(3) * size, base[: size - 1], base[:size], base[size:] + base]
    rng.shuffle(texts)
    rows = [(i * 2, rng.choice([" ", "\n", "  \t"]).join(t)) for i, t in enumerate(texts)]
    rows += [rows[4], rows[5], (rows[6][0], " ".join(passage)), (None, " ".join(base)), (None, None), (400, None), (401, ""), (402, " \n"), (-3, " ".join(passage[1:]))]
    return rows


@pytest.mark.parametrize("size,split", [(12, 256), (12, 1), (50, 3), (1, 2), (2, 256)])
def test_matches_brute_force(spark, monkeypatch, size, split):
    monkeypatch.setattr(substrings, "SPLIT", split)
    rows = made(random.Random(size + split), size)
    df = spark.createDataFrame([(*r, "clash", 1, [1]) for r in rows], "doc_id long, text string, kept string, h int, wanted array<int>").repartition(6)
    out = remove_substrings(df, size)
    assert out.columns == ["doc_id", "h", "wanted", "n_words", "n_removed", "kept", "removed"]
    got = out.collect()
    want = brute(rows, size)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got), key=str) == want
    assert sum(w[2] for w in want) > 0
    assert all(sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"] for r in got)


def test_very_long_text(spark):
    rng = random.Random(5)
    long = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(200_000))
    rows = [(1, long), (2, "new " + long[len(long) // 2 :]), (3, long)]
    out = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in remove_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == (200_000, 0, long) and out[3] == (200_000, 200_000, "")
    assert out[2][0] - out[2][1] in (1, 2) and out[2][2].startswith("new")


def test_empty_table(spark):
    assert remove_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_windows_share_anchor_and_place():
    rng = random.Random(9)
    for size in (1, 2, 5, 20, 50):
        assert gram_of(size) <= max(1, size // 3)
        words = [str(rng.randint(0, 3)).encode() for _ in range(300)]
        seen = {}
        for anchor, _, lo, n in zip(*segments(words, size)):
            for i in range(lo, lo + n):
                assert seen.setdefault(tuple(words[i : i + size]), anchor) == anchor
        assert sum(segments(words, size)[3]) == 300 - size + 1


def test_factors_reach_over_their_ends():
    a, b = "a b c d e f".split(), "x c d e f g h".split()
    # "b c d e" ends in the first content; "c d e f g" goes on from within it in the second.
    spans = factors([(1, a), (2, b), (3, "a b c d e f g h z".split())], 3)
    assert spans[0] == [] and spans[1] == [(1, 5)]
    assert spans[2] == [(0, 6), (4, 8)] or {i for s in spans[2] for i in range(*s)} == set(range(8))
    assert factors([(1, a), (1, a)], 3) == [[], []]
