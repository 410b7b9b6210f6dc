import hashlib
import random

import numpy as np
import pytest

from onomast.llm import veccodes
from onomast.llm.veccodes import Tree, nearest, vector_codes


def test_tree_gives_what_every_part_alone_would():
    rng = np.random.default_rng(1)
    for n, d, span in [(1, 2, 5), (300, 3, 4), (700, 8, 4096), (50, 1, 2), (400, 2, 1)]:
        points = rng.integers(-span, span, (n, d)).astype(np.int64)
        for _ in range(5):
            book = points[rng.integers(0, n, 16)]  # with equal entries
            tree = Tree(points)
            sums, counts, given = tree.assign(book)
            want = nearest(points, book)
            got = np.full(n, -1)
            for parts, entry in given:
                assert (got[tree.order[parts]] == -1).all()
                got[tree.order[parts]] = entry
            assert (got == want).all()
            assert (counts == np.bincount(want, minlength=16)).all()
            assert all((sums[k] == points[want == k].sum(axis=0)).all() for k in range(16))


def test_subtrees_are_assigned_whole():
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (16, 8))
    points = (centres[rng.integers(0, 16, 4000)] + rng.integers(-50, 50, (4000, 8))).astype(np.int64)
    tree = Tree(points)
    looked, plain = [0], veccodes.nearest

    def counted(p, book):
        looked[0] += len(p)
        return plain(p, book)

    veccodes.nearest = counted
    try:
        tree.assign(centres.astype(np.int64))
    finally:
        veccodes.nearest = plain
    assert looked[0] < 400


def brute(rows):
    lim = 1 << 24
    ok = [(i, lab, np.clip(np.floor(4096 * np.array(v, np.float64)), -lim, lim).astype(np.int64)) for i, v, lab in rows if v and None not in v and np.isfinite(v).all() and len(v) % 8 == 0]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2].tolist()))
    if not ok:
        return []
    ok = [r for r in ok if len(r[2]) == len(ok[0][2])]
    x = np.stack([r[2] for r in ok])
    parts = np.split(x, 8, axis=1)
    books = [p[:16].copy() for p in parts]
    for p, b in zip(parts, books):
        for _ in range(6):
            near = nearest(p, b)
            for k in set(near.tolist()):
                own = p[near == k]
                b[k] = own.sum(axis=0) // len(own)
    near = np.stack([nearest(p, b) for p, b in zip(parts, books)], axis=1)
    error = sum(((p - b[near[:, i]]) ** 2).sum(axis=1) for i, (p, b) in enumerate(zip(parts, books)))
    total = {lab: int(sum(e for e, r in zip(error, ok) if r[1] == lab)) for lab in {r[1] for r in ok}}
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{c:02x}" for c in n), int(e), total[r[1]], digest) for r, n, e in zip(ok, near, error)), key=str)


@pytest.mark.parametrize("n,block", [(300, 10_000), (300, 17), (9, 10_000)])
def test_matches_brute_force(spark, monkeypatch, n, block):
    monkeypatch.setattr(veccodes, "BLOCK", block)
    rng, dice = np.random.default_rng(n), random.Random(n)
    base = rng.normal(size=(12, 16)).astype(np.float32)
    rows = [(i, (base[i % 12] + rng.normal(size=16).astype(np.float32) * (0.2 if i % 3 else 0)).astype(np.float32).tolist(), dice.choice([1, 2, None])) for i in range(n)]
    rows += [(900, None, 1), (901, [float("nan")] * 16, 1), (902, [None] * 16, 2), (903, [float("inf")] + [0.0] * 15, 2), (904, [0.0] * 16, None), (905, [], 1), (906, [1.0] * 7, 1), (907, [1.0] * 8, 1), (908, [3e38] * 16, 2)]
    rows += [rows[0], rows[0], rows[5], (None, rows[1][1], 2), (-7, rows[2][1], 1)]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "vec_id long, embedding array<float>, label int, code string, error int").repartition(4)
    got = sorted((tuple(r) for r in vector_codes(df).collect()), key=str)
    assert got == brute(rows)
    assert vector_codes(df.where("1 = 0")).count() == 0
    assert vector_codes(df.where("embedding is null")).count() == 0
