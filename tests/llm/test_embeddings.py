import numpy as np

from onomast.llm import embeddings
from onomast.llm.embeddings import near_embeddings, quantise, tile_links


def test_bounds_hold_and_links_are_exact():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    v = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0, 0.05, 0.1, 0.2)])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    q, s, e = quantise(unit)
    exact = unit @ unit.T
    approx = (q.astype(float) @ q.astype(float).T) * s[:, None] * s[None, :]
    assert (np.abs(exact - approx) <= (1 + e)[:, None] * e + e[:, None] * (1 + e) + 1e-9).all()
    for least in (0.5, 0.9, 0.98):
        i, j = tile_links(v, v, least, True)
        assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if exact[a, b] >= least}


def brute(rows, least):
    ok = [i for i, r in enumerate(rows) if r[1] is not None and r[2] is not None and len(r[1]) and None not in r[1] and np.isfinite(np.array(r[1], float)).all() and np.any(r[1])]
    links, lab = {i: 0 for i in range(len(rows))}, [r[0] for r in rows]
    edges = []
    for a in ok:
        for b in ok:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                    links[a] += 1
                    links[b] += 1
                    edges.append((a, b))
    for _ in rows:
        for a, b in edges:
            lab[a] = lab[b] = min(lab[a], lab[b])
    return sorted((r[0], links[i], lab[i], lab[i] == r[0]) for i, r in enumerate(rows))


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    monkeypatch.setattr(embeddings, "GROUP", 2)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(25, 8))
    rows = []
    for k in range(150):
        rows.append((k, (base[k % 25] + rng.normal(size=8) * (0.0 if k % 3 == 0 else 0.08)).astype(np.float32).tolist(), k % 2))
    rows += [(200, None, 1), (201, [0.0] * 8, 1), (202, [1.0, None] + [0.0] * 6, 0), (203, [float("nan")] * 8, 0), (204, [float("inf")] * 8, 0), (205, [1.0] * 8, None), (206, [], 1), (207, [1.0, 2.0], 0), (208, [2.0, 4.0], 0)]
    rows += [rows[0]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, rep string")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in near_embeddings(df).collect())
    assert got == brute(rows, 0.98)
    assert near_embeddings(df.where("1 = 0")).count() == 0
