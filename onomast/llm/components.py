"""Connected components by alternating large-star and small-star rounds.

Each round joins edges with one minimum per vertex, so no vertex needs its
neighbours in one place: the minima are combined before the shuffle and the
edge side of the join is one that Spark may split where a hub is hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the edges (a, b): each vertex and the least vertex it reaches."""
    if not len(a):
        return a, b
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while (jump := new[new]).tobytes() != new.tobytes():
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(names))
    return names[keep], names[label[keep]]


def _contract(batches):
    """Replaces the edges of a partition by a spanning forest, a bounded number at a time."""
    held, rows = [], 0

    def out():
        t = pa.Table.from_batches(held)
        u, v = forest(t["u"].to_numpy(), t["v"].to_numpy())
        return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= 500_000:
            yield out()
            held, rows = [], 0
    if held:
        yield out()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (u, v), both long: returns (node, root), root being the least node
    that is reachable.  Nodes without edges have no row; an empty table of
    edges gives an empty result; loops and repeated edges change nothing."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    e = materialize(arrow_map(e, _contract, "u long, v long").distinct(), "cc")
    last = None
    for _ in range(max_rounds):
        # large-star: every larger neighbour of u moves to the least vertex near u.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).where("m < u")
        large = (
            e.select(F.col("v").alias("u"), F.col("u").alias("v"))
            .join(low, "u", "left")
            .select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v"))
            .distinct()
        )
        large = materialize(large, "cc")
        # small-star: the smaller neighbours of u, and u, move to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = materialize(small, "cc")
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last or not state[0]:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
    )
