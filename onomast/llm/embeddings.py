"""Near-duplicate embeddings by tiles of int8 products with error bounds.

Equal vectors of a label are one class.  Classes are ordered by a code of
signs over fixed random directions and cut into blocks; two blocks of a label
meet only if their balls on the unit sphere come near enough.  Where they
meet, vectors quantised to int8 are multiplied, exactly, as integers.  Each
vector carries the exact length of its quantisation error, so a pair's product
is off by no more than |x'| e_y + |y'| e_x + e_x e_y; only pairs that may still
reach the threshold are computed again in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, materialize
from .components import connected_components, forest

BLOCK = 1024
CODE_BITS = 12
#: About so many blocks of a label on either side of a key under which they meet.
GROUP = 256


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of length 1 as int8, their scales, and the lengths of their errors."""
    scale = np.abs(unit).max(axis=1) / 127
    scale[scale == 0] = 1.0
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - q * scale[:, None]) ** 2).sum(axis=1)) + 1e-12
    return q, scale, error


def tile_links(a: np.ndarray, b: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of a and j of b with cosine >= least; i < j where a and b are the same."""
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    (qa, sa, ea), (qb, sb, eb) = quantise(a / na[:, None]), quantise(b / nb[:, None])
    wide = np.float32 if a.shape[1] * 127 * 127 < 1 << 24 else np.float64  # in which integers this large are exact
    product = (qa.astype(wide) @ qb.astype(wide).T).astype(np.float64) * sa[:, None] * sb[None, :]
    bound = (1 + ea)[:, None] * eb[None, :] + ea[:, None] * (1 + eb)[None, :] + (ea[:, None] * eb[None, :]) + 1e-9
    i, j = np.nonzero(product + bound >= least)
    if same:
        i, j = i[i < j], j[i < j]
    keep = []
    for at in range(0, len(i), 65_536):
        x, y = i[at : at + 65_536], j[at : at + 65_536]
        keep.append(np.einsum("ij,ij->i", a[x], b[y]) / (na[x] * nb[y]) >= least)
    near = np.concatenate(keep) if keep else np.zeros(0, bool)
    return i[near], j[near]


def _blocks(double: bool):
    kind = "<f8" if double else "<f4"

    def run(batches):
        held: list[tuple] = []
        group, made, part = None, 0, TaskContext.get().partitionId()

        def out():
            nonlocal made
            made += 1
            v = np.stack([h[2] for h in held]).astype(np.float64)
            unit = v / np.sqrt((v * v).sum(axis=1))[:, None]
            centre = unit.mean(axis=0)
            radius = float(np.sqrt(((unit - centre) ** 2).sum(axis=1)).max())
            row = {
                "label": [group[0]],
                "dim": [group[1]],
                "block": [part * (1 << 32) + made],
                "centre": [centre.tolist()],
                "radius": [radius],
                "ids": [np.array([h[0] for h in held], "<i8").tobytes()],
                "sizes": [np.array([h[1] for h in held], "<i8").tobytes()],
                "vecs": [np.stack([h[2] for h in held]).astype(kind).tobytes()],
            }
            return pa.RecordBatch.from_pydict(row, schema=schema)

        schema = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("block", pa.int64()), ("centre", pa.list_(pa.float64())), ("radius", pa.float64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("vecs", pa.binary())])
        for batch in batches:
            cols = [batch.column(i) for i in range(4)]
            flat = batch.column(4).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(cols[1].to_numpy())
            for i, (label, dim, rep, n) in enumerate(zip(*(c.to_pylist() for c in cols))):
                if held and (group != (label, dim) or len(held) == BLOCK):
                    yield out()
                    held = []
                group = (label, dim)
                held.append((rep, n, flat[ends[i] - dim : ends[i]].copy()))
        if held:
            yield out()

    return run


def _products(least: float, double: bool):
    kind = "<f8" if double else "<f4"

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                same = r["a_block"] == r["b_block"]
                ia, ib = np.frombuffer(r["a_ids"], "<i8"), np.frombuffer(r["b_ids"], "<i8")
                na, nb = np.frombuffer(r["a_sizes"], "<i8"), np.frombuffer(r["b_sizes"], "<i8")
                a = np.frombuffer(r["a_vecs"], kind).reshape(-1, r["dim"]).astype(np.float64)
                b = np.frombuffer(r["b_vecs"], kind).reshape(-1, r["dim"]).astype(np.float64)
                i, j = tile_links(a, b, least, same)
                if not len(i):
                    continue
                ca, cb = np.bincount(i, nb[j], len(ia)).astype(np.int64), np.bincount(j, na[i], len(ib)).astype(np.int64)
                u, v = forest(ia[i], ib[j])
                ids = np.concatenate([ia[ca > 0], ib[cb > 0], u])
                vals = np.concatenate([ca[ca > 0], cb[cb > 0], v])
                edge = np.arange(len(ids)) >= len(ids) - len(u)
                yield pa.record_batch([pa.array(ids), pa.array(vals), pa.array(edge)], names=["u", "v", "edge"])

    return run


def near_embeddings(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Linked are rows of one label, not null, whose cosine is ``least`` or more.
    A vector that is null, empty, zero, or holds a null or a number that isn't
    finite, links with nothing, nor do vectors of different lengths: it is its
    own component.  Copies link with each other; they are compared as one.
    Repeated rows are copies; different vectors of one vec_id share its links
    and component.  An empty table gives an empty result; other columns aren't read.
    """
    double = isinstance(vectors.schema["embedding"].dataType.elementType, T.DoubleType)
    label = F.col("label").cast("string")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", label.alias("label"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.col("embedding").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~bad & F.exists("embedding", lambda x: x != 0)
    v = v.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("h", F.xxhash64("embedding"))
    good = v.where("ok")
    rng = np.random.default_rng(7)
    classes = good.groupBy("label", "h", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    # A code of signs along coordinates' random sums keeps near vectors in near places.
    signs = F.lit(0).cast("long")
    for k in range(CODE_BITS):
        pattern = int(rng.integers(1, 1 << 62))
        side = F.aggregate(
            F.col("embedding"),
            F.struct(F.lit(0.0).alias("s"), F.lit(pattern).cast("long").alias("p")),
            lambda a, x: F.struct(
                (a["s"] + F.when(a["p"].bitwiseAND(F.lit(1)) == 1, x.cast("double")).otherwise(-x.cast("double"))).alias("s"),
                F.when(a["p"] > 1, F.shiftright(a["p"], 1)).otherwise(F.lit(pattern).cast("long")).alias("p"),
            ),
            lambda a: a["s"],
        )
        signs = signs + F.when(side >= 0, F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
    classes = materialize(classes.withColumn("code", signs).withColumn("dim", F.size("embedding")), "classes")
    ordered = classes.repartitionByRange("label", "dim", "code", "rep").sortWithinPartitions("label", "dim", "code", "rep").select("label", "dim", "rep", "n", "embedding")
    schema = "label string, dim int, block long, centre array<double>, radius double, ids binary, sizes binary, vecs binary"
    blocks = materialize(arrow_map(ordered, _blocks(double), schema), "blocks")
    meta = ["label", "dim", "block", "centre", "radius"]
    a = blocks.select(*[F.col(c).alias(c if c in ("label", "dim") else f"a_{c}") for c in meta])
    b = blocks.select(*[F.col(c).alias(c if c in ("label", "dim") else f"b_{c}") for c in meta])
    apart = F.sqrt(F.aggregate(F.zip_with("a_centre", "b_centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    reach = math.sqrt(max(0.0, 2 - 2 * least)) + 1e-6
    # A label's blocks are dealt to groups, and each two groups meet under a key of their own.
    sizes = blocks.groupBy("label", "dim").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("k"))
    every = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    group = lambda c: F.pmod(F.xxhash64(c), F.col("k")).cast("int")
    a = a.join(sizes, ["label", "dim"]).select("*", group("a_block").alias("ga"), every.alias("gb")).drop("k")
    b = b.join(sizes, ["label", "dim"]).select("*", group("b_block").alias("gb"), every.alias("ga")).drop("k")
    pairs = a.join(b, ["label", "dim", "ga", "gb"]).where("a_block <= b_block").where(apart <= F.col("a_radius") + F.col("b_radius") + reach)
    pairs = materialize(pairs.select("label", "dim", "a_block", "b_block"), "block-pairs")
    body = ["ids", "sizes", "vecs"]
    full = pairs
    for side in ("a", "b"):
        own = blocks.select("label", "dim", F.col("block").alias(f"{side}_block"), *[F.col(c).alias(f"{side}_{c}") for c in body])
        full = full.join(own, ["label", "dim", f"{side}_block"])
    # Few pairs to a task, as each brings two blocks.
    full = full.repartition(max(1, -(-pairs.count() // 8)))
    found = materialize(arrow_map(full, _products(least, double), "u long, v long, edge boolean"), "links")
    roots = connected_components(found.where("edge").select("u", "v"))
    links = found.where("not edge").groupBy(F.col("u").alias("rep")).agg(F.sum("v").alias("far"))
    known = classes.join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("label", "h", "embedding", (F.coalesce("far", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    on = ["label", "h", "embedding"]
    out = good.join(known, on, "left").select("vec_id", "n_links", "component_id")
    out = out.unionByName(v.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
