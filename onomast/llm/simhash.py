"""SimHash near-duplicates by a self-join over binary tries of fingerprints.

Two 64-bit fingerprints that differ in at most ``budget`` bits agree on at
least r of ``budget + r`` blocks of bits.  Distinct fingerprints are dealt by
each choice of r blocks and their value, r growing with their number so that
buckets stay small; the members of a bucket form a binary trie, which is joined with itself:
node pairs are walked down together, differing bits add up, and a pair is left
as soon as they exceed the budget.  A bucket of more than ``chunk``
fingerprints becomes several tries, joined pairwise in different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize
from .components import connected_components, forest

CHUNK = 1024
LEAF = 24


def shingle_hashes(text: str | None, size: int = 4) -> np.ndarray:
    """64-bit hashes of a text's shingles of ``size`` words in order, repeats included; of fewer words the whole is one shingle, of none there is none."""
    # bytes.lower() maps A-Z only, bytes.split() cuts at \x20 and \x09-\x0D only.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - size + 1)
    last = ends[size - 1 :] - 1 if len(words) >= size else ends[-1:] - 1
    h64 = xxhash.xxh64_intdigest
    return np.array([h64(line[a:b], 42) for a, b in zip(starts[:n].tolist(), last.tolist())], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set where more than half of the hashes have it set; 0 of none."""
    n = len(hashes)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        part = hashes[at : at + 65_536].astype(">u8")
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big") if n else 0


def fingerprint(text: str | None, size: int = 4) -> int:
    """The 64-bit fingerprint of a text; 0 if it has no words."""
    return majority(shingle_hashes(text, size))


def add_fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            f = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(f.view(np.int64))], names=["doc_id", "fp"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def trie_pairs(bits: np.ndarray, side: np.ndarray, cuts: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Joins tries.  bits: fingerprints, those of a trie together and sorted,
    tries being [cuts[i], cuts[i+1]).  side: 0 or 1 where two tries of a bucket
    meet (only pairs across sides are wanted), 2 where a trie meets itself.
    Yields positions (i, j) of pairs within the budget."""
    lo, hi = cuts[:-1], cuts[1:]
    mid = lo + np.array([np.searchsorted(side[a:b], 1) for a, b in zip(lo, hi)], dtype=np.int64) if len(lo) else lo
    own = np.array([side[a] == 2 for a in lo], dtype=bool) if len(lo) else np.zeros(0, bool)
    a0, a1 = lo, np.where(own, hi, mid)
    b0, b1 = np.where(own, lo, mid), hi
    diff = np.zeros(len(lo), np.int64)
    for bit in range(63, -2, -1):
        full = (a1 > a0) & (b1 > b0) & (diff <= budget) & ~((a0 == b0) & (a1 - a0 == 1))
        a0, a1, b0, b1, diff = a0[full], a1[full], b0[full], b1[full], diff[full]
        small = ((a1 - a0) * (b1 - b0) <= LEAF) | (bit < 0)
        if small.any():
            for at in range(0, int(small.sum()), 200_000):
                pick = np.flatnonzero(small)[at : at + 200_000]
                na, nb = a1[pick] - a0[pick], b1[pick] - b0[pick]
                n = na * nb
                k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                i = np.repeat(a0[pick], n) + k // np.repeat(nb, n)
                j = np.repeat(b0[pick], n) + k % np.repeat(nb, n)
                near = (np.bitwise_count(bits[i] ^ bits[j]) <= budget) & (i < j)
                yield i[near], j[near]
            big = ~small
            a0, a1, b0, b1, diff = a0[big], a1[big], b0[big], b1[big], diff[big]
        if not len(a0) or bit < 0:
            return
        ones = np.concatenate([[0], np.cumsum((bits >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = (a0 == b0) & (a1 == b1)
        other = ~same
        a0, a1, b0, b1, diff = (
            np.concatenate(x)
            for x in (
                (a0, am, a0, am[other]),
                (am, a1, am, a1[other]),
                (b0, bm, bm, b0[other]),
                (bm, b1, b1, bm[other]),
                (diff, diff, diff + 1, diff[other] + 1),
            )
        )


def _join(budget: int):
    def run(batches):
        rest = None

        def joined(t: pa.Table):
            key = np.stack([t[c].to_numpy().astype(np.int64) for c in ("block", "val", "pa", "pb")])
            bits, side = t["fp"].to_numpy().view(np.uint64), t["side"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [t.num_rows]])
            a, b, n = [], [], 0
            for i, j in trie_pairs(bits, side, cuts, budget):
                a.append(i)
                b.append(j)
                n += len(i)
                if n > 2_000_000:  # a forest says as much as all its pairs
                    u, v = forest(np.concatenate(a), np.concatenate(b))
                    a, b, n = [u], [v], len(u)
            if n:
                u, v = forest(np.concatenate(a), np.concatenate(b))
                yield pa.record_batch([pa.array(bits[u].view(np.int64)), pa.array(bits[v].view(np.int64))], names=["u", "v"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            rest = t if rest is None else pa.concat_tables([rest, t])
            if rest.num_rows < 40_000:
                continue
            key = np.stack([rest[c].to_numpy().astype(np.int64) for c in ("block", "val", "pa", "pb")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
            if len(cuts):
                at = int(cuts[-1]) + 1
                yield from joined(rest.slice(0, at).combine_chunks())
                rest = rest.slice(at)
        if rest is not None and rest.num_rows:
            yield from joined(rest.combine_chunks())

    return run


def block_keys(count: int, budget: int, chunk: int) -> list[list[tuple[int, int]]]:
    """Choices of blocks, each a list of (lowest bit, width), of which two fingerprints within the budget agree on one.

    All r of budget + r blocks do for any r; it is chosen so that ``count``
    fingerprints make the fewest rows.
    """

    def rows(r: int) -> float:
        shared = 64 * r // (budget + r)
        return comb(budget + r, r) * max(1, ceil(count / chunk / 2**shared))

    r = min(range(1, 5), key=rows)
    m = budget + r
    edges = [64 * k // m for k in range(m + 1)]
    return [list(pick) for pick in combinations([(a, b - a) for a, b in zip(edges, edges[1:])], r)]


def fingerprint_links(prints: DataFrame, budget: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Edges (u, v) that join all distinct values of prints.fp at budget or fewer differing bits,
    thinned to spanning forests: no connection is lost."""
    fp, made = F.col("fp"), []
    for k, pick in enumerate(block_keys(prints.count(), budget, chunk)):
        val = F.lit(0).cast("long")
        for low, width in pick:
            val = F.shiftleft(val, width) + F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
        made.append(F.struct(F.lit(k).alias("block"), val.alias("val")))
    keys = F.array(*made)
    dealt = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.block", "k.val")
    sizes = dealt.groupBy("block", "val").agg(F.count("*").alias("n")).where("n > 1")
    # Every bucket that is not hot is a trie of its own; of a hot one, each row goes to the tries its part meets.
    c = F.ceil(F.col("n") / chunk).cast("int")
    mine = F.pmod(F.xxhash64("fp"), c).cast("int")
    rows = dealt.join(sizes, ["block", "val"]).withColumn("c", c).withColumn("mine", mine)
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    rows = rows.select(
        "fp",
        "block",
        "val",
        F.least("mine", "with").alias("pa"),
        F.greatest("mine", "with").alias("pb"),
        F.when(F.col("mine") == F.col("with"), 2).when(F.col("mine") < F.col("with"), 0).otherwise(1).alias("side"),
    )
    rows = rows.repartition(F.col("block"), F.col("val"), F.col("pa"), F.col("pb"))
    rows = rows.sortWithinPartitions("block", "val", "pa", "pb", "side", F.col("fp").bitwiseXOR(F.lit(-(1 << 63))))
    return arrow_map(rows, _join(budget), "u long, v long")


def simhash_components(docs: DataFrame, size: int = 4, budget: int = 4, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id (the least
    doc_id reachable over links of ``budget`` or fewer differing bits).

    A null or empty text has no words and the fingerprint zero, which links
    like any other.  Repeated rows and exact copies share a fingerprint and
    meet once, as one class.  An empty table gives an empty result.  Columns
    other than doc_id and text are not read.
    """
    prints = materialize(add_fingerprints(docs, size), "simhash")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-classes")
    roots = connected_components(fingerprint_links(classes.select("fp"), budget, chunk))
    with_root = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    with_root = materialize(with_root, "simhash-roots")
    least = with_root.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = with_root.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")
