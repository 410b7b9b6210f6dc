"""SimHash near-duplicates at a Jaccard similarity of word shingles.

The distinct shingles of a text are put in one order that holds for the whole
table.  Two sets of similarity t or more share an element among the first
``n - ceil(t * n) + 1`` of each, so texts meet at the elements of these
prefixes.  Of the texts that meet at one, a self-join of the trie of their
SimHash fingerprints finds those within an error budget, and only such pairs
are compared: by sketches of their sets, which tell most unlike ones apart
and no others, then by their whole sets.  Shingles seen in many texts come last in
the order, so that a common passage brings few texts together; which ones
count as common changes the work, never the result.

The budget is wide: texts of similarity 0.8 differ in about 10 of 64 bits,
with a deviation of 3, unrelated ones in 32 with one of 4.

Each text is first compared with one other that it meets.  Only those that
this leaves in different components are then compared pair by pair.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .common import arrow_map, materialize
from .components import connected_components
from .simhash import majority, shingle_hashes, trie_pairs

#: Counters for common shingles in a task, and how many of them are kept in all.
COUNTERS = 1 << 20
MOST_COMMON = 50_000
#: About so many pairs of one text are compared in one go.
PAIRS = 256
#: A text of more pairs than these is the hub of them.
BUSY = 16
EPS = 1e-9
#: Error budget of fingerprints: pairs beyond it aren't compared.
BITS = 24
#: Turns in which a text meets so many of the nearest and of the most central ones, before all that are left.
TURNS, FEW = 2, 2
#: Texts at one element that are joined as a trie; more of them meet leaders first.
TRIE = 512


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """64-bit hashes of the distinct shingles, sorted; a text of fewer words is one shingle, one without words has none."""
    return np.unique(shingle_hashes(text, size))


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - EPS


def sketch(s: np.ndarray) -> bytes:
    """A bit for each of the low bits of the hashes that the set holds, in as many places as it has elements, or up to twice that."""
    bits = np.zeros(1 << max(6, (len(s) - 1).bit_length()), bool)
    bits[(s & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def may_be_similar(a: bytes, n_a: int, b: bytes, n_b: int, least: float) -> bool:
    """Whether sets of these sketches and sizes can be similar enough; a bit that only one has is an element that the other lacks."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) != len(y):
        short = min(len(x), len(y))
        x, y = (np.bitwise_or.reduce(z.reshape(-1, short), axis=0) for z in (x, y))
    both = min(n_a - int(np.bitwise_count(x & ~y).sum()), n_b - int(np.bitwise_count(y & ~x).sum()))
    return both >= least * (n_a + n_b - both) - EPS


def add_sets(docs: DataFrame, size: int) -> DataFrame:
    """docs with ``set``, a hash of the whole set of shingles, ``n``, its size, ``fp``, the SimHash fingerprint of the set, in which repeats count once, and its ``sketch``."""

    def run(batches):
        for batch in batches:
            key, n, fp, bits = [], [], [], []
            for t in batch.column("text").to_pylist():
                s = shingles(t, size)
                key.append(xxhash.xxh64_intdigest(s.tobytes(), 7))
                n.append(len(s))
                fp.append(majority(s))
                bits.append(sketch(s))
            made = [pa.array(np.array(key, dtype=np.uint64).view(np.int64)), pa.array(n, pa.int32()), pa.array(np.array(fp, dtype=np.uint64).view(np.int64)), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "set", "n", "fp", "sketch"])

    made = [StructField("set", LongType()), StructField("n", IntegerType()), StructField("fp", LongType()), StructField("sketch", BinaryType())]
    return arrow_map(docs, run, StructType([*docs.schema.fields, *made]))


def common_shingles(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Counters (low bits of the hash) of common shingles, sorted, and their counts."""

    def run(batches):
        counts, total = np.zeros(COUNTERS, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                s = shingles(t, size)
                np.add.at(counts, (s & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
                total += len(s)
        at = np.flatnonzero(counts >= 3 * total / COUNTERS + 16)
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["at", "n"])

    found = arrow_map(rows.select("text"), run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    found = sorted((r["at"], r["n"]) for r in found.orderBy(F.desc("n"), "at").limit(MOST_COMMON).collect())
    return np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64)


def prefixes(rows: DataFrame, size: int, least: float) -> DataFrame:
    """(h, set, n, pos, fp): the elements by which texts meet, each with its place in the order of its set."""
    at, n_at = common_shingles(rows, size)

    def run(batches):
        seen = set()
        for batch in batches:
            out = []
            for t, key, fp in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if key in seen:
                    continue
                seen.add(key)
                s = shingles(t, size)
                if not len(s):
                    continue
                if len(at):
                    low = (s & np.uint64(COUNTERS - 1)).astype(np.int64)
                    k = np.minimum(np.searchsorted(at, low), len(at) - 1)
                    s = s[np.argsort(np.where(at[k] == low, n_at[k], 0), kind="stable")]
                p = len(s) - math.ceil(least * len(s) - EPS) + 1
                out.append((s[:p].view(np.int64), key, len(s), fp))
            if out:
                size_of = [len(o[0]) for o in out]
                columns = [
                    pa.array(np.concatenate([o[0] for o in out])),
                    pa.array(np.repeat(np.array([o[1] for o in out], np.int64), size_of)),
                    pa.array(np.repeat(np.array([o[2] for o in out], np.int32), size_of)),
                    pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in size_of])),
                    pa.array(np.repeat(np.array([o[3] for o in out], np.int64), size_of)),
                ]
                yield pa.record_batch(columns, names=["h", "set", "n", "pos", "fp"])

    return arrow_map(rows.select("text", "set", "fp"), run, "h long, set long, n int, pos int, fp long")


def _by_group(batches, work, rows: int = 200_000):
    """Hands whole groups of equal h, many at a time, of batches sorted by h to work(table)."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        rest = t if rest is None else pa.concat_tables([rest, t])
        if rest.num_rows < rows:
            continue
        h = rest["h"].to_numpy()
        cuts = np.flatnonzero(h[1:] != h[:-1])
        if len(cuts):
            yield from work(rest.slice(0, int(cuts[-1]) + 1))
            rest = rest.slice(int(cuts[-1]) + 1)
    if rest is not None and rest.num_rows:
        yield from work(rest)


def _near_groups(bits: np.ndarray, cuts: np.ndarray, budget: int) -> np.ndarray:
    """For members of groups [cuts[i], cuts[i+1]), sorted by their bits: the first member of the group within the budget, itself of the first, or -1 where there is none."""
    lead = np.full(len(bits), -1)
    size_of = np.diff(cuts)
    small = np.flatnonzero(size_of <= TRIE)
    if len(small):
        at = np.concatenate([np.arange(cuts[g], cuts[g + 1]) for g in small]) if len(small) < len(size_of) else np.arange(len(bits))
        inner = np.concatenate([[0], np.cumsum(size_of[small])])
        for i, j in trie_pairs(bits[at], np.full(len(at), 2), inner, budget):
            i, j = at[i], at[j]
            for a, b in ((i, j), (j, i)):
                best = np.full(len(bits), len(bits))
                np.minimum.at(best, b, a)
                hit = best < len(bits)
                lead[hit] = np.where(lead[hit] < 0, best[hit], np.minimum(lead[hit], best[hit]))
    for g in np.flatnonzero(size_of > TRIE):
        a, b = int(cuts[g]), int(cuts[g + 1])
        own, open_ = bits[a:b], np.ones(b - a, bool)
        near = np.full(b - a, -1)
        for k in range(b - a):  # those within the budget of a leader need no more leaders
            if open_[k]:
                hit = np.bitwise_count(own ^ own[k]) <= budget
                hit[k] = False
                if hit.any():
                    fresh = hit & (near < 0)
                    near[fresh] = k
                    if near[k] < 0:
                        near[k] = int(np.flatnonzero(hit)[0])
                    open_[hit] = False
                open_[k] = False
        lead[a:b] = np.where(near >= 0, near + a, -1)
    return lead


def _meetings(batches):
    """Of rows sorted by h: those of texts that have a near one among those that share the element, with such a one as lead."""

    def work(t: pa.Table):
        h, s, fp = (t[c].to_numpy() for c in ("h", "set", "fp"))
        order = np.lexsort((s, fp.view(np.uint64), h))
        h, s, fp = h[order], s[order], fp[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size_of = np.diff(np.concatenate([first, [len(h)]]))
        keep = new & (np.repeat(size_of, size_of) > 1)
        t = t.take(pa.array(order[keep])).combine_chunks()
        h, fp = h[keep], fp[keep].view(np.uint64)
        if not len(h):
            return
        cuts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
        lead = _near_groups(fp, cuts, BITS)
        mine = np.flatnonzero(lead >= 0)
        if not len(mine):
            return
        out, other = t.take(pa.array(mine)), t.take(pa.array(lead[mine]))
        for name in ("set", "n", "pos"):
            out = out.append_column(f"lead_{name}", other[name])
        yield from out.combine_chunks().to_batches()

    yield from _by_group(batches, work)


def _across(least: float, full: bool):
    """Of rows (h, set, n, pos, fp, root) sorted by h: pairs (u, v) of different roots that may be similar enough.

    Unless ``full``, a text meets no more than a few: the nearest by their
    fingerprints, and those nearest to the middle of all, which in a cluster
    of copies is what they were made from.
    """

    def run(batches):
        def work(t: pa.Table):
            h, s, n, pos, root = (t[c].to_numpy() for c in ("h", "set", "n", "pos", "root"))
            fp = t["fp"].to_numpy().view(np.uint64)
            cuts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
            us, vs = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                names, of, count = np.unique(root[a:b], return_inverse=True, return_counts=True)
                if len(names) < 2:
                    continue
                bits = fp[a:b]
                ones = np.unpackbits(bits.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0)
                middle = np.frombuffer(np.packbits(2 * ones > b - a).tobytes(), ">u8")[0].astype(np.uint64)
                central = np.argsort(np.bitwise_count(bits ^ middle), kind="stable")
                rare = np.flatnonzero(of != np.argmax(count))  # each pair across roots has one of these
                for k in rare if full else range(b - a):
                    i = a + int(k)
                    apart = np.bitwise_count(bits ^ fp[i])
                    rest = np.minimum(n[a:b] - pos[a:b], n[i] - pos[i])
                    near = (of != of[k]) & (apart <= BITS) & (rest >= least / (1 + least) * (n[a:b] + n[i]) - EPS)
                    if not near.any():
                        continue
                    if full:
                        j = np.flatnonzero(near)
                    else:
                        hub = central[near[central]][:FEW]
                        open_ = np.flatnonzero(near)
                        j = np.unique(np.concatenate([hub, open_[np.argsort(apart[open_], kind="stable")[:FEW]]]))
                    us.append(np.minimum(s[i], s[a + j]))
                    vs.append(np.maximum(s[i], s[a + j]))
            if us:
                yield pa.record_batch([pa.array(np.concatenate(us), pa.int64()), pa.array(np.concatenate(vs), pa.int64())], names=["u", "v"])

        yield from _by_group(batches, work)

    return run


def _may(a: str, b: str, least: float):
    """Whether two sets that first meet at these places can be similar enough."""
    rest = F.least(F.col(f"{a}n") - F.col(f"{a}pos"), F.col(f"{b}n") - F.col(f"{b}pos"))
    return rest >= least / (1 + least) * (F.col(f"{a}n") + F.col(f"{b}n")) - EPS


def _dealt(pairs: DataFrame) -> DataFrame:
    """(hub, part, set, leaf): the texts that pairs (u, v) of sets need, each where it is compared.

    A pair goes with that of its two sides which has more pairs, the hub, and
    the pairs of one hub go to as many tasks as they fill: each task gets the
    hub once and the others as it comes to them.
    """
    sides = pairs.select(F.col("u").alias("set")).unionByName(pairs.select(F.col("v").alias("set")))
    busy = materialize(sides.groupBy("set").agg(F.count("*").alias("k")).where(F.col("k") > BUSY), "near-busy")
    of = lambda c: busy.select(F.col("set").alias(c), F.col("k").alias(f"k{c}"))
    ku, kv = F.coalesce("ku", F.lit(1)), F.coalesce("kv", F.lit(1))
    hub, leaf = F.when(kv > ku, F.col("v")).otherwise(F.col("u")), F.when(kv > ku, F.col("u")).otherwise(F.col("v"))
    part = F.pmod(F.xxhash64(leaf), F.ceil(F.greatest(ku, kv) / PAIRS)).cast("int")
    dealt = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left")
    dealt = materialize(dealt.select(hub.alias("hub"), part.alias("part"), leaf.alias("set"), F.lit(True).alias("leaf")), "near-dealt")
    hubs = dealt.select("hub", "part").distinct().select("hub", "part", F.col("hub").alias("set"), F.lit(False).alias("leaf"))
    return hubs.unionByName(dealt)


def _compared(pairs: DataFrame, known: DataFrame, made, close) -> DataFrame:
    """Of pairs (u, v) of sets those that are close by what is made of the columns that are known of each set."""
    columns = [c for c in known.columns if c != "set"]
    sent = _dealt(pairs).join(known, "set").select("hub", "part", "leaf", "set", *columns)
    sent = sent.repartition(F.col("hub"), F.col("part")).sortWithinPartitions("hub", "part", "leaf")

    def run(batches):
        held = None
        for batch in batches:
            u, v = [], []
            for hub, _, leaf, key, *values in zip(*(c.to_pylist() for c in batch.columns)):
                if not leaf:
                    held = made(*values)
                elif close(held, made(*values)):
                    u.append(min(hub, key))
                    v.append(max(hub, key))
            yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return materialize(arrow_map(sent, run, "u long, v long"), "near-links")


def _verified(pairs: DataFrame, rows: DataFrame, sets: DataFrame, size: int, least: float) -> DataFrame:
    """Of pairs (u, v) of sets those that are similar enough by all their shingles; only texts of pairs that their sketches leave are read and sent."""
    likely = _compared(pairs, sets.select("set", "sketch", "n"), lambda b, n: (b, n), lambda a, b: may_be_similar(*a, *b, least))
    if likely.isEmpty():
        return likely
    sides = likely.select(F.col("u").alias("set")).unionByName(likely.select(F.col("v").alias("set"))).distinct()
    # A table of its own, by whose size Spark sees whether it is sent to the texts or they to it.
    chosen = materialize(sets.join(sides, "set", "left_semi").select("row"), "near-chosen")
    texts = rows.join(chosen, "row", "left_semi").select("set", "text")
    return _compared(likely, texts, lambda t: shingles(t, size), lambda a, b: similar(a, b, least))


def near_roots(docs: DataFrame, size: int = 5, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """docs with ``row``, a number, and ``set``, a hash of the text's shingles; and (set, root): the
    sets that are linked to others, with the least one that a chain of links reaches.

    A link is a Jaccard similarity of ``least`` or more between sets of
    shingles of ``size`` words.  Rows of one set are copies.
    """
    rows = materialize(add_sets(docs, size).withColumn("row", F.monotonically_increasing_id()), "near-rows")
    sets = materialize(rows.groupBy("set", "n", "sketch").agg(F.min("row").alias("row")), "near-sets")
    dealt = prefixes(rows, size, least).repartition(F.col("h")).sortWithinPartitions("h")
    schema = "h long, set long, n int, pos int, fp long, lead_set long, lead_n int, lead_pos int"
    met = materialize(arrow_map(dealt, _meetings, schema), "near-met")
    tried = met.where(_may("", "lead_", least)).select(F.least("lead_set", "set").alias("u"), F.greatest("lead_set", "set").alias("v"))
    tried = materialize(tried.where("u <> v").distinct(), "near-pairs")
    links = _verified(tried, rows, sets, size, least)
    roots = materialize(connected_components(links), "near-roots")
    met = met.select("h", "set", "n", "pos", "fp")
    # Sets that met, and are not yet in one component, meet others: few at a time, and at last all that are left.
    for turn in range(TURNS + 1):
        own = met.join(roots.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
        open_ = own.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("k")).where("lo < hi and k > 2").select("h")
        # Components only grow, so what meets in one of them now needs no later turn.
        own = materialize(own.join(open_, "h", "left_semi"), "near-open")
        met = own.select(*met.columns)
        own = own.select(*met.columns, "root").repartition(F.col("h")).sortWithinPartitions("h")
        more = arrow_map(own, _across(least, turn == TURNS), "u long, v long").distinct().join(tried, ["u", "v"], "left_anti")
        more = materialize(more, "near-pairs")
        if more.isEmpty():
            if turn < TURNS:
                continue
            break
        found = _verified(more, rows, sets, size, least)
        tried = materialize(tried.unionByName(more), "near-tried")
        if not found.isEmpty():
            links = links.unionByName(found)
            roots = materialize(connected_components(links), "near-roots")
    return rows.select(*docs.columns, "row", "set"), roots.withColumnRenamed("node", "set")


def add_component(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "set", "left").withColumn("component", F.coalesce("root", "set")).drop("set", "root")


def near_components(docs: DataFrame, size: int = 5, least: float = 0.8) -> DataFrame:
    """Rows of docs with ``row``, a number, and ``component``: rows share it if they are
    joined by a chain of links, a link being a Jaccard similarity of ``least`` or more
    between their sets of shingles of ``size`` words.

    Texts without words, null included, are copies of each other.  Ids play no
    part.  An empty table gives an empty result.
    """
    rows, roots = near_roots(docs, size, least)
    return add_component(rows, roots).select(*docs.columns, "row", "component")
