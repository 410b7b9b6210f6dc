"""Packing documents into sequences by a linear grouping scheme.

Lengths are at most one sequence, so a count per length is a table of bounded
size, and the whole plan is made from it: large lengths are sorted and split
into groups of equal cardinality, each rounded up to its largest; the few sizes
that result are packed by patterns from column generation; actual lengths
then take the places of rounded ones; and small lengths, with what the rounding
of the patterns left over, go best-fit into the room that remains.  Every step works on runs
of equal lengths and equal sequences, so its work doesn't grow with the number
of documents.  A plan says which ranks of a length go to which sequences;
documents get ranks from counts per task, never by a sort.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialize
from .tokens import Encoder, slices

GROUPS = 32
#: Lengths above such a share of a sequence are large; the shares are tried in this order.
LARGE = (1 / 3, 1 / 6, 0.0)


class Plan:
    """Rows (length, lo, hi, base, each, offset): ranks lo to hi - 1 of a length
    go to sequences from base on, ``each`` to a sequence, the first at offset."""

    def __init__(self, size: int):
        self.size, self.rows, self.sequences = size, [], 0

    def put(self, length: int, lo: int, n: int, base: int, each: int, offset: int) -> None:
        if n:
            self.rows.append((length, lo, lo + n, base, each, offset))

    def arrays(self) -> np.ndarray:
        return np.array(sorted(self.rows), dtype=np.int64).reshape(-1, 6)


def _best_pattern(size: int, sizes: list[int], worth: np.ndarray) -> tuple[float, list[int]]:
    """The multiset of sizes that fits and is worth most."""
    best, last = [0.0] * (size + 1), [-1] * (size + 1)
    usable = [(s, float(v), g) for g, (s, v) in enumerate(zip(sizes, worth)) if v > 1e-12]
    if usable:
        least = min(s for s, _, _ in usable)
        # Only sums of sizes can be ends of a pattern.
        for w in range(least, size + 1):
            top, at = best[w - 1], -2
            for s, v, g in usable:
                if s <= w and best[w - s] + v > top + 1e-12:
                    top, at = best[w - s] + v, g
            best[w], last[w] = top, at
    count, w = [0] * len(sizes), size
    while w > 0:
        if last[w] == -2:
            w -= 1
        elif last[w] == -1:
            break
        else:
            count[last[w]] += 1
            w -= sizes[last[w]]
    return best[size], count


def patterns(size: int, sizes: list[int], need: list[int], rounds: int = 400) -> list[tuple[int, list[int]]]:
    """Whole multiplicities of patterns, rounded down from a solution of the
    configuration linear program: min sum x, sum of x over patterns = need."""
    k = len(sizes)
    basis = np.diag([float(size // s) for s in sizes])
    demand = np.array(need, dtype=float)
    x = np.linalg.solve(basis, demand)
    for _ in range(rounds):
        worth = np.linalg.solve(basis.T, np.ones(k))
        value, column = _best_pattern(size, sizes, worth)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, np.array(column, dtype=float))
        if (step <= 1e-9).all():
            break
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        leaves = int(np.argmin(ratio))
        basis[:, leaves] = column
        x = np.maximum(np.linalg.solve(basis, demand), 0)
    return [(int(x[j] + 1e-6), [int(round(v)) for v in basis[:, j]]) for j in range(k) if x[j] >= 1 - 1e-6]


def plan_packing(counts: dict[int, int], size: int, groups: int = GROUPS, large: tuple[float, ...] = LARGE) -> Plan:
    """The plan for so many items of each length, 1 to size: the one of fewest
    sequences over the shares of a sequence from which a length counts as
    large, tried until a plan meets the bound of all tokens over ``size``."""
    bound = -(-sum(s * n for s, n in counts.items()) // size)
    best = None
    for share in large:
        plan = _plan(counts, size, groups, share)
        if best is None or plan.sequences < best.sequences:
            best = plan
        if best.sequences <= bound:
            break
    return best


def _plan(counts: dict[int, int], size: int, groups: int, large: float) -> Plan:
    plan = Plan(size)
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> runs of sequences (first, how many)
    free: list[int] = []

    def leave(left: int, first: int, n: int) -> None:
        if n and left:
            if left not in room or not room[left]:
                insort(free, left)
            room[left].append((first, n))

    big = sorted((s for s in counts if s > size * large and counts[s] > 0), reverse=True)
    total = sum(counts[s] for s in big)
    if total:
        # Runs of each group: (length, first rank, how many).
        share = -(-total // groups)
        runs: list[list[list[int]]] = [[]]
        left = share
        few = len(big) <= groups  # each length is a group, and nothing is rounded
        for s in big:
            lo, n = 0, counts[s]
            if few:
                runs.append([[s, 0, n]])
                continue
            while n:
                if not left:
                    runs.append([])
                    left = share
                part = min(n, left)
                runs[-1].append([s, lo, part])
                lo, n, left = lo + part, n - part, left - part
        # Groups that round to one size are one group.
        by_size: dict[int, list[list[int]]] = {}
        for r in filter(None, runs):
            by_size.setdefault(r[0][0], []).extend(r)
        sizes = list(by_size)
        queue = list(by_size.values())
        need = [sum(n for _, _, n in q) for q in queue]
        for times, pattern in sorted(patterns(size, sizes, need), reverse=True):
            stretches = [(plan.sequences, times, 0)]
            plan.sequences += times
            for g, copies in enumerate(pattern):
                for _ in range(copies):
                    after = []
                    for first, n, used in stretches:
                        while n and queue[g]:
                            item = queue[g][0]
                            part = min(n, item[2])
                            plan.put(item[0], item[1], part, first, 1, used)
                            after.append((first, part, used + item[0]))
                            first, n = first + part, n - part
                            item[1] += part
                            item[2] -= part
                            if not item[2]:
                                queue[g].pop(0)
                        if n:
                            after.append((first, n, used))
                    stretches = after
            for first, n, used in stretches:
                leave(size - used, first, n)
        rest = defaultdict(list)
        for q in queue:
            for s, lo, n in q:
                rest[s].append((lo, n))
    else:
        rest = {}
    # Best fit, longest first: what the rounded-down patterns left, then the small lengths.
    for s in sorted({s for s in counts if counts[s] > 0 and s <= size * large} | set(rest), reverse=True):
        for lo, n in rest.get(s) or ([] if s > size * large else [(0, counts[s])]):
            while n:
                at = bisect_left(free, s)
                if at == len(free):
                    each = size // s
                    bins = -(-n // each)
                    leave(size, plan.sequences, bins)
                    plan.sequences += bins
                    continue
                left = free[at]
                first, bins = room[left].pop()
                if not room[left]:
                    free.pop(at)
                each = left // s
                full, over = min(n // each, bins), 0
                plan.put(s, lo, full * each, first, each, size - left)
                leave(left - each * s, first, full)
                lo, n = lo + full * each, n - full * each
                if full < bins:
                    over = min(n, each)
                    if over < n and over < each:
                        raise AssertionError("a stretch was left with room")
                    plan.put(s, lo, over, first + full, over or 1, size - left)
                    leave(left - over * s, first + full, 1)
                    leave(left, first + full + 1, bins - full - 1)
                    lo, n = lo + over, n - over
    return plan


def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 4096, keep: list[str] | None = None) -> DataFrame:
    """One row per piece: doc_id (and other columns ``keep``), piece, start,
    length, ids (unsigned 32-bit, little-endian), _part and _i (a count of
    earlier pieces of that length in the same task).  A null text is empty and
    has the end id alone; texts are encoded whole; only what is longer than
    ``size`` is cut."""
    keep = list(dict.fromkeys(["doc_id", *(keep or [])]))
    keep = [c for c in keep if c not in ("piece", "start", "length", "ids", "_part", "_i")]

    def run(batches):
        encoder = Encoder.of(tokenizer, "bare")
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for b in slices(batch):
                ids, at = encoder.encode(b.column(b.num_columns - 1))
                row, piece, start, length, blob, nth = [], [], [], [], [], []
                for i in range(b.num_rows):
                    own = np.append(ids[at[i] : at[i + 1]], end_id).astype("<u4")
                    for k, a in enumerate(range(0, len(own), size)):
                        cut = own[a : a + size]
                        row.append(i)
                        piece.append(k)
                        start.append(a)
                        length.append(len(cut))
                        blob.append(cut.tobytes())
                        nth.append(seen[len(cut)])
                        seen[len(cut)] += 1
                kept = [b.column(c).take(pa.array(row, pa.int64())) for c in range(b.num_columns - 1)]
                made = [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(blob, pa.binary()), pa.array([part] * len(row), pa.int32()), pa.array(nth, pa.int64())]
                yield pa.record_batch([*kept, *made], names=[*keep, "piece", "start", "length", "ids", "_part", "_i"])

    schema = docs.select(*keep).schema
    for name, kind in (("piece", "integer"), ("start", "long"), ("length", "long"), ("ids", "binary"), ("_part", "integer"), ("_i", "long")):
        schema = schema.add(name, kind)
    return materialize(arrow_map(docs.select(*keep, F.col("text").alias("_text")), run, schema), "pieces")


def pack(pieces: DataFrame, size: int = 4096) -> DataFrame:
    """Adds sequence_id and offset to pieces, as encode_pieces makes them, or to any of their
    columns with length, _part and _i.  No sequence exceeds ``size``; places
    are gapless from 0.  Ties, as copies of a document, take any of the places for their length."""
    spark = pieces.sparkSession
    # A row per task and length; per length, no more than there are tasks.
    counted = materialize(pieces.groupBy("length", "_part").agg(F.count("*").alias("n")), "lengths")
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counted_before = counted.select("length", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    counts = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # ``size`` rows at most
    shared = spark.sparkContext.broadcast(plan_packing(counts, size).arrays())  # bounded as the counts are
    names = [c for c in pieces.columns if c not in ("_part", "_i", "sequence_id", "offset")]

    def run(batches):
        length, lo, _, base, each, offset = shared.value.T
        wide = int((lo.max() if len(lo) else 0) + 1) * 2
        key = length * wide + lo
        for b in batches:
            own, rank = b.column(b.schema.get_field_index("length")).to_numpy(), b.column(b.num_columns - 1).to_numpy()
            at = np.searchsorted(key, own * wide + np.minimum(rank, wide - 1), side="right") - 1
            k = rank - lo[at]
            made = [pa.array(base[at] + k // each[at]), pa.array(offset[at] + k % each[at] * own)]
            yield pa.record_batch([*b.columns[:-1], *made], names=[*names, "sequence_id", "offset"])

    # Counts grow with the tasks: a merge join, so that they are never sent to every executor.
    ranked = pieces.join(counted_before.hint("merge"), ["length", "_part"]).select(*names, (F.col("_before") + F.col("_i")).alias("_rank"))
    schema = pieces.select(*names).schema.add("sequence_id", "long").add("offset", "long")
    return arrow_map(ranked, run, schema)
