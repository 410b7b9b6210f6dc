"""Vector codes: one codebook per part position, learned by filtering Lloyd rounds.

Vectors become integers, so that all sums and distances are exact.  Tasks cut
their rows into blocks and build, for each part position, a kd-tree over the
block's parts, once; a node holds the box, the sum and the count of what lies
below it.  A round passes the codebook's entries down the trees: an entry goes
where some other one is nearer to the whole box, and a node left with one entry
gives it its sum and count without a look at its parts.  Of ties the lower
index wins, in boxes as in parts.  A round sends 8 x 16 sums a block's task.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a block, and parts of a tree's leaf.
BLOCK, LEAF = 10_000, 8
#: Components beyond this (4,096 before scaling) count as this, so that squared distances fit in 64 bits.
LIMIT = 1 << 24


class Tree:
    """A kd-tree over points (n x d integers), level by level; leaves hold runs of ``order``."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.order = np.arange(n)
        begin, end, left, right = [0], [n], [], []
        todo = [0]
        while todo:
            node = todo.pop(0)
            a, b = begin[node], end[node]
            own = points[self.order[a:b]]
            spread = own.max(axis=0) - own.min(axis=0)
            left.append(-1)
            right.append(-1)
            if b - a <= LEAF or not spread.max():
                continue
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, spread.argmax()], mid)]
            left[node], right[node] = len(begin), len(begin) + 1
            begin += [a, a + mid]
            end += [a + mid, b]
            todo += [left[node], right[node]]
        self.begin, self.end, self.left, self.right = (np.array(x) for x in (begin, end, left, right))
        self.points = points[self.order]
        runs = [self.points[a:b] for a, b in zip(begin, end)]
        self.low = np.stack([x.min(axis=0) for x in runs])
        self.high = np.stack([x.max(axis=0) for x in runs])
        before = np.concatenate([np.zeros((1, points.shape[1]), np.int64), self.points.cumsum(axis=0)])
        self.sums, self.counts = before[self.end] - before[self.begin], self.end - self.begin

    def assign(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Sums and counts of each entry, and (nodes, entry of each) with (parts, entry of each) that make them up."""
        sums, counts, given = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64), []
        nodes, alive = np.zeros(1, np.int64), np.ones((1, len(book)), bool)
        index = np.arange(len(book))
        while len(nodes):
            low, high = self.low[nodes], self.high[nodes]
            # Twice the box's centre, so that it is an integer.
            far = ((2 * book[None] - (low + high)[:, None]) ** 2).sum(axis=2)
            far[~alive] = np.iinfo(np.int64).max
            star = far.argmin(axis=1)
            # d(star, x) - d(z, x) is linear in x: its greatest value is at the corner towards z.
            toward = book[None] - book[star][:, None]
            corner = np.where(toward > 0, high[:, None], low[:, None])
            worst = ((book[star][:, None] - corner) ** 2).sum(axis=2) - ((book[None] - corner) ** 2).sum(axis=2)
            alive &= ~((worst < 0) | ((worst == 0) & (star[:, None] < index)))
            alive[np.arange(len(nodes)), star] = True
            sole = alive.sum(axis=1) == 1
            if sole.any():
                whole, entry = nodes[sole], star[sole]
                np.add.at(sums, entry, self.sums[whole])
                np.add.at(counts, entry, self.counts[whole])
                given.append((np.concatenate([np.arange(a, b) for a, b in zip(self.begin[whole], self.end[whole])]), np.repeat(entry, self.counts[whole])))
            leaf = ~sole & (self.left[nodes] < 0)
            if leaf.any():
                parts = np.concatenate([np.arange(a, b) for a, b in zip(self.begin[nodes[leaf]], self.end[nodes[leaf]])])
                entry = nearest(self.points[parts], book)
                np.add.at(sums, entry, self.points[parts])
                counts += np.bincount(entry, minlength=len(book))
                given.append((parts, entry))
            down = ~sole & ~leaf
            nodes, alive = np.concatenate([self.left[nodes[down]], self.right[nodes[down]]]), np.concatenate([alive[down]] * 2)
        return sums, counts, given


def nearest(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((points[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            vecs = np.stack(part.column(2).to_numpy(zero_copy_only=False)).astype(np.int64)
            trees = [Tree(x) for x in np.split(vecs, PARTS, axis=1)]
            # int32 on disk; what is derived is small beside the points.
            body = pickle.dumps([{k: v if k == "sums" else v.astype(np.int32) for k, v in vars(t).items()} for t in trees])
            yield pa.record_batch([pa.array([pickle.dumps((part.column(0), part.column(1)))], pa.binary()), pa.array([body], pa.binary())], names=["rows", "trees"])


def _loaded(body: bytes) -> list[Tree]:
    out = []
    for held in pickle.loads(body):
        tree = Tree.__new__(Tree)
        vars(tree).update({k: v.astype(np.int64) for k, v in held.items()})
        out.append(tree)
    return out


def _round(books: np.ndarray):
    def run(batches):
        sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for body in batch.column(0):
                for i, tree in enumerate(_loaded(body.as_py())):
                    s, n, _ = tree.assign(books[i])
                    sums[i] += s
                    counts[i] += n
        part, entry = np.nonzero(counts)
        yield pa.record_batch([pa.array(part), pa.array(entry), pa.array(counts[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    return run


def _codes(books: np.ndarray):
    def run(batches):
        for batch in batches:
            for rows, body in zip(batch.column(0), batch.column(1)):
                ids, labels = pickle.loads(rows.as_py())
                codes, error = np.zeros((len(ids), PARTS), np.uint8), np.zeros(len(ids), np.int64)
                for i, tree in enumerate(_loaded(body.as_py())):
                    for parts, entry in tree.assign(books[i])[2]:
                        codes[tree.order[parts], i] = entry
                        np.add.at(error, tree.order[parts], ((tree.points[parts] - books[i][entry]) ** 2).sum(axis=1))
                yield pa.record_batch([ids, labels, pa.array([x.tobytes().hex() for x in codes]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def _whole(x: Column) -> Column:
    scaled = F.floor(x.cast("double") * SCALE)
    return F.when(scaled > LIMIT, LIMIT).when(scaled < -LIMIT, -LIMIT).otherwise(scaled).cast("int")


def vector_codes(vectors: DataFrame) -> DataFrame:
    """One row per kept row of vectors (vec_id, embedding, label): vec_id, code, error, label_error, codebooks_sha256.

    Dropped are vectors that are null or hold a null or a number that isn't
    finite, and those whose length isn't that of the kept vector of least
    vec_id or no multiple of 8.  A codebook begins with the parts of the 16
    rows of least vec_id (fewer, if there are fewer; null ids last, equal ids
    by their vectors); repeated rows count each.  Components whose scaled value
    is beyond 2^24 count as that.  An empty table gives none; other columns
    aren't read.
    """
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding")
    v = v.where(F.col("embedding").isNotNull() & ~bad & (F.size("embedding") > 0) & (F.size("embedding") % PARTS == 0))
    v = v.select("vec_id", "label", F.transform("embedding", _whole).alias("v"))
    first = [r["v"] for r in v.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).collect()]
    out = "vec_id long, label string, code string, error long"
    if not first:
        empty = v.sparkSession.createDataFrame([], out.replace(", label string", ""))
        return empty.select("*", F.col("error").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    dim = len(first[0])
    if any(len(x) != dim for x in first):
        first = [r["v"] for r in v.where(F.size("v") == dim).orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).collect()]
    books = np.stack(np.split(np.array(first, np.int64), PARTS, axis=1))
    trees = materialize(arrow_map(v.where(F.size("v") == dim), _trees, "rows binary, trees binary"), "trees")
    for _ in range(ROUNDS):
        moved = arrow_map(trees.select("trees"), _round(books), "part long, entry long, n long, sums array<long>")
        each = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim // PARTS)]
        books = books.copy()
        for r in moved.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():
            books[r["part"], r["entry"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dim // PARTS)]
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    coded = materialize(arrow_map(trees, _codes(books), out), "codes")
    of_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    out = coded.join(of_label, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
