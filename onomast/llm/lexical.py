"""Ranked lexical search over document shards.

Documents are cut, in the order in which tasks read them, into shards of
bounded size.  A shard holds its terms in order, and for each term a run of
postings (CSR: one array of starts, one of documents, one of counts, each in
as few bytes a number as hold it).  An impact is the integer share of a term's
score that depends on the document alone, worked out from counts where a
search reads a term; a term's weight, which depends on its document frequency,
multiplies it.  A search adds the postings of one term after the other into a
dense array of a shard's scores, selects the best with ``argpartition``, and
merges what the shards give.  No vocabulary is gathered: frequencies are
summed for the terms of a block of queries only.

A shard is a row of about a megabyte, so rows are written, read and handed to
Python a few at a time (``LARGE``, ``BATCH_BYTES``), however many a task has.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, fresh_path, materialize, small_batches

#: Bounds of a shard; a longer document is a shard of its own.
POSTINGS = 1 << 18
DOCS = 1 << 14
#: Bound on the bytes of terms and the number of queries of a block, which is held by the driver and each task.
BLOCK_BYTES = 4 << 20
BLOCK_QUERIES = 4096
_WORD = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
#: All bytes outside terms become spaces and A-Z small; bytes from 128 on only occur in characters beyond ASCII.
_FOLD = bytes(b if b in _WORD else 32 for b in range(256)).lower()
_SHARD = "ids binary, nulls binary, lengths binary, n_docs long, n_terms long, terms binary, starts binary, docs binary, tfs binary"
#: Bound on what Arrow hands to Python at once.
BATCH_BYTES = 8 << 20
#: Of files of shards: pages end after each row, and row groups at 4 MB, which is what writers and readers hold.
LARGE = {"parquet.block.size": str(4 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.enable.dictionary": "false"}


def terms_of(text: bytes | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of characters beyond ASCII; A-Z lower-cased."""
    return text.translate(_FOLD).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class LexicalIndex:
    """Written shards, and the two sums that scores need: documents with a term, and terms."""

    shards: DataFrame
    n_docs: int
    n_terms: int


class _Shard:
    def __init__(self) -> None:
        self.vocab: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.lengths, self.sizes = array("q"), array("q")
        self.terms, self.tfs = array("i"), array("i")

    def add(self, doc_id: int | None, found: list[bytes]) -> None:
        counts, vocab = Counter(found), self.vocab
        self.terms.extend([vocab.setdefault(t, len(vocab)) for t in counts])
        self.tfs.extend(counts.values())
        self.ids.append(doc_id)
        self.lengths.append(len(found))
        self.sizes.append(len(counts))

    def full(self) -> bool:
        return len(self.terms) >= POSTINGS or len(self.ids) >= DOCS

    def row(self) -> dict:
        names = sorted(self.vocab)
        place = np.empty(len(names), np.int32)
        place[[self.vocab[t] for t in names]] = np.arange(len(names), dtype=np.int32)
        term = place[np.frombuffer(self.terms, np.int32)]
        order = np.argsort(term, kind="stable")
        doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.frombuffer(self.sizes, np.int64))
        starts = np.searchsorted(term[order], np.arange(len(names) + 1)).astype(np.int32)
        return {
            "ids": np.array([x or 0 for x in self.ids], "<i8").tobytes(),
            "nulls": np.array([x is None for x in self.ids], np.uint8).tobytes(),
            "lengths": self.lengths.tobytes(),
            "n_docs": len(self.ids),
            "n_terms": sum(self.lengths),
            "terms": b" ".join(names),
            "starts": starts.tobytes(),
            "docs": _narrow(doc[order]),
            "tfs": _narrow(np.frombuffer(self.tfs, np.int32)[order]),
        }


def _narrow(x: np.ndarray) -> bytes:
    """x in the fewest of 1, 2 or 4 bytes a number."""
    return x.astype("<u1" if x.max() < 1 << 8 else "<u2" if x.max() < 1 << 16 else "<u4").tobytes()


def _wide(x: bytes, n: int) -> np.ndarray:
    """The n numbers of ``_narrow``."""
    return np.frombuffer(x, f"<u{len(x) // n}")


def _arrow(rows: list[dict], like: str) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "long": pa.int64()}
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, kinds[t]) for n, t in (x.split() for x in like.split(", "))]))


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = _Shard()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if found := terms_of(text.as_py()):
                shard.add(doc_id, found)
                if shard.full():
                    yield _arrow([shard.row()], _SHARD)
                    shard = _Shard()
    if shard.ids:
        yield _arrow([shard.row()], _SHARD)


def build_index(docs: DataFrame) -> LexicalIndex:
    """An index of every row of docs (doc_id, text), written to the shared folder.

    Null and empty texts, and those without a term, are in no shard and count
    nowhere.  Repeated rows are documents of their own; null ids are kept.
    """
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    with small_batches(docs.sparkSession, BATCH_BYTES):
        shards = materialize(arrow_map(raw, _build, _SHARD), "lexical-shards", **LARGE)
    n_docs, n_terms = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    return LexicalIndex(shards, n_docs, n_terms)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest positive scores; of equal ones those of least id, whatever the order of either."""
    found = np.flatnonzero(scores > 0)
    if len(found) > k:
        s = scores[found]
        floor = s[np.argpartition(s, len(s) - k)[len(s) - k]]
        over, even = found[s > floor], found[s == floor]
        found = np.concatenate([over, even[np.argsort(ids[even], kind="stable")[: k - len(over)]]])
    return found


def _frequencies(wanted: frozenset[bytes]):
    def run(batches):
        total: Counter[bytes] = Counter()
        for batch in batches:
            for terms, starts in zip(batch.column(0), batch.column(1)):
                starts = np.frombuffer(starts.as_py(), np.int32)
                for i, t in enumerate(terms.as_py().split(b" ")):
                    if t in wanted:
                        total[t] += int(starts[i + 1] - starts[i])
        if total:
            yield pa.record_batch([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["term", "df"])

    return run


def _search(queries: list[tuple[int, list[tuple[bytes, int]]]], weights: dict[bytes, int], k: int, n_docs: int, n_terms: int):
    """queries: number, and terms with their repeats.  n_docs, n_terms: of the index.  Ids sort last where they are null."""
    last = np.iinfo(np.int64).max

    def run(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                r = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
                ids, nulls = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["nulls"], np.uint8) > 0
                starts = np.frombuffer(r["starts"], np.int32)
                docs, tfs = _wide(r["docs"], starts[-1]), _wide(r["tfs"], starts[-1])
                m = 12 * (75 + (25 * np.frombuffer(r["lengths"], np.int64) * n_docs) // n_terms)
                found = {}
                for i, t in enumerate(r["terms"].split(b" ")):
                    if t in weights:
                        at, tf = docs[starts[i] : starts[i + 1]].astype(np.int64), tfs[starts[i] : starts[i + 1]].astype(np.int64)
                        found[t] = at, (1_000_000_000 * tf) // (1000 * tf + m[at]) * weights[t]
                keys = np.where(nulls, last, ids)
                for q, terms in queries:
                    scores = np.zeros(len(ids), np.int64)
                    for t, n in terms:
                        if t in found:
                            at, gain = found[t]
                            scores[at] += gain if n == 1 else gain * n
                    if not len(at := best(scores, keys, k)):
                        continue
                    new = (scores[at], keys[at], nulls[at])
                    if q in held:
                        new = tuple(np.concatenate(x) for x in zip(held[q], new))
                        keep = best(new[0], new[1], k)
                        new = tuple(x[keep] for x in new)
                    held[q] = new
        for q, (score, key, null) in held.items():
            cols = [pa.array(np.full(len(score), q)), pa.array(key, mask=null), pa.array(score)]
            yield pa.record_batch(cols, names=["q", "doc_id", "score"])

    return run


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [Counter(terms_of(t.as_py())) for t in batch.column(1)]
        cols = [batch.column(0), pa.array([b" ".join(c) for c in counts], pa.binary()), pa.array([list(c.values()) for c in counts], pa.list_(pa.int64()))]
        yield pa.record_batch(cols, names=["q", "terms", "counts"])


def _blocks(queries: DataFrame) -> Iterator[list[tuple[int, list[tuple[bytes, int]]]]]:
    block, held = [], 0
    for r in queries.where(F.length("terms") > 0).toLocalIterator():
        terms = bytes(r["terms"])
        if block and (held + len(terms) > BLOCK_BYTES or len(block) == BLOCK_QUERIES):
            yield block
            block, held = [], 0
        block.append((r["q"], list(zip(terms.split(b" "), r["counts"]))))
        held += len(terms)
    if block:
        yield block


def search(index: LexicalIndex, items: DataFrame, k: int = 20) -> DataFrame:
    """The k best documents of each row of items (item_id, text): item_id, rank, doc_id, score.

    Ranks run from 1; equal scores go by ascending doc_id, null ids last, and
    documents of score 0 aren't listed.  Rows of one item_id are queries of
    their own, each with its ranks; null and empty texts, and an empty index,
    give no rows.  Queries go over all shards in blocks of bounded size.
    """
    spark = items.sparkSession
    numbered = materialize(items.select(F.col("item_id"), F.col("text").cast("binary").alias("text")).withColumn("q", F.monotonically_increasing_id()), "lexical-items")
    queries = materialize(arrow_map(numbered.select("q", "text"), _query_terms, "q long, terms binary, counts array<long>"), "lexical-queries")
    path, schema = fresh_path(spark, "lexical-found"), "q long, doc_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for block in _blocks(queries):
        wanted = frozenset(t for _, terms in block for t, _ in terms)
        with small_batches(spark, BATCH_BYTES):
            df = arrow_map(index.shards.select("terms", "starts"), _frequencies(wanted), "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
            weights = {bytes(r["term"]): weight(index.n_docs, r["df"]) for r in df.collect()}
            arrow_map(index.shards, _search(block, weights, k, index.n_docs, index.n_terms), schema).write.mode("append").parquet(path)
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = spark.read.schema(schema).parquet(path).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(numbered.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")
