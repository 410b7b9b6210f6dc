"""Substring deduplication by relative Lempel-Ziv parsing.

A passage of ``size`` words that already stands in a document of smaller id is
a duplicate span.  Every window of that many words has an anchor: of its runs
of ``gram`` words the one of least hash.  Neighbouring windows share an
anchor, so a text falls into segments, one an anchor's place, of some 67 words
each; equal windows lie at the same place of segments that share an anchor.

Equal segments are one content; the id of the first document that has it is
found by an aggregate, and all later ones lose the whole of it.  What is left
are anchors around which texts differ.  The contents of such an anchor make an
indexed reference block: in ascending order of their first document, each is
parsed greedily into the longest factors that the block's earlier contents
hold; factors of ``size`` words or more are duplicate spans, and windows across
a factor's end are looked up from there.  Anchors with very many contents, as
at the ends of a passage that many documents share, are split into windows,
each a reference of its own that an aggregate joins.

Only segments around shared anchors are ever cut out of a text, one for each
content.  Anchors and contents are 64-bit hashes, windows of split anchors
128-bit ones; factors are compared word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, materialize

#: Contents of an anchor beyond which its windows go by hash.
SPLIT = 256
#: Bound on remembered words of a worker.
WORDS = 1 << 18
_BASE = 0x9E3779B97F4A7C15


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = _Hashes()
_POWERS: dict[int, np.ndarray] = {}


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of anything but the ASCII white space 0x20 and 0x09 to 0x0D, as they stand."""
    return text.split() if text else []


def _powers(base: int, n: int) -> np.ndarray:
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        steps = np.full(max(n, 1 << 14), base, np.uint64)
        steps[0] = 1
        held = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return held[:n]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0xBF58476D1CE4E5B9) + b * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xD6E8FEB86659FD93)


def gram_of(size: int) -> int:
    """Words of an anchor: the greatest power of two within a third of a window."""
    return 1 << max(0, (size // 3).bit_length() - 1)


def segments(words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, content, first window and number of windows of each segment; none of a text of fewer than size words."""
    if len(words) < size:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    w = np.array(list(map(_HASHES.__getitem__, words)), np.uint64)
    g, k, gram = w, 1, gram_of(size)
    while k < gram:
        g, k = _mixed(g[:-k], g[k:]), 2 * k
    least = np.lib.stride_tricks.sliding_window_view(g, size - gram + 1).argmin(axis=1) + np.arange(len(w) - size + 1)
    lo = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    n = np.diff(np.append(lo, len(least)))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * _powers(_BASE, len(w)), dtype=np.uint64)])
    content = (sums[lo + n + size - 1] - sums[lo]) * _powers(pow(_BASE, -1, 1 << 64), len(w))[lo]
    return g[least[lo]], _mixed(content, n.astype(np.uint64)), lo, n


def factors(contents: list[tuple[int, list[bytes]]], size: int) -> list[list[tuple[int, int]]]:
    """For each (first document, words), in ascending order of documents, the spans of its factors of size or more words.

    A factor is the longest run of words, from where it begins, that the first
    place of its first window in contents of smaller documents goes on with.
    The next one is sought from the first window that reaches over its end.
    """
    index: dict[tuple[bytes, ...], tuple[list[bytes], int]] = {}
    waiting: list[list[bytes]] = []
    out: list[list[tuple[int, int]]] = []
    for k, (doc, words) in enumerate(contents):
        if k and doc != contents[k - 1][0]:
            for held in waiting:
                for i in range(len(held) - size + 1):
                    index.setdefault(tuple(held[i : i + size]), (held, i))
            waiting = []
        waiting.append(words)
        spans, i = [], 0
        while i <= len(words) - size:
            found = index.get(tuple(words[i : i + size]))
            if found is None:
                i += 1
                continue
            there, at = found
            n = size
            while i + n < len(words) and at + n < len(there) and words[i + n] == there[at + n]:
                n += 1
            spans.append((i, i + n))
            i += n - size + 1
        out.append(spans)
    return out


def _meta(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [segments(words_of(t.as_py()), size) for t in batch.column(2)]
            many = np.array([len(f[0]) for f in found])
            if not many.sum():
                continue
            row = np.repeat(np.arange(batch.num_rows), many)
            anchor, content, lo, n = (np.concatenate(x) for x in zip(*found))
            ids = [batch.column(i).take(pa.array(row)) for i in range(2)]
            yield pa.record_batch([*ids, pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(lo, pa.int32()), pa.array(n, pa.int32())], names=["doc_id", "h", "anchor", "content", "lo", "n"])

    return run


def _cut(size: int):
    """Cuts wanted segments out of texts; of split anchors, the windows' hashes."""
    names = ["anchor", "content", "m", "words", "at", "window"]
    schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary()])))

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for m, text, wanted in zip(*(batch.column(i) for i in range(3))):
                m, words = m.as_py(), words_of(text.as_py())
                for r in wanted.as_py():
                    own = words[r["lo"] : r["lo"] + r["n"] + size - 1]
                    if not r["split"]:
                        out.append((r["anchor"], r["content"], m, b" ".join(own), None, None))
                        continue
                    out += [(r["anchor"], r["content"], m, None, i, hashlib.md5(b" ".join(own[i : i + size])).digest()) for i in range(r["n"])]
            for at in range(0, len(out), 50_000):
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*out[at : at + 50_000]), schema)], schema=schema)

    return run


def _parsed(size: int):
    """Parses the contents of each anchor; rows come sorted by anchor and first document."""

    def run(batches):
        anchor, held, out = None, [], []

        def close():
            spans = factors([(m, words) for _, m, words in held], size)
            out.extend((anchor, content, [{"lo": a, "hi": b} for a, b in s]) for (content, *_), s in zip(held, spans) if s)

        def batch_of(rows):
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))]
            return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=["anchor", "content", "spans"])

        for batch in batches:
            for a, content, m, words in zip(*(batch.column(i) for i in range(4))):
                if (a := a.as_py()) != anchor:
                    close()
                    anchor, held = a, []
                    if len(out) >= 10_000:
                        yield batch_of(out)
                        out.clear()
                held.append((content.as_py(), m.as_py(), words.as_py().split(b" ")))
        close()
        if out:
            yield batch_of(out)

    return run


def _kept(text_at: int, spans_at: int):
    def run(batches):
        for batch in batches:
            cols: list[list] = [[], [], [], []]
            for text, spans in zip(batch.column(text_at), batch.column(spans_at)):
                words = words_of(text.as_py())
                merged: list[dict] = []
                for s in sorted(spans.as_py() or [], key=lambda s: s["lo"]):
                    if merged and s["lo"] <= merged[-1]["end"]:
                        merged[-1]["end"] = max(merged[-1]["end"], s["hi"])
                    else:
                        merged.append({"start": s["lo"], "end": s["hi"]})
                kept, at = [], 0
                for s in merged:
                    kept += words[at : s["start"]]
                    at = s["end"]
                kept += words[at:]
                for c, x in zip(cols, (len(words), len(words) - len(kept), b" ".join(kept).decode(), merged)):
                    c.append(x)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            own = [batch.column(i) for i in range(batch.num_columns) if i not in (text_at, spans_at)]
            own_names = [n for i, n in enumerate(batch.schema.names) if i not in (text_at, spans_at)]
            yield pa.record_batch([*own, *[pa.array(c, t) for c, t in zip(cols, kinds)]], names=[*own_names, *MADE])

    return run


MADE = ["n_words", "n_removed", "kept", "removed"]


def _first_places(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(segments' places, contents that may repeat: anchor, content, m, spans that older documents hold)."""
    meta = materialize(arrow_map(docs.where("doc_id is not null"), _meta(size), "doc_id long, h long, anchor long, content long, lo int, n int"), "segments")
    first = F.min(F.struct("doc_id", "h", "lo", "n")).alias("first")
    contents = materialize(meta.groupBy("anchor", "content").agg(first, F.max("doc_id").alias("last")), "contents")
    many = materialize(contents.groupBy("anchor").agg(F.count("*").alias("of")).where("of > 1"), "anchors")
    contents = contents.join(many, "anchor", "left").where(F.col("of").isNotNull() | (F.col("last") > F.col("first.doc_id")))
    contents = materialize(contents, "shared")
    wanted = contents.where("of is not null").select("first.doc_id", "first.h", F.struct("anchor", "content", "first.lo", "first.n", (F.col("of") > SPLIT).alias("split")).alias("one"))
    wanted = materialize(wanted.groupBy("doc_id", "h").agg(F.collect_list("one").alias("wanted")), "wanted")
    texts = docs.join(wanted, ["doc_id", "h"]).select("doc_id", "text", "wanted")
    cut = materialize(arrow_map(texts, _cut(size), "anchor long, content long, m long, words binary, at int, window binary"), "cut")
    # Rows under one id with one text cut the same segments.
    whole = cut.where("at is null").groupBy("anchor", "content", "m").agg(F.first("words").alias("words"))
    whole = whole.select("anchor", "content", "m", "words").repartition("anchor").sortWithinPartitions("anchor", "m")
    spans = "array<struct<lo:int,hi:int>>"
    parsed = arrow_map(whole, _parsed(size), f"anchor long, content long, spans {spans}")
    windows = cut.where("at is not null").select("anchor", "content", "m", "at", "window")
    oldest = materialize(windows.groupBy("window").agg(F.min("m").alias("oldest")), "windows")
    again = windows.join(oldest, "window").where("oldest < m").groupBy("anchor", "content").agg(F.collect_set(F.struct(F.col("at").alias("lo"), (F.col("at") + size).alias("hi"))).alias("spans"))
    old = materialize(parsed.unionByName(again), "factors")
    shared = contents.select("anchor", "content", F.col("first.doc_id").alias("m")).join(old, ["anchor", "content"], "left")
    return meta, materialize(shared, "sources")


def remove_substrings(docs: DataFrame, size: int = 50) -> DataFrame:
    """docs without its text, with n_words, n_removed, kept and removed.

    A word goes if it lies in a window of ``size`` consecutive words that also
    starts in a document of smaller doc_id.  All windows are judged on the
    input.  kept holds the words that stay, joined by single spaces; removed
    the spans in words (start, end).  Null and empty texts have no words, and
    nothing goes from texts of fewer than size words.  Rows of null id lose
    nothing and are no source; rows of one id aren't sources of each other.
    Repeated rows get equal results.  Columns of docs other than text stay, but
    for the names above, which are replaced; an empty table gives none.
    """
    docs = docs.drop(*MADE)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    meta, shared = _first_places(keyed, size)
    later = F.array(F.struct(F.col("lo"), (F.col("lo") + F.col("n") + (size - 1)).alias("hi")))
    own = F.transform("spans", lambda s: F.struct((s["lo"] + F.col("lo")).alias("lo"), (s["hi"] + F.col("lo")).alias("hi")))
    gone = meta.join(shared, ["anchor", "content"]).select("doc_id", "h", F.explode(F.when(F.col("doc_id") > F.col("m"), later).otherwise(own)).alias("span"))
    gone = materialize(gone.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_set("span").alias("_spans")), "gone")
    on = (F.col("doc_id").cast("long") == F.col("_id")) & (F.xxhash64("text") == F.col("_h"))
    out = docs.join(gone, on, "left").drop("_id", "_h").withColumn("text", F.col("text").cast("binary"))
    at = [out.columns.index(c) for c in ("text", "_spans")]
    stays = [f for f in out.schema.fields if f.name not in ("text", "_spans")]
    kinds = [T.LongType(), T.LongType(), T.StringType(), T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))]
    return arrow_map(out, _kept(*at), T.StructType([*stays, *[T.StructField(n, t) for n, t in zip(MADE, kinds)]]))
