"""Language identification by prediction with partial matching.

Per language, byte contexts of up to ``ORDER`` bytes form a tree with counts.
A byte is coded in the longest context known; where it wasn't seen there, an
escape (method C: distinct bytes over all counts and distinct bytes) leads to
the context one byte shorter, with the bytes already excluded.  Counts are
frozen after learning, so a byte's exact code length depends on the bytes before it
alone, and each language's is a table over (context, byte).  A text goes to the
language that codes it shortest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, crc_mod
from .tokens import slices

ORDER = 3
#: Bound on the bytes learned per language, of whole texts in the order of a hash of their ids.
TRAIN_BYTES = 1_000_000
TRAIN_DOCS = 1_000
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 65 or 90 < b < 97 or 122 < b < 128 else b for b in range(256))


def fold(text: str) -> bytes:
    """UTF-8 bytes with A-Z lower-cased and each run of other ASCII that is no letter as one space, one at either end."""
    return b" " + b" ".join(text.encode("utf-8", "surrogatepass").translate(_FOLD).split()) + b" "


@dataclass
class Ppm:
    langs: list[str]
    symbol: np.ndarray  # byte -> symbol
    size: int
    context: np.ndarray  # ORDER symbols as a number -> row of costs
    costs: np.ndarray  # (rows, size * languages): bits

    def lengths(self, text: str) -> np.ndarray:
        """Bits that each language needs for a text."""
        s = self.symbol[np.frombuffer(fold(text), np.uint8)]
        total = np.zeros(len(self.langs))
        for at in range(0, len(s), 1 << 18):
            part = s[max(0, at - ORDER) : at + (1 << 18)]
            if at == 0:
                part = np.concatenate([np.full(ORDER, self.symbol[32]), part])
            code = part[: len(part) - ORDER].astype(np.int32)
            for k in range(1, ORDER):
                code = code * self.size + part[k : len(part) - ORDER + k]
            cell = self.context[code].astype(np.int64) * self.size + part[ORDER:]
            total += self.costs[cell].sum(axis=0, dtype=np.float64)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not LETTER.search(text):
            return UNKNOWN, 0.0
        bits = self.lengths(text)
        best = int(np.argmin(bits))  # ties: the language that sorts first
        return self.langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())


def _counts(texts: list[np.ndarray], size: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of order + 1 symbols as numbers, and how often each occurs."""
    codes = []
    for s in texts:
        code = s[: len(s) - order].astype(np.int64)
        for k in range(1, order + 1):
            code = code * size + s[k : len(s) - order + k]
        codes.append(code)
    return np.unique(np.concatenate(codes) if codes else np.zeros(0, np.int64), return_counts=True)


def learn(samples: dict[str, list[str]]) -> Ppm:
    """Learns from texts by language."""
    langs = sorted(samples)
    folded = {g: [np.frombuffer(fold(t), np.uint8) for t in samples[g]] for g in langs}
    # Each byte that was learned is a symbol; the last stands for the others, which no context knows.
    seen = sum((np.bincount(b, minlength=256) for g in langs for b in folded[g]), np.zeros(256, np.int64))
    seen[32] += 1
    order = np.flatnonzero(seen).tolist()
    size = len(order) + 1
    symbol = np.full(256, size - 1, np.uint16)
    symbol[order] = np.arange(len(order))
    space = symbol[32]
    tables, known = [], []
    for g in langs:
        texts = [np.concatenate([np.full(ORDER, space), symbol[b]]) for b in folded[g]]
        # Order 0 escapes to all symbols evenly.
        p = np.full((1, size), 1 / size)
        rows = {0: 0}
        for k in range(ORDER + 1):
            code, n = _counts(texts, size, k)
            contexts, inverse = np.unique(code // size, return_inverse=True)
            table = np.zeros((len(contexts), size))
            table[inverse, code % size] = n
            if k:
                shorter = contexts % size ** (k - 1)
                lower = p[np.array([rows[c] for c in shorter.tolist()], dtype=np.int64)] if len(contexts) else p[:0]
            else:
                lower = np.repeat(p, len(contexts), axis=0)
            total, distinct = table.sum(axis=1, keepdims=True), (table > 0).sum(axis=1, keepdims=True)
            rest = np.where(table > 0, 0, lower)
            mass = rest.sum(axis=1, keepdims=True)
            full = mass <= 1e-15  # nothing is left to escape to
            made = np.where(table > 0, table / np.where(full, total, total + distinct), distinct / (total + distinct) * rest / np.where(full, 1, mass))
            tables.append((g, k, contexts, made))
            p, rows = made, {c: i for i, c in enumerate(contexts.tolist())}
        known.append(contexts)
    union = np.unique(np.concatenate(known)) if known else np.zeros(0, np.int64)
    by = {(g, k): (c, m) for g, k, c, m in tables}
    # Rows for contexts of full length that some language knows, then for every pair of symbols.
    pairs = np.arange(size**2)
    costs = np.zeros((len(union) + len(pairs), size, len(langs)), np.float32)
    for j, g in enumerate(langs):

        def dist(contexts: np.ndarray, k: int) -> np.ndarray:
            """The distribution in contexts of k symbols, through the longest known end of each."""
            if k == 0:
                c, m = by[g, 0]
                base = m[0] if len(m) else np.full(size, 1 / size)
                return np.repeat(base[None], len(contexts), axis=0)
            c, m = by[g, k]
            at = np.searchsorted(c, contexts)
            hit = (at < len(c)) & (c[np.minimum(at, max(0, len(c) - 1))] == contexts) if len(c) else np.zeros(len(contexts), bool)
            out = np.empty((len(contexts), size))
            out[hit] = m[at[hit]]
            out[~hit] = dist(contexts[~hit] % size ** (k - 1), k - 1)
            return out

        costs[: len(union), :, j] = -np.log2(np.maximum(dist(union, ORDER), 1e-30))
        costs[len(union) :, :, j] = -np.log2(np.maximum(dist(pairs, 2), 1e-30))
    context = (len(union) + np.arange(size**ORDER) % size**2).astype(np.int32)
    context[union] = np.arange(len(union))
    return Ppm(langs, symbol, size, context, costs.reshape(len(costs) * size, len(langs)))


def train_langid(docs: DataFrame, held: tuple[int, int] = (3, 1)) -> Ppm:
    """Learns from text and lang of documents off the held-out remainder.

    Null ids, texts and languages are left out; of a language, whole texts in
    the order of a hash of their ids, up to TRAIN_DOCS and until TRAIN_BYTES
    are reached; copies of a text under one language count once; ties of the
    hash go by doc_id; an empty table learns nothing.  Other columns aren't read.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), held[0]) != held[1]))
    # The least hashes of each language, of all languages in one scan; each task passes on no more than the bound.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    picked = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"), F.length("text").alias("n")).withColumn("place", place).where(F.col("place") <= TRAIN_DOCS)
    rows = picked.collect()  # TRAIN_DOCS ids a language
    if not rows:
        return learn({})
    chosen, spent = [], {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"], r["doc_id"])):
        if spent.get(r["lang"], 0) < TRAIN_BYTES:
            spent[r["lang"]] = spent.get(r["lang"], 0) + r["n"]
            chosen.append((r["doc_id"], r["lang"]))
    ids = docs.sparkSession.createDataFrame(chosen, known.select("doc_id", "lang").schema)
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"])  # bounded by TRAIN_DOCS
    samples: dict[str, list[str]] = {}
    for r in sorted({(r["lang"], r["text"]) for r in rows.toLocalIterator()}):
        samples.setdefault(r[0], []).append(r[1])
    return learn(samples)


def identify(docs: DataFrame, model: Ppm, keep: list[str] | None = None) -> DataFrame:
    """Rows of docs (columns ``keep``, or doc_id) with lang_pred and lang_score.

    Null texts and texts without a letter are ``und`` with score 0; a tie goes
    to the language that sorts first; texts are read whole; repeated rows are
    judged alike; an empty table gives an empty one.
    """
    keep = [c for c in (keep or ["doc_id"]) if c not in ("lang_pred", "lang_score")]
    # As many rows as contexts were learned, so bounded by TRAIN_BYTES a language; a column for each byte and language.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for b in slices(batch):
                got = [m.predict(t) for t in b.column(b.num_columns - 1).to_pylist()]
                made = [pa.array([g for g, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())]
                yield pa.record_batch([*b.columns[:-1], *made], names=[*keep, "lang_pred", "lang_score"])

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("lang_score", "double")
    return arrow_map(docs.select(*keep, F.col("text").alias("_text")), run, schema)
