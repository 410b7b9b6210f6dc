"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text are densities of lexicon words (a short fixed list,
and stems learned from labelled texts), their nearness to words of the second
person, capitals, punctuation and obfuscated spellings.  The trees fit the
logistic loss on histograms; pooled adjacent violators over out-of-fold scores
turn scores into probabilities.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .quality import training_rows
from .tokens import slices

#: Bounds on what a model is learned from: labelled rows, half of either class where there are as many, and bytes of their texts.
MAX_TRAIN = 4_000
MAX_BYTES = 64_000_000
# Common insults, and pronouns of the second person in English, French, German and Spanish.
INSULTS = frozenset("idiot moron stupid dumb loser scum trash clown pathetic worthless disgusting fool jerk creep liar coward".split())
SECOND = frozenset("you your yours yourself u ya tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch usted ustedes tú ti tus vosotros".split())
NEAR = 6
STEMS = (4, 5, 6, 7)
MAX_STEMS = 200
OBFUSCATED = regex.compile(r"\b[^\W\d_]+[*@$#0134]+[^\W\d_]+\b|\b(?:[^\W\d_][.\-*_ ]){3,}[^\W\d_]\b")
WORD = regex.compile(r"[^\W\d_]+")
LEET = str.maketrans("@$0134", "asoiea")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def stems_of(word: str) -> list[str]:
    return [word[:k] for k in STEMS if len(word) >= k]


def features(text: str | None, stems: dict[str, float]) -> np.ndarray:
    """Densities are per hundred words or characters; an empty text has zeros."""
    text = text or ""
    words = words_of(text)
    n = len(words)
    fixed, learned, weight, distinct = [], [], 0.0, set()
    for i, w in enumerate(words):
        if w in INSULTS:
            fixed.append(i)
        found = [s for s in stems_of(w) if s in stems]
        if found:
            learned.append(i)
            weight += max(stems[s] for s in found)
            distinct.add(w)
    near = 0
    hits = sorted({*fixed, *learned})
    if hits:
        second = np.array([i for i, w in enumerate(words) if w in SECOND], dtype=np.int64)
        if len(second):
            at = np.searchsorted(second, hits)
            before = np.abs(second[np.maximum(at - 1, 0)] - hits)
            after = np.abs(second[np.minimum(at, len(second) - 1)] - hits)
            near = int((np.minimum(before, after) <= NEAR).sum())
    odd = OBFUSCATED.findall(text) if any(c in text for c in "*@$#0134._-") else []
    hidden = sum(w.translate(LEET).replace("*", "").lower() in INSULTS for w in odd)
    b = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    chars, per = max(1, int(b.sum())), 100 / max(1, n)
    letters = max(1, int(b[65:91].sum() + b[97:123].sum()))
    return np.array(
        [
            len(fixed) * per,
            len(learned) * per,
            weight * per,
            math.log1p(len(learned)),
            math.log1p(len(fixed) + hidden),
            len(distinct),
            near * per,
            near / max(1, len(hits)),
            b[65:91].sum() / letters,
            b[33] * 100 / chars,
            b[63] * 100 / chars,
            (b[35:39].sum() + b[42] + b[64]) * 100 / chars,
            (b[44] + b[46] + b[58] + b[59]) * 100 / chars,
            len(odd) * per,
            math.log1p(n),
        ]
    )


def learn_stems(counts: list[tuple[Counter, Counter]], totals: tuple[int, int]) -> dict[str, float]:
    """Stems whose share of documents, with one or with two uses at least, is far greater among toxic ones; weighted by log odds.
    counts: of 1 and of 2 uses, (clean, toxic)."""
    best: dict[str, tuple[float, float]] = {}
    for clean, toxic in counts:
        for s, n1 in toxic.items():
            if n1 < 5:
                continue
            p1, p0 = (n1 + 0.5) / (totals[1] + 1), (clean.get(s, 0) + 0.5) / (totals[0] + 1)
            p = (p1 * totals[1] + p0 * totals[0]) / max(1, sum(totals))
            z = (p1 - p0) / math.sqrt(p * (1 - p) * (1 / max(1, totals[0]) + 1 / max(1, totals[1])) + 1e-12)
            odds = math.log(p1 / p0)
            if z > 4 and odds > 1.4 and z > best.get(s, (0, 0))[0]:
                best[s] = (z, odds)
    top = sorted(best.items(), key=lambda x: (-x[1][0], x[0]))[:MAX_STEMS]
    return {s: odds for s, (_, odds) in top}


@dataclass
class Boosted:
    """Trees as flat arrays: feature (-1: leaf), threshold, value; children of i at 2 i + 1 and 2 i + 2."""

    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                go = 2 * at + 1 + (x[rows, np.maximum(feature[at], 0)] > cut[at])
                at = np.where(inner, go, at)
            out += value[at]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 8.0) -> Boosted:
    """Logistic loss; splits on histograms of at most ``bins`` quantiles, least: hessian weight of a leaf."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    coded = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    share = float((weight * y).sum() / weight.sum())
    model = Boosted(math.log((share + 1e-6) / (1 - share + 1e-6)))
    raw = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = weight * (y - p), weight * p * (1 - p)
        size = 2 ** (depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        at = np.zeros(len(y), np.int64)
        for node in range(size):
            own = np.flatnonzero(at == node)
            if not len(own):
                continue
            gs, hs = g[own].sum(), h[own].sum()
            value[node] = rate * gs / (hs + 1)
            if node >= 2**depth - 1:
                continue
            gain, pick = 1e-6, None
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                gl = np.cumsum(np.bincount(coded[own, f], g[own], len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(coded[own, f], h[own], len(c) + 1))[:-1]
                score = np.where((hl >= least) & (hs - hl >= least), gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1), -1)
                k = int(np.argmax(score))
                if score[k] > gain:
                    gain, pick = float(score[k]), (f, k)
            if pick:
                feature[node], cut[node] = pick[0], cuts[pick[0]][pick[1]]
                at[own] = 2 * node + 1 + (x[own, pick[0]] > cut[node])
        model.trees.append((feature, cut, value))
        raw += Boosted(0.0, [model.trees[-1]]).raw(x)
    return model


def isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: middles of blocks, and their levels; between two middles the level is drawn straight."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # weight, weighted label, weighted score
    for i in order:
        blocks.append([weight[i], weight[i] * y[i], weight[i] * score[i]])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


@dataclass
class ToxicityModel:
    stems: dict[str, float]
    trees: Boosted
    at: np.ndarray
    level: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        raw = self.trees.raw(np.stack([features(t, self.stems) for t in texts]))
        # A hundredth of the tree's own score keeps an order within a level.
        return 0.99 * np.interp(raw, self.at, self.level) + 0.01 / (1 + np.exp(-raw))


def fit(rows: list[tuple[str, int]], weight: tuple[float, float] = (1.0, 1.0), folds: int = 3) -> ToxicityModel:
    """rows: (text, label); weight: of clean and of toxic rows.  With one class only, or none, its share is every score."""
    y = np.array([r[1] for r in rows], dtype=float)
    if len(set(y.tolist())) < 2:
        share = (float(y.sum()) + 1) / (len(y) + 2)
        return ToxicityModel({}, Boosted(), np.array([0.0]), np.array([share]))
    fold = np.arange(len(rows)) % folds
    made = [[[Counter(), Counter()] for _ in (1, 2)] for _ in range(folds)]
    for (text, label), k in zip(rows, fold):
        own = Counter(s for w in words_of(text or "") for s in stems_of(w))
        made[k][0][label].update(own.keys())
        made[k][1][label].update(s for s, n in own.items() if n > 1)

    def stems(without: int | None) -> dict[str, float]:
        use = [k for k in range(folds) if k != without]
        counts = [tuple(sum((made[k][t][c] for k in use), Counter()) for c in (0, 1)) for t in (0, 1)]
        inside = fold != (-1 if without is None else without)
        return learn_stems(counts, (int((inside & (y == 0)).sum()), int((inside & (y == 1)).sum())))

    # A row's features come from stems learned without it.
    x = np.zeros((len(rows), len(features("", {}))))
    for k in range(folds):
        own = stems(k)
        for i in np.flatnonzero(fold == k):
            x[i] = features(rows[i][0], own)
    w = np.where(y > 0, weight[1], weight[0])
    raw = np.zeros(len(y))
    for k in range(folds):
        raw[fold == k] = boost(x[fold != k], y[fold != k], w[fold != k]).raw(x[fold == k])
    at, level = isotonic(raw, y, w)
    return ToxicityModel(stems(None), boost(x, y, w), at, level)


def train_toxicity(docs: DataFrame, labels: DataFrame, held: tuple[int, int] = (4, 2), most: int = MAX_TRAIN, most_bytes: int = MAX_BYTES) -> ToxicityModel:
    """Learns from labelled rows off the held-out remainder.

    At most ``most`` rows, half of either class where there are as many, chosen
    by a hash of the id, and of these, in the order of that hash, whole texts
    until ``most_bytes`` are reached.  Null ids and labels other than 0 and 1
    are left out; a null text is empty; copies of a row count once; empty
    tables give a model that scores all alike.  Other columns aren't read.
    """
    from .common import crc_mod

    known = labels.where(F.col("toxic").isin(0, 1) & (crc_mod(F.col("doc_id"), held[0]) != held[1]))
    share = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    text = F.coalesce("text", F.lit(""))
    picked = training_rows(docs, labels, "toxic", held, most).select("doc_id", "label", text.alias("text"), F.xxhash64("doc_id").alias("h"), F.xxhash64(text).alias("t"), F.octet_length(text).alias("bytes"))
    # Sizes first, a few thousand numbers, so that which rows are read doesn't hang on the order of tasks.
    sizes = sorted({(r["h"], r["doc_id"], r["t"], r["bytes"]) for r in picked.select("h", "doc_id", "t", "bytes").collect()})
    total, last = 0, None
    for h, i, t, n in sizes:
        if total + n > most_bytes and last is not None:
            break
        total, last = total + n, (h, i, t)
    texts = {}
    if last is not None:
        upto = F.struct("h", F.col("doc_id").cast("long"), "t") <= F.struct(*(F.lit(x).cast("long") for x in last))
        for r in picked.where(upto).toLocalIterator():
            texts[r["h"], r["doc_id"], r["text"]] = r["label"]
    rows = [(k[2], texts[k]) for k in sorted(texts)]
    n = Counter(y for _, y in rows)
    weight = tuple(share.get(c, 0) / max(1, n[c]) for c in (0, 1))
    mean = sum(weight[y] for _, y in rows) / max(1, len(rows)) or 1.0
    return fit(rows, (weight[0] / mean, weight[1] / mean))


def score_toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str] | None = None) -> DataFrame:
    """Rows of docs (columns ``keep``, or doc_id) with toxicity in [0, 1].
    Null counts as empty; whole texts are read; repeated rows score alike; an empty table gives an empty one."""
    keep = [c for c in (keep or ["doc_id"]) if c != "toxicity"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_STEMS stems and a fixed number of trees

    def run(batches):
        m = shared.value
        for batch in batches:
            for b in slices(batch):
                s = m.scores(b.column(b.num_columns - 1).to_pylist())
                yield pa.record_batch([*b.columns[:-1], pa.array(s, pa.float64())], names=[*keep, "toxicity"])

    schema = docs.select(*keep).schema.add("toxicity", "double")
    return arrow_map(docs.select(*keep, F.col("text").alias("_text")), run, schema)
