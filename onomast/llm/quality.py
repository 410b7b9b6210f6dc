"""Quality classifier: a linear hinge-loss model over Naive-Bayes-scaled n-gram indicators.

Features are indicators of a text's byte n-grams of one to ``ORDER`` bytes,
hashed to 2**BITS slots, and of n-grams of words by their pattern of repeats.  Each is scaled by its class log-count ratio; the
scaled vectors, at unit length, go to a support vector machine with hinge loss
and an L2 penalty, solved by dual coordinate descent.  A sigmoid over
out-of-fold margins turns a margin into a score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, crc_mod

BITS = 18
ORDER = 3
#: The first slot of patterns of repeated words; single bytes have the slots below it.
PATTERN = 256
#: Bound on the labelled rows that a model is fitted on, halved between the classes where both have enough.
MAX_TRAIN = 6_000


def ngrams(text: str | None, flags: np.ndarray) -> np.ndarray:
    """The sorted slots of a text's n-grams.  flags: 2**BITS zero bytes to work on."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    flags[b] = 1
    code = b
    for n in range(2, ORDER + 1):
        if len(b) < n:
            break
        code = code[:-1] * np.uint32(257) + b[n - 1 :] + np.uint32(1)
        flags[(code * np.uint32(2654435761)) >> np.uint32(32 - BITS)] = 1
    flags[[PATTERN + x for x in repeats(text or "")]] = 1
    found = np.flatnonzero(flags).astype(np.int32)
    flags[found] = 0
    return found


def repeats(text: str) -> list[int]:
    """n-grams that show as patterns, whatever their words: runs of 2, 3, 5 and 9
    equal words (0 to 3), and tenths of distinct words among all (4 to 14)."""
    words = text.split()
    if not words:
        return []
    same = bytes(map(eq, words, words[1:]))
    return [k for k, n in enumerate((1, 2, 4, 8)) if b"\x01" * n in same] + [4 + 10 * len(set(words)) // len(words)]


def dual_descent(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dim: int, c: float, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """min |w|^2 / 2 + c * sum of hinge losses, over sparse rows (slots, values) and y in {-1, 1}."""
    w, alpha = np.zeros(dim), np.zeros(len(y))
    square = np.array([float(v @ v) for _, v in x])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(y)):
            if square[i] == 0:
                continue
            at, v = x[i]
            slope = y[i] * float(w[at] @ v) - 1
            bounded = min(slope, 0.0) if alpha[i] == 0 else max(slope, 0.0) if alpha[i] == c else slope
            if bounded == 0:
                continue
            worst = max(worst, abs(bounded))
            new = min(max(alpha[i] - slope / square[i], 0.0), c)
            w[at] += (new - alpha[i]) * y[i] * v
            alpha[i] = new
        if worst < 1e-3:
            break
    return w


def sigmoid_fit(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * margin + b))), by Newton's method on smoothed labels."""
    n1 = float(label.sum())
    n0 = len(label) - n1
    t = np.where(label > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        h = p * (1 - p) + 1e-9
        g = np.array([((p - t) * margin).sum(), (p - t).sum()])
        m = np.array([[(h * margin * margin).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(m, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(a), float(b)


@dataclass
class QualityModel:
    weights: np.ndarray  # slot -> scaled weight
    ratio: np.ndarray  # slot -> class log-count ratio
    slope: float
    shift: float

    def margin(self, slots: np.ndarray) -> float:
        """A text without n-grams has margin 0."""
        r = self.ratio[slots]
        size = math.sqrt(float(r @ r))
        return float(self.weights[slots].sum()) / size if size else 0.0

    def score(self, slots: np.ndarray) -> float:
        z = self.slope * self.margin(slots) + self.shift
        return 1 / (1 + math.exp(-min(max(z, -30.0), 30.0)))


def _train(rows: list[np.ndarray], label: np.ndarray, c: float) -> tuple[np.ndarray, np.ndarray]:
    dim = 1 << BITS
    p, q = np.ones(dim), np.ones(dim)
    for at, y in zip(rows, label):
        (p if y else q)[at] += 1
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    x = []
    for at in rows:
        v = ratio[at]
        size = math.sqrt(float(v @ v))
        x.append((at, v / size if size else v))
    w = dual_descent(x, np.where(label > 0, 1.0, -1.0), dim, c)
    return w * ratio, ratio


def fit(rows: list[np.ndarray], label: np.ndarray, c: float = 8.0, folds: int = 3) -> QualityModel:
    """Fits a model to slot lists and labels 0 or 1.  With one class only, or none, it scores that class's share everywhere."""
    dim = 1 << BITS
    if len(set(label.tolist())) < 2:
        share = (float(label.sum()) + 1) / (len(label) + 2)
        return QualityModel(np.zeros(dim), np.zeros(dim), 0.0, math.log(share / (1 - share)))
    margin = np.zeros(len(label))
    fold = np.arange(len(label)) % folds
    for k in range(folds):
        w, r = _train([x for x, f in zip(rows, fold) if f != k], label[fold != k], c)
        m = QualityModel(w, r, 1.0, 0.0)
        for i in np.flatnonzero(fold == k):
            margin[i] = m.margin(rows[i])
    slope, shift = sigmoid_fit(margin, label)
    w, r = _train(rows, label, c)
    return QualityModel(w, r, slope, shift)


def training_rows(docs: DataFrame, labels: DataFrame, column: str, held: tuple[int, int], most: int) -> DataFrame:
    """(doc_id, text, label): at most ``most`` labelled rows, half of them of
    either class if there are as many, chosen by a hash of the id; none whose
    crc32 falls on the held-out remainder; held is (modulus, remainder)."""
    y = F.col(column).cast("int")
    known = labels.where(y.isin(0, 1) & (crc_mod(F.col("doc_id"), held[0]) != held[1])).groupBy("doc_id").agg(F.max(y).alias("label"))
    chosen = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2) for k in (0, 1)]
    picked = F.broadcast(chosen[0].unionByName(chosen[1]))  # bounded by ``most``
    return docs.select("doc_id", "text").join(picked, "doc_id")


def train_quality(docs: DataFrame, labels: DataFrame, held: tuple[int, int] = (3, 1), most: int = MAX_TRAIN) -> QualityModel:
    def run(batches):
        flags = np.zeros(1 << BITS, np.uint8)
        for batch in batches:
            at = [ngrams(t, flags).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(at, pa.binary()), batch.column(2)], names=["doc_id", "at", "label"])

    rows = training_rows(docs, labels, "quality", held, most)
    # Distinct, as copies of a row teach nothing new, and sorted, as results must not hang on the order of tasks.
    got = sorted({(r["label"], bytes(r["at"])) for r in arrow_map(rows.select("doc_id", "text", "label"), run, "doc_id long, at binary, label int").toLocalIterator()}, key=lambda r: hash_order(r[1]))
    return fit([np.frombuffer(r[1], np.int32) for r in got], np.array([r[0] for r in got], dtype=np.int64))


def hash_order(x: bytes) -> tuple[int, bytes]:
    import zlib

    return zlib.crc32(x), x


def score_quality(docs: DataFrame, model: QualityModel, keep: list[str] | None = None) -> DataFrame:
    """Rows of docs (columns ``keep``, or doc_id) with quality_score in [0, 1].
    Null counts as empty; an empty text gets the score of margin 0; texts are
    read whole; repeated rows score alike; an empty table gives an empty one."""
    keep = [c for c in (keep or ["doc_id"]) if c != "quality_score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of 2**BITS numbers

    def run(batches):
        flags, m = np.zeros(1 << BITS, np.uint8), shared.value
        for batch in batches:
            score = [m.score(ngrams(t, flags)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            cols = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.record_batch([*cols, pa.array(score, pa.float64())], names=[*keep, "quality_score"])

    rows = docs.select(*keep, F.col("text").alias("_text"))
    schema = docs.select(*keep).schema.add("quality_score", "double")
    return arrow_map(rows, run, schema)
