"""Quality rules: gradient-boosted trees over document statistics, with monotonic constraints.

Statistics are taken of whole texts in one narrow pass. Trees are fitted with Newton steps of the logistic loss over
quantile bins of the statistics, to a sample of at most ``MAX_TRAIN`` labelled documents (those with the smallest
hashes of their ids). In ``MONOTONE`` a statistic has the sign that its effect on quality must keep: a split that
would break it is not taken, and the values below a split stay on their side of its middle.

The fitted trees are flattened into node arrays (feature, threshold, children, value); a block of documents walks
all trees at once, one level a step.

A document that fails the base rules (fewer than ``MIN_WORDS`` words, or over half of its words in three-word windows
that repeat) is rejected without the trees.

Nulls and corner cases: a null or empty text has no words and fails the base rules; rows that repeat a doc_id are
judged as rows of their own; labels that are null are left out, and of several labels of a document the lowest counts;
without labels of both kinds nothing but the base rules rejects. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, give_back

MIN_WORDS = 50
MAX_TRAIN = 20_000
TREES, DEPTH, RATE, BINS, L2, MIN_ROWS = 60, 4, 0.2, 32, 1.0, 10
THRESHOLD = 0.5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The statistics that the trees see, and the sign of their effect on quality (0: free).
MONOTONE = {
    "words": 0, "word_length": 0, "symbols_per_word": -1, "duplicate_lines": -1, "repeated_words": -1, "distinct_words": 0,
    "upper_share": 0, "digit_share": 0, "mark_share": -1, "words_per_line": 0, "short_words": 0, "long_words": 0,
}
SPACES, SYMBOLS, MARKS = b" \t\n\r\x0b\x0c", b"#*$%&|<>", b"!?"
UPPER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"


def _count(raw: bytes, of: bytes) -> int:
    return len(raw) - len(raw.translate(None, of))


def repeated_words(words: list[bytes], size: int = 3) -> tuple[int, int]:
    """Words that lie in a window of ``size`` words found twice or more, and the number of different words."""
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    if len(ids) < size + 1:
        return 0, len(known)
    key = ids[:len(ids) - size + 1]
    for k in range(1, size):
        key = key * len(known) + ids[k:len(ids) - size + 1 + k]
        if k < size - 1 and len(known) > 1 << 20:  # keep the next product within 64 bits
            key = np.unique(key, return_inverse=True)[1]
    _, which, counts = np.unique(key, return_inverse=True, return_counts=True)
    again = counts[which] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(size):
        covered[k:len(again) + k] |= again
    return int(covered.sum()), len(known)


def statistics(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """The base counts of a text in the order of ``BASE``, and the values of ``MONOTONE``."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - _count(raw, SPACES)
    symbols = _count(raw, SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    again, distinct = repeated_words(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    n1, c1 = max(1, n), max(1, chars)
    values = (n, chars / n1, symbols / n1, dup / max(1, len(lines)), again / n1, distinct / n1, _count(raw, UPPER) / c1,
              _count(raw, DIGITS) / c1, _count(raw, MARKS) / n1, n / max(1, len(lines)), float((lengths <= 3).sum()) / n1, float((lengths > 12).sum()) / n1)
    return (n, chars, symbols, dup, again), values


@dataclass
class Trees:
    """Node arrays of all trees; ``roots`` has where each begins. A leaf is its own child."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of quality for the rows of x."""
        if not len(self.roots):
            return np.ones(len(x))
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            at = np.where(x[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fitted(x: np.ndarray, y: np.ndarray, signs: list[int]) -> Trees:
    """Boosted trees for labels y (0 or 1) over the columns of x, each with the sign of its effect."""
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if not len(y) or y.min() == y.max():
        return Trees(0.0, *(np.zeros(0, t) for t in (int, int, float, int, int, float)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    margin = np.full(len(y), base)

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + L2), low, high))

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, low: float, high: float) -> int:
        at, g_all, h_all = len(nodes), g[rows].sum(), h[rows].sum()
        own = leaf(g_all, h_all, low, high)
        nodes.append([0, np.inf, at, at, RATE * own])
        best, gain = None, 1e-6
        loss = lambda g, h, v: g * v + 0.5 * (h + L2) * v * v
        for f in range(x.shape[1] if depth < DEPTH and len(rows) >= 2 * MIN_ROWS else 0):
            size = len(cuts[f]) + 1
            gs, hs, ns = (np.bincount(binned[rows, f], w, size).cumsum()[:-1] for w in (g[rows], h[rows], None))
            a, b = (np.clip(-s / (t + L2), low, high) for s, t in ((gs, hs), (g_all - gs, h_all - hs)))
            won = loss(g_all, h_all, own) - loss(gs, hs, a) - loss(g_all - gs, h_all - hs, b)
            won[(ns < MIN_ROWS) | (len(rows) - ns < MIN_ROWS) | (signs[f] * (b - a) < 0)] = 0
            if len(won) and won.max() > gain:
                k = int(won.argmax())
                best, gain = (f, k, a[k], b[k]), won[k]
        if best:
            f, k, a, b = best
            middle, under = (a + b) / 2, binned[rows, f] <= k
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[signs[f]]
            nodes[at][:2] = f, float(cuts[f][k])
            nodes[at][2] = grow(rows[under], g, h, depth + 1, *bounds[0])
            nodes[at][3] = grow(rows[~under], g, h, depth + 1, *bounds[1])
        else:
            margin[rows] += nodes[at][4]
        return at

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
    feature, threshold, left, right, value = zip(*nodes)
    return Trees(base, np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value))


def fit_quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Trees:
    """Trees fitted to a sample of at most ``max_train`` labelled documents. The ids of the sample are broadcast and
    its statistics come to the driver; the parameter bounds both."""
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("long").alias("quality"))
    sample = docs.select("doc_id").distinct().join(marked, "doc_id").orderBy(*order).limit(max_train)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("quality", "text")
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            values = [list(statistics(t)[1]) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64()))], names=["quality", "x"])
        give_back()

    rows = sorted((r.x, r.quality) for r in texts.mapInArrow(run, "quality long, x array<double>").limit(2 * max_train).collect())
    x = np.array([r[0] for r in rows]).reshape(len(rows), len(MONOTONE))
    return fitted(x, np.array([r[1] for r in rows], float), list(MONOTONE.values()))


def _judged(texts: list, trees: Trees, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base counts, whether the base rules fail, score and verdict of a block of texts."""
    found = [statistics(t) for t in texts]
    base = np.array([f[0] for f in found], np.int64).reshape(len(found), len(BASE))
    score = trees.score(np.array([f[1] for f in found], float).reshape(len(found), len(MONOTONE)))
    failed = (base[:, 0] < MIN_WORDS) | (100 * base[:, 4] > 50 * base[:, 0])
    return base, failed, score, ~failed & (score >= threshold)


def quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed``, ``kept`` and the trees' ``score`` of every document."""
    trees = fit_quality(docs, labels, max_train)
    names = ["doc_id", *BASE, "base_failed", "kept", "score"]

    def run(batches):
        for batch in batches:
            base, failed, score, kept = _judged(batch.column(1).to_pylist(), trees, threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in base.T), pa.array(failed), pa.array(kept), pa.array(score)], names=names)
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in BASE)}, base_failed boolean, kept boolean, score double")


def quality_filter(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; a narrow pass."""
    trees = fit_quality(docs, labels, max_train)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            kept = _judged(batch.column(at).to_pylist(), trees, threshold)[3]
            yield batch.filter(pa.array(kept))
        give_back()

    return docs.mapInArrow(run, docs.schema)
