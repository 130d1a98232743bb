"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

The statistics of a text are counted in the tasks, over the whole text. The
trees are grown on the driver with numpy from at most `max_rows` labelled
documents (their statistics, not their texts): values are binned by quantiles,
a level of a tree is one histogram of gradients per node, feature and bin.
All trees have the same depth and lie in flat arrays, node i above nodes
2i + 1 and 2i + 2, so that a batch of documents goes down all trees at once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from classmeter.llm.common import each, held_out

# Labelled documents that a model is fitted on, at most.
MAX_ROWS = 20_000

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "upper", "lower", "digits", "blanks", "stops", "symbols", "wide",
    "entropy", "word_length", "word_length_spread", "short_words", "long_words", "plain_words", "capital_words",
    "different_words", "top_word", "top_ten_words", "different_pairs", "different_lines", "line_length", "words_per_stop",
    "different_words_near",
)

# Class of every byte: 0 upper, 1 lower, 2 digit, 3 blank, 4 stop or comma, 5 other sign, 6 part of a wider character.
_CLASS = np.full(256, 5, np.uint8)
for _class, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\x0b\f\r", b".,;:!?")):
    _CLASS[list(_bytes)] = _class
_CLASS[128:] = 6
# Words in a block whose variety is measured by itself, as variety falls with length; all blocks count.
_NEAR = 200


def statistics(text: bytes | None) -> list[float]:
    """STATISTICS of a text; a null or empty one has zeros only."""
    raw = text or b""
    words = raw.split()
    if not words:
        return [float(np.log1p(len(raw)))] + [0.0] * (len(STATISTICS) - 1)
    n = len(words)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = np.bincount(_CLASS, weights=seen, minlength=7) / len(raw)
    used = seen[seen > 0] / len(raw)
    lengths = np.fromiter(map(len, words), np.int64, n)
    edges = np.frombuffer(b"".join([w[:1] + w[-1:] for w in words]), np.uint8)
    kinds = _CLASS[edges].reshape(-1, 2)
    counts = Counter(words)
    top = [c for _, c in counts.most_common(10)]
    lines = raw.split(b"\n")
    blocks = [words[i : i + _NEAR] for i in range(0, n, _NEAR)]
    return [
        np.log1p(len(raw)), np.log1p(n), np.log1p(len(lines)), *shares.tolist(),
        -(used * np.log2(used)).sum(), lengths.mean(), lengths.std(), (lengths <= 3).mean(), (lengths > 12).mean(),
        ((kinds == 1) | (kinds == 6)).all(axis=1).mean(), (kinds[:, 0] == 0).mean(),
        len(counts) / n, top[0] / n, sum(top) / n, len(set(zip(words, words[1:]))) / n,
        len(set(lines)) / len(lines), len(raw) / len(lines), n / (1 + raw.count(b".")),
        sum(len(set(near)) / len(near) for near in blocks) / len(blocks),
    ]


def statistics_of(text: Column) -> Column:
    """STATISTICS as an array of doubles."""

    @F.arrow_udf("array<double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in each(batches):
            yield pa.array([statistics(x.as_py()) for x in batch], pa.list_(pa.float64()))

    return of(text.cast("binary"))


@dataclass
class Trees:
    """Flat arrays of trees of one depth: feature and bound of the inner nodes, value of the leaves."""

    feature: np.ndarray
    bound: np.ndarray
    value: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of statistics."""
        trees, inner = self.feature.shape
        row, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), np.int64)
        for _ in range((inner + 1).bit_length() - 1):
            right = x[row, self.feature[tree, node]] > self.bound[tree, node]
            node = 2 * node + 1 + right
        total = self.base + self.value[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit_trees(
    x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 64, rate: float = 0.1, smooth: float = 1.0, least: float = 1.0,
    weight: np.ndarray | None = None,
) -> Trees:
    """Boosted trees of the logistic loss; a row counts `weight` times. Without both labels there are no trees, and the score is the share of label 1
    (a half without rows). `smooth` is added to a leaf's curvature, a leaf has at least the curvature `least`."""
    inner, n_leaves = 2**depth - 1, 2**depth
    weight = np.ones(len(y)) if weight is None else weight
    if len(y) == 0 or y.min() == y.max():
        mean = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, n_leaves)), float(np.log(mean / (1 - mean))))
    features = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(features)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    usable = np.array([[b < len(e) for b in range(bins)] for e in edges])  # the last bin has no bound above it
    flat = binned + np.arange(features) * bins
    ones = float((weight * y).sum() / weight.sum())
    base = float(np.log(ones / (1 - ones)))
    margin = np.full(len(y), base)
    feature = np.zeros((trees, inner), np.int64)
    bound = np.full((trees, inner), np.inf)
    value = np.zeros((trees, n_leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = weight * (y - p), weight * p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            place = ((node - first)[:, None] * (features * bins) + flat).ravel()
            size = width * features * bins
            g, h = (np.bincount(place, np.repeat(v, features), size).reshape(width, features, bins).cumsum(axis=2) for v in (slope, curve))
            g_all, h_all = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + smooth) + (g_all - g) ** 2 / (h_all - h + smooth) - g_all**2 / (h_all + smooth)
            gain[(h < least) | (h_all - h < least) | ~usable[None]] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            split = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            chosen, cut = best // bins, best % bins
            for k in np.flatnonzero(split):
                feature[t, first + k], bound[t, first + k] = chosen[k], edges[chosen[k]][cut[k]]
            at = node - first
            right = split[at] & (binned[np.arange(len(y)), chosen[at]] > cut[at])
            node = 2 * node + 1 + right
        leaf = node - inner
        g, h = (np.bincount(leaf, v, n_leaves) for v in (slope, curve))
        value[t] = rate * g / (h + smooth)
        margin += value[t][leaf]
    return Trees(feature, bound, value, base)


def agreed(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) outside the held-out fold, one row each. Labels that are null, or contradict each other, are left out."""
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col(label).isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("top"))
    return known.where("y = top").select("doc_id", "y")


def labelled(docs: DataFrame, known: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, text, y) of at most `max_rows` documents of `known` (see `agreed`).

    They are the first in the order of a hash of their id. A repeated document is
    there as often as in `docs`.
    """
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_rows ids


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **settings) -> Trees:
    """Trees from the labels of `labels` (doc_id, quality) that are not held out.

    Rows with one id and equal statistics are one with a weight. Of ids that
    repeat with other texts at most `max_rows` further rows are taken, in the
    order of the hash and then of the statistics.
    """
    rows = labelled(docs, agreed(labels, "quality"), max_rows).select("doc_id", "y", statistics_of(F.col("text")).alias("x"))
    rows = rows.groupBy("doc_id", "y", "x").agg(F.count(F.lit(1)).alias("n"))
    got = sorted((r.doc_id, r.y, r.x, r.n) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(2 * max_rows).collect())
    x = np.array([r[2] for r in got]).reshape(len(got), len(STATISTICS))
    return fit_trees(x, np.array([r[1] for r in got], float), weight=np.array([r[3] for r in got], float), **settings)


def score(model: Trees, text: Column) -> Column:
    """Quality of a text, 0 to 1; null and empty texts are scored by their zeros."""

    @F.arrow_udf("double")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in each(batches):
            x = np.array([statistics(v.as_py()) for v in batch]).reshape(len(batch), len(STATISTICS))
            yield pa.array(model.scores(x), pa.float64())

    return of(text.cast("binary"))
