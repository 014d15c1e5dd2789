"""Quality classifier: histogram gradient-boosted trees over document statistics.

Fitting: statistics of a bounded sample of labelled documents (computed on the executors)
are binned at their quantiles, and trees are grown level by level on gradient histograms,
with numpy on the driver. The trees are flattened into arrays (feature, threshold, children,
value), so a batch is scored by a few vectorised gathers: all documents walk all trees one
level at a time. Scoring is a map over the documents: no shuffle, whole texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strata.llm.common import fold, labelled_sample

FOLDS, HELD = 3, 1  # held out: crc32(doc_id) mod 3 is 1


def _byte_classes() -> np.ndarray:
    groups = [range(65, 91), range(97, 123), range(48, 58), b" \t\n\r\x0b\x0c", b".,;:?'\"-()", b"!", b"|",
              b"#$%&*@^~<>=+/\\_[]{}`", range(128, 256), b"\n"]
    table = np.zeros((256, len(groups)))
    for j, g in enumerate(groups):
        table[list(g), j] = 1
    return table


_CLASSES = _byte_classes()
FEATURES = ("log_bytes", "upper", "lower", "digit", "space", "punct", "bang", "pipe", "symbol", "high", "newline",
            "entropy", "log_words", "word_mean", "word_std", "word_max", "short_words", "distinct", "top_word",
            "echo", "distinct_pairs", "lines", "dup_lines", "line_mean", "ends", "titled", "capital_words",
            "no_alpha_words")


def statistics(text: str) -> list[float]:
    """Statistics of one whole text; an empty text has zeros."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if not len(raw):
        return [0.0] * len(FEATURES)
    counts = np.bincount(raw, minlength=256)
    share = counts[counts > 0] / len(raw)
    words = text.split()
    n = len(words) or 1
    size = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    kinds = Counter(words)
    pairs = list(zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    n_lines = len(lines) or 1
    return [math.log(len(raw)), *(counts @ _CLASSES / len(raw)).tolist(), float(-(share * np.log(share)).sum()),
            math.log(n), float(size.mean()), float(size.std()), float(min(size.max(), 200)),
            float((size <= 3).mean()), len(kinds) / n, max(kinds.values(), default=0) / n,
            sum(a == b for a, b in pairs) / n, len(set(pairs)) / n, n_lines / n,
            1 - len(set(lines)) / n_lines, math.log1p(n / n_lines),
            sum(x[-1] in ".!?" for x in words) / n, sum(map(str.istitle, words)) / n,
            sum(map(str.isupper, words)) / n, sum(not any(map(str.isalpha, w[:3])) for w in words) / n]


def matrix(texts: Iterable[str | None]) -> np.ndarray:
    return np.array([statistics(t or "") for t in texts], np.float64).reshape(-1, len(FEATURES))


@dataclass
class Forest:
    """Flattened trees: arrays of trees x nodes. Node i's children are 2i+1 and 2i+2; a node that
    was not split sends everything left, down to its own value."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros((len(x), len(self.feature)), np.int64)
        tree = np.arange(len(self.feature))[None, :]
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.threshold[tree, node])
        raw = self.base + self.value[tree, node].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 64, rate: float = 0.1,
        l2: float = 1.0, min_hessian: float = 2.0) -> Forest:
    """Gradient boosting on the logistic loss with binned features (ties: first feature, lowest bin)."""
    nodes, k = 2 ** (depth + 1) - 1, x.shape[1]
    prior = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    forest = Forest(np.zeros((trees, nodes), np.int64), np.full((trees, nodes), np.inf),
                    np.zeros((trees, nodes)), float(np.log(prior / (1 - prior))), depth)
    if not len(y) or y.min() == y.max():
        return forest
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)])  # x <= cuts[b] iff bin <= b
    raw = np.full(len(y), forest.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            slot = (node - first) * bins
            best, where, cut = np.zeros(width), np.full(width, -1), np.zeros(width, np.int64)
            for j in range(k):
                g = np.bincount(slot + binned[j], grad, width * bins).reshape(width, bins).cumsum(axis=1)
                h = np.bincount(slot + binned[j], hess, width * bins).reshape(width, bins).cumsum(axis=1)
                gl, hl, gt, ht = g, h, g[:, -1:], h[:, -1:]
                gain = gl ** 2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt ** 2 / (ht + l2)
                gain[(hl < min_hessian) | (ht - hl < min_hessian)] = 0
                gain[:, len(cuts[j]):] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = top > best + 1e-9
                best[better], where[better], cut[better] = top[better], j, at[better]
            for i in np.flatnonzero(where >= 0):
                forest.feature[t, first + i] = where[i]
                forest.threshold[t, first + i] = cuts[where[i]][cut[i]]
            chosen = where[node - first]
            right = (chosen >= 0) & (binned[np.maximum(chosen, 0), np.arange(len(y))] > cut[node - first])
            node = 2 * node + 1 + right
        g, h = np.bincount(node, grad, nodes), np.bincount(node, hess, nodes)
        forest.value[t] = rate * g / (h + l2)
        raw += forest.value[t][node]
    return forest


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> Forest:
    """Fit on at most ``max_rows`` labelled documents outside the held-out fold."""
    sample = labelled_sample(docs, labels, "quality", FOLDS, HELD, max_rows)

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))],
                                             names=["id", "y", "x"])

    kind = sample.schema["id"].dataType.simpleString()
    rows = sample.mapInArrow(features, f"id {kind}, y int, x array<double>").orderBy("id").collect()
    return fit(np.array([r["x"] for r in rows], np.float64).reshape(-1, len(FEATURES)), np.array([r["y"] for r in rows], np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score`` (0 to 1), ``predicted``.

    Defined cases: NULL and empty texts are scored like each other (all statistics 0); NULL
    labels are ignored and contradicting ones averaged; without labels of both kinds every
    score is the smoothed share of the kind there is (0.5 without any); a NULL id stays NULL and
    falls in the fold of the empty text; repeated rows get equal scores; an empty table gives an
    empty result; only ``doc_id`` and ``text`` are read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_rows))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(model.value.score(matrix(t.as_py() for t in b.column(1))))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_rows))
    at = docs.columns.index("text")

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.value.score(matrix(t.as_py() for t in b.column(at))) >= 0.5, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
