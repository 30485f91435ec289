"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each text becomes a row of statistics (byte classes, words, lines). Statistics
are cut into bins by quantiles of the learning sample; boosting fits trees to
the gradient of the logistic loss on bin histograms. The fitted trees are
complete and flattened into arrays, so numpy walks all texts of a batch through
one tree level at a time.

Trees are fitted on the driver on a bounded sample: the ``sample_rows`` labelled
documents that come first by the hash of their id. Statistics of the sample are
computed on the executors; every text is scored whole.

Defined results: null text counts as empty and is scored like any other. Ids
with several labels learn the larger one; null labels are not learned from.
Without labels, or with labels of one kind only, every score is the share of
label 1, 0.5 if there is none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import annotate, field

OUTPUT = [field("score", "double"), field("predicted", "int")]

STATISTICS = (
    "bytes", "words", "lines", "word_length", "long_words", "distinct_words", "repeated_lines",
    "upper", "lower", "digits", "spaces", "high", "dots", "commas", "bangs", "pipes", "marks",
    "words_with_marks", "upper_words", "distinct_bytes", "byte_entropy", "line_length",
)

_CODES = np.arange(256)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
_LOWER = (_CODES >= 97) & (_CODES <= 122)
_DIGIT = (_CODES >= 48) & (_CODES <= 57)
_SPACE = (_CODES == 32) | ((_CODES >= 9) & (_CODES <= 13))
_HIGH = _CODES >= 128
_MARK = (_CODES > 32) & (_CODES < 127) & ~_UPPER & ~_LOWER & ~_DIGIT
_PLAIN_MARKS = np.isin(_CODES, [ord(c) for c in ".,;:!?'\"()-"])
_ODD = _MARK & ~_PLAIN_MARKS


@dataclass(frozen=True)
class Fit:
    sample_rows: int = 20_000
    trees: int = 60
    depth: int = 4
    bins: int = 32
    rate: float = 0.15
    least_weight: float = 4.0
    ridge: float = 1.0


@dataclass(frozen=True)
class Model:
    """``depth`` levels a tree; node k has children 2k+1 and 2k+2, the last level holds leaves."""

    base: float
    depth: int
    feature: np.ndarray  # (trees, inner nodes)
    cut: np.ndarray  # (trees, inner nodes): right if the value is larger
    leaf: np.ndarray  # (trees, leaves)


def statistics(texts: list[str | None]) -> np.ndarray:
    out = np.zeros((len(texts), len(STATISTICS)))
    for row, text in enumerate(texts):
        raw = (text or "").encode()
        n = max(1, len(raw))
        seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        words = raw.split()
        lines = [x for x in raw.split(b"\n") if x]
        part = seen[seen > 0] / n
        many = max(1, len(words))
        odd = sum(not w.strip(b".,;:!?'\"()-").isalnum() and w.isascii() for w in words) if seen[_ODD].any() else 0
        out[row] = (
            np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)),
            (len(raw) - seen[_SPACE].sum()) / many, sum(len(w) > 20 for w in words) / many,
            len(set(words)) / many, 1 - len(set(lines)) / max(1, len(lines)),
            seen[_UPPER].sum() / n, seen[_LOWER].sum() / n, seen[_DIGIT].sum() / n, seen[_SPACE].sum() / n,
            seen[_HIGH].sum() / n, seen[46] / many, seen[44] / many, seen[33] / many, seen[124] / many,
            seen[_ODD].sum() / many, odd / many, sum(w.isupper() for w in words) / many,
            np.count_nonzero(seen) / 256, float(-(part * np.log2(part)).sum()), len(raw) / max(1, len(lines)),
        )
    return out


def fit(values: np.ndarray, labels: np.ndarray, how: Fit = Fit()) -> Model:
    inner, leaves = 2**how.depth - 1, 2**how.depth
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or not 0 < share < 1:
        base = 0.0 if not len(labels) else (8.0 if share else -8.0)
        return Model(base, how.depth, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    width = values.shape[1]
    edges = [np.unique(np.quantile(values[:, j], np.linspace(0, 1, how.bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], values[:, j], side="left") for j in range(width)], 1)
    flat = binned + np.arange(width) * how.bins
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(labels), base)
    trees = []
    for _ in range(how.trees):
        p = 1 / (1 + np.exp(-margin))
        slope, weight = labels - p, p * (1 - p)
        node = np.zeros(len(labels), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(how.depth):
            first, size = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * width * how.bins + flat).ravel()
            shape = (size, width, how.bins)
            g = np.bincount(cell, np.repeat(slope, width), np.prod(shape)).reshape(shape).cumsum(2)
            h = np.bincount(cell, np.repeat(weight, width), np.prod(shape)).reshape(shape).cumsum(2)
            g_all, h_all = g[:, :1, -1:], h[:, :1, -1:]
            gain = g**2 / (h + how.ridge) + (g_all - g) ** 2 / (h_all - h + how.ridge) - g_all**2 / (h_all + how.ridge)
            gain[(h < how.least_weight) | (h_all - h < how.least_weight)] = 0
            for k in range(size):
                j, b = np.unravel_index(int(gain[k].argmax()), gain[k].shape)
                if gain[k, j, b] > 1e-9 and b < len(edges[j]):
                    feature[first + k], cut[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (values[np.arange(len(node)), feature[node]] > cut[node])
        at = node - inner
        leaf = how.rate * np.bincount(at, slope, leaves) / (np.bincount(at, weight, leaves) + how.ridge)
        margin = margin + leaf[at]
        trees.append((feature, cut, leaf))
    return Model(base, how.depth, *(np.stack([t[i] for t in trees]) for i in range(3)))


def score(model: Model, values: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row of statistics."""
    margin = np.full(len(values), model.base)
    rows = np.arange(len(values))
    for feature, cut, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
        node = np.zeros(len(values), np.int64)
        for _ in range(model.depth):
            node = 2 * node + 1 + (values[rows, feature[node]] > cut[node])
        margin += leaf[node - len(feature)]
    return 1 / (1 + np.exp(-margin))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    may_learn: Column,
    how: Fit = Fit(),
    text: str = "text",
    doc_id: str = "doc_id",
    label: str = "quality",
) -> Model:
    """Fit on labelled rows where ``may_learn`` (of the labels) holds."""
    marked = (
        labels.where(may_learn & F.col(label).isNotNull() & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("sample_id"))
        .agg(F.max(label).cast("double").alias("label"))
        .orderBy(F.xxhash64("sample_id"), "sample_id")
        .limit(how.sample_rows)
    )
    texts = docs.select(F.col(doc_id).alias("sample_id"), F.col(text).alias("sample_text"))
    # At most sample_rows short rows, so this side is safe to broadcast.
    sample = texts.join(F.broadcast(marked), "sample_id")
    found = annotate(sample, lambda: lambda t: [statistics(t).tolist()], [field("found", "array<double>")], "sample_text")
    rows = found.select("sample_id", "label", "found").orderBy("sample_id", "found").limit(4 * how.sample_rows).collect()
    values = np.array([r["found"] for r in rows]).reshape(len(rows), len(STATISTICS))
    return fit(values, np.array([r["label"] for r in rows]), how)


def classify(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts):
        p = score(shared.value, statistics(texts))
        return p.tolist(), (p >= least).astype(int).tolist()

    return annotate(docs, lambda: work, OUTPUT, text)
