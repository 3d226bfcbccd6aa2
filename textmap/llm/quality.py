"""Text quality by a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins, each chosen pair of features one over the cells of coarser bins.
Boosting visits the tables in turn; each visit adds a shallow tree, grown on the bins' gradient sums, in small
steps. A score is the sum of the looked-up values through the logistic function.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmap.llm.passing import passing

TRAIN_ROWS = 20_000  # bound of the labelled sample
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 120, 60, 8
STEP, RIDGE, LEAST_WEIGHT = 0.1, 2.0, 4.0
FEATURES = (
    "log_bytes", "log_words", "word_length", "distinct_words", "top_word", "repeated_next", "letters", "digits",
    "capitals", "marks", "symbols", "non_ascii", "spaces", "line_length", "repeated_lines", "sentence_ends",
    "long_words", "distinct_pairs", "capital_words", "longest_word",
)

_kinds = np.full(256, 4, np.uint8)  # other symbols and control bytes
_kinds[[9, 10, 11, 12, 13, 32]] = 0
_kinds[48:58] = 1
_kinds[65:91] = 2
_kinds[97:123] = 3
_kinds[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_kinds[128:] = 6


def features(text: str | None) -> list[float]:
    """Numbers about the whole text; an empty one has only zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    if not words:
        return [0.0] * len(FEATURES)
    n, size = len(words), len(raw)
    kinds = np.bincount(_kinds[np.frombuffer(raw, np.uint8)], minlength=7) / size
    counts = Counter(words)
    pairs = set(zip(words, words[1:], strict=False))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [
        np.log1p(size), np.log1p(n), float(lengths.mean()), len(counts) / n, max(counts.values()) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n, float(kinds[2] + kinds[3] + kinds[6]), float(kinds[1]), float(kinds[2]),
        float(kinds[5]), float(kinds[4]), float(kinds[6]), float(kinds[0]), float(np.log1p(size / len(lines))),
        1 - len(set(lines)) / len(lines), (raw.count(b".") + raw.count(b"!") + raw.count(b"?")) / n,
        float((lengths > 20).mean()), len(pairs) / max(1, n - 1), sum(x[:1].isupper() for x in raw.split()) / n,
        float(np.log1p(lengths.max())),
    ]


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t.as_py()) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(found, pa.list_(pa.float64())), *batch.columns[2:]],
            [batch.schema.names[0], "features", *batch.schema.names[2:]],
        )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, features) of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_measured, "id long, features array<double>").select(F.col("id").alias(id_col), "features")


def _tree(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Values of a tree of at most two cuts over bins in order."""

    def value(g, w):
        return g * g / (w + RIDGE)

    def cut(low, high):
        g, w = np.cumsum(gradient[low:high]), np.cumsum(weight[low:high])
        if high - low < 2:
            return 0.0, None
        gain = value(g[:-1], w[:-1]) + value(g[-1] - g[:-1], w[-1] - w[:-1]) - value(g[-1], w[-1])
        gain[(w[:-1] < LEAST_WEIGHT) | (w[-1] - w[:-1] < LEAST_WEIGHT)] = 0.0
        best = int(gain.argmax())
        return float(gain[best]), low + best + 1

    gain, first = cut(0, len(gradient))
    if gain <= 0:
        return np.zeros(len(gradient))
    edges = [0, first, len(gradient)]
    left, right = cut(0, first), cut(first, len(gradient))
    second = max(left, right, key=lambda x: x[0])
    if second[0] > 0:
        edges = sorted([*edges, second[1]])
    out = np.empty(len(gradient))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out[a:b] = gradient[a:b].sum() / (weight[a:b].sum() + RIDGE)
    return out


def _square_tree(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut on each axis of a grid of cells: its gain and the four quadrants' values."""
    g = np.pad(gradient.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    w = np.pad(weight.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    quadrants = []
    for s in (g, w):
        inner = s[1:-1, 1:-1]
        quadrants.append((inner, s[1:-1, -1:] - inner, s[-1:, 1:-1] - inner, s[-1, -1] - s[1:-1, -1:] - s[-1:, 1:-1] + inner))
    gain = sum(a * a / (b + RIDGE) for a, b in zip(*quadrants, strict=True)) - g[-1, -1] ** 2 / (w[-1, -1] + RIDGE)
    if not gain.size:
        return 0.0, np.zeros_like(gradient)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(gradient)
    for part, (a, b) in zip(
        ((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)),
         (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None))),
        zip(*quadrants, strict=True), strict=True,
    ):
        out[part] = a[i, j] / (b[i, j] + RIDGE)
    return float(gain[i, j]), out


class AdditiveModel:
    """Lookup tables of single features and of pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        self.pair_edges = [np.unique(np.quantile(c, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for c in x.T]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.squares: list[np.ndarray] = []
        share = (y.sum() + 1) / (len(y) + 2)
        self.start = float(np.log(share / (1 - share)))
        if 0 < y.sum() < len(y):
            self._boost(x, y)

    def _bins(self, x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)]

    def _boost(self, x: np.ndarray, y: np.ndarray) -> None:
        bins, coarse = self._bins(x, self.edges), self._bins(x, self.pair_edges)
        total = np.full(len(y), self.start)

        def pull():
            p = 1 / (1 + np.exp(-total))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for f, at in enumerate(bins):
                g, w = pull()
                n = len(self.tables[f])
                change = STEP * _tree(np.bincount(at, g, n), np.bincount(at, w, n))
                self.tables[f] += change
                total += change[at]
        shapes = [len(e) + 1 for e in self.pair_edges]

        def cells(i, j):
            return coarse[i] * shapes[j] + coarse[j]

        def grown(i, j, g, w):
            n, at = shapes[i] * shapes[j], cells(i, j)
            return _square_tree(np.bincount(at, g, n).reshape(shapes[i], shapes[j]), np.bincount(at, w, n).reshape(shapes[i], shapes[j]))

        g, w = pull()
        gains = sorted(((grown(i, j, g, w)[0], i, j) for i, j in combinations(range(len(shapes)), 2)), reverse=True)
        self.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
        self.squares = [np.zeros((shapes[i], shapes[j])) for i, j in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for square, (i, j) in zip(self.squares, self.pairs, strict=True):
                g, w = pull()
                change = STEP * grown(i, j, g, w)[1]
                square += change
                total += change.reshape(-1)[cells(i, j)]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for table, at in zip(self.tables, self._bins(x, self.edges), strict=True):
            total += table[at]
        coarse = self._bins(x, self.pair_edges)
        for square, (i, j) in zip(self.squares, self.pairs, strict=True):
            total += square[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-total))


def train(measured: DataFrame, labels: DataFrame, key: Column, label_col: str = "quality") -> AdditiveModel | None:
    """A model fitted on at most ``TRAIN_ROWS`` labelled rows, the smallest by hash of ``key``; none without a row."""
    marks = labels.where(F.col(label_col).isNotNull()).select("doc_id", F.col(label_col).cast("double").alias("label__"))
    share = min(1.0, 2 * TRAIN_ROWS / max(1, marks.count()))
    near = F.pmod(F.xxhash64(key), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)
    rows = measured.where(near).join(marks, "doc_id").orderBy(F.xxhash64(key), "label__").limit(TRAIN_ROWS)
    sample = rows.select("features", "label__").toPandas()
    if not len(sample):
        return None
    return AdditiveModel(np.stack(sample["features"]), sample["label__"].to_numpy())


def _scorer(model: AdditiveModel | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            found = model.score(x) if model is not None and len(x) else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.float64()), *batch.columns[2:]],
                [batch.schema.names[0], "score", *batch.schema.names[2:]],
            )

    return score


def score(measured: DataFrame, model: AdditiveModel | None, id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, score) of measured rows; 0.5 for all without a model. Empty texts are scored like others."""
    rows = measured.select(F.col(id_col).alias("id"), "features")
    return rows.mapInArrow(_scorer(model), "id long, score double").select(F.col("id").alias(id_col), "score")


def with_good_quality(docs: DataFrame, model: AdditiveModel | None, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``least``, with all their columns; each is judged by its own text."""
    score_of = _scorer(model)
    return passing(docs, lambda batches: score_of(_measured(batches)), "score double", F.col("score") >= least)
