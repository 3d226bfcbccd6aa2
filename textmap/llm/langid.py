"""Language identification with a small convolutional network over bytes, trained and run in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmap.llm.passing import passing

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
TRAIN_WINDOWS = 12_000  # bound of the labelled sample
WINDOWS_PER_TEXT = 4
EPOCHS = 6
BATCH = 128
RATE = 0.01
AT_ONCE = 512
UNDECIDED = "und"

_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32


def windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the whole text (A-Z as a-z) in windows of fixed length, and how many bytes each holds."""
    raw = _fold[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    n = -(-len(raw) // WINDOW)
    padded = np.zeros(n * WINDOW, np.uint8)
    padded[: len(raw)] = raw
    held = np.full(n, WINDOW)
    if n:
        held[-1] = len(raw) - (n - 1) * WINDOW
    return padded.reshape(n, WINDOW), held


_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter; numerals such as fractions and roman ones are none."""
    return text is not None and (_ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text)))


class ByteNet:
    """Byte embedding, filters of several widths, max pooling over the window, softmax."""

    def __init__(self, labels: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.parameters = {"bytes": rng.normal(0, 0.5, (256, EMBEDDING))}
        for k in WIDTHS:
            self.parameters[f"filter{k}"] = rng.normal(0, 0.6 / np.sqrt(k), (k, EMBEDDING, FILTERS))
        self.parameters["dense"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(labels)))
        self.parameters["bias"] = np.zeros(len(labels))
        self.parameters = {k: v.astype(np.float32) for k, v in self.parameters.items()}

    def _pooled(self, x: np.ndarray, where: bool) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest response of each filter in each window; its place too, if asked."""
        p, pooled, places = self.parameters, [], []
        for k in WIDTHS:
            tables = np.einsum("be,kef->kbf", p["bytes"], p[f"filter{k}"])
            last = x.shape[1] - k + 1
            response = np.take(tables[0], x[:, :last], axis=0)
            for j in range(1, k):
                response += np.take(tables[j], x[:, j : j + last], axis=0)
            if where:
                place = response.argmax(axis=1)
                places.append(place)
                pooled.append(np.take_along_axis(response, place[:, None], axis=1)[:, 0])
            else:
                pooled.append(response.max(axis=1))
        return np.maximum(np.concatenate(pooled, axis=1), 0), places

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        logits = pooled @ self.parameters["dense"] + self.parameters["bias"]
        logits = np.exp(logits - logits.max(axis=1, keepdims=True))
        return logits / logits.sum(axis=1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        parts = [self._softmax(self._pooled(x[i : i + AT_ONCE], False)[0]) for i in range(0, len(x), AT_ONCE)]
        return np.concatenate(parts) if parts else np.empty((0, len(self.labels)), np.float32)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.parameters
        pooled, places = self._pooled(x, True)
        error = self._softmax(pooled)
        error[np.arange(len(y)), y] -= 1
        error /= len(y)
        back = (error @ p["dense"].T) * (pooled > 0)
        gradients = {"dense": pooled.T @ error, "bias": error.sum(axis=0), "bytes": np.zeros_like(p["bytes"])}
        rows = np.arange(len(x))[:, None]
        for i, k in enumerate(WIDTHS):
            part = back[:, i * FILTERS : (i + 1) * FILTERS]
            gradient = np.zeros_like(p[f"filter{k}"])
            for j in range(k):
                seen = x[rows, places[i] + j]
                gradient[j] = np.einsum("nfe,nf->ef", p["bytes"][seen], part)
                np.add.at(gradients["bytes"], seen.reshape(-1), (part[:, :, None] * p[f"filter{k}"][j].T[None]).reshape(-1, EMBEDDING))
            gradients[f"filter{k}"] = gradient
        return gradients

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.parameters.items()}
        second = {k: np.zeros_like(v) for k, v in self.parameters.items()}
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for i in range(0, len(x), BATCH):
                step += 1
                chosen = order[i : i + BATCH]
                for k, g in self._gradients(x[chosen], y[chosen]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    rate = RATE * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                    self.parameters[k] -= (rate * first[k] / (np.sqrt(second[k]) + 1e-7)).astype(np.float32)


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some windows of each text, spread evenly over all of it."""
    for batch in batches:
        found: list[list] = [[], [], []]
        for key, text, label in zip(*(batch.column(i) for i in range(3)), strict=True):
            text = text.as_py()
            if has_letter(text):
                cut, _ = windows(text)
                for i in np.unique(np.linspace(0, len(cut) - 1, min(len(cut), WINDOWS_PER_TEXT)).astype(int)):
                    for column, value in zip(found, (key.as_py() * 31 + int(i) & 0x7FFFFFFF, label.as_py(), cut[i].tobytes()), strict=True):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.string()), pa.array(found[2], pa.binary())], ["key", "label", "bytes"])


def train(labelled: DataFrame, key: Column, text_col: str = "text", label_col: str = "lang") -> ByteNet | None:
    """A network fitted on at most ``TRAIN_WINDOWS`` windows of labelled texts, the smallest by hash of ``key``.

    Rows without text, letter or label teach nothing; without any row there is no network.
    """
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(
        (F.xxhash64(key) % F.lit(1 << 30)).alias("key"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")
    )
    # every row gives a window at least, so a share of the rows by hash is enough
    share = min(1.0, 2 * TRAIN_WINDOWS / max(1, rows.select("key").count()))
    near = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)
    sample = rows.where(near).mapInArrow(_samples, "key long, label string, bytes binary")
    sample = sample.orderBy(F.xxhash64("key"), "bytes", "label").limit(TRAIN_WINDOWS).collect()
    if not sample:
        return None
    labels = sorted({r["label"] for r in sample})
    net = ByteNet(labels)
    x = np.stack([np.frombuffer(r["bytes"], np.uint8) for r in sample])
    net.train(x, np.array([labels.index(r["label"]) for r in sample]))
    return net


def _predictor(net: ByteNet | None):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores, cuts, held, owner = [], [], [], [], []

            def settle():
                """Decide the texts gathered so far."""
                if not cuts:
                    return
                p = net.predict(np.concatenate(cuts)).astype(np.float64)
                weight, who = np.concatenate(held).astype(np.float64), np.repeat(owner, [len(c) for c in cuts])
                first = np.concatenate([[0], np.cumsum([len(c) for c in cuts])[:-1]])
                total = np.add.reduceat(p * weight[:, None], first, axis=0) / np.add.reduceat(weight, first)[:, None]
                best = total.argmax(axis=1)
                for i, b, share in zip(owner, best, total, strict=True):
                    labels[i], scores[i] = net.labels[b], float(min(1.0, share[b]))
                cuts.clear(), held.clear(), owner.clear()

            size = 0
            for text in batch.column(1):
                text = text.as_py()
                labels.append(UNDECIDED), scores.append(0.0)
                if net is not None and has_letter(text):
                    cut, n = windows(text)
                    cuts.append(cut), held.append(n), owner.append(len(labels) - 1)
                    size += len(cut)
                    if size >= 4 * AT_ONCE:
                        settle()
                        size = 0
            settle()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(labels, pa.string()), pa.array(scores, pa.float64()), *batch.columns[2:]],
                [batch.schema.names[0], "lang_pred", "score", *batch.schema.names[2:]],
            )

    return predict


def identify(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, lang_pred, score) of each row: the mean of the windows' softmax, weighed by their bytes.

    Texts that are null or hold no letter, and all texts without a network, are ``und`` with score 0. Only the
    text is used, all of it.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_predictor(net), "id long, lang_pred string, score double")
    return found.select(F.col("id").alias(id_col), "lang_pred", "score")


def with_known_language(docs: DataFrame, net: ByteNet | None, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose language is told with a score of at least ``least``, with all their columns.

    Each row is judged by its own text, so repeated ids and rows with one id and different texts do no harm.
    """
    return passing(docs, _predictor(net), "lang_pred string, score double", (F.col("lang_pred") != UNDECIDED) & (F.col("score") >= least))
