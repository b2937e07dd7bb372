"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the presence of hashed words, word stems (the first letters of a word),
word pairs and pairs that skip one word. Each coordinate has a learning rate of its own, and the
L1 term leaves most weights at zero, so what is broadcast is a short list of (bucket, weight).
Training reads a bounded sample of labelled rows; scoring reads every whole text in one pass
without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import slices
from tessera.llm.common import bounded, id_and_text, labelled_text

BUCKET_BITS = 20
STEM = 4
CACHE_WORDS = 100_000
_word = re.compile(r"\w+").findall
_seen: dict[str, int] = {}


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(64 - BUCKET_BITS)).astype(np.uint32)


def _hashed(word: str) -> int:
    if len(_seen) >= CACHE_WORDS:
        _seen.clear()
    h = zlib.crc32(word.encode()) | zlib.crc32(word[:STEM].encode()) << 32
    if len(word) <= 40:
        _seen[word] = h
    return h


def features(text: str) -> np.ndarray:
    """The buckets of a text's features, repeats included."""
    words = _word(text.lower())
    if not words:
        return np.empty(0, np.uint32)
    get = _seen.get
    both = np.array([get(w) or _hashed(w) for w in words], np.uint64)
    own, stem = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
    parts = [_mix(own, 1), _mix(stem, 2)]
    for gap, salt in ((1, 3), (2, 4)):
        if len(own) > gap:
            with np.errstate(over="ignore"):
                parts.append(_mix(own[:-gap] * np.uint64(0xD6E8FEB86659FD93) + own[gap:], salt))
    return np.concatenate(parts)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 8, alpha: float = 0.5, beta: float = 1.0, l1: float = 2.5, l2: float = 1.0, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and intercept of FTRL-proximal logistic regression on sets of buckets."""
    size = 1 << BUCKET_BITS
    z, n = np.zeros(size), np.zeros(size)
    zb = nb = b = 0.0
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)).tolist():
            i = rows[k]
            zi, ni = z[i], n[i]
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - labels[k]
            more = np.sqrt(ni + g * g)
            z[i] = zi + g - (more - np.sqrt(ni)) / alpha * w
            n[i] = ni + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * b
            nb += g * g
            b = -zb / ((beta + np.sqrt(nb)) / alpha + l2)
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    return w, float(b)


class Model:
    """Non-zero weights by bucket, and the intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.buckets = np.flatnonzero(weights).astype(np.uint32)
        self.values = weights[self.buckets].astype(np.float32)
        self.intercept = intercept
        self._dense = None

    def __getstate__(self):
        return self.__dict__ | {"_dense": None}

    def score(self, text: str) -> float:
        if self._dense is None:
            self._dense = np.zeros(1 << BUCKET_BITS, np.float32)
            self._dense[self.buckets] = self.values
        found = features(text)
        found = found[self._dense[found] != 0]
        total = float(self._dense[np.unique(found)].sum(dtype=np.float64)) + self.intercept
        return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", per_class: int = 3_500, most_bytes: int = 24_000_000) -> Model:
    """Fit on at most about ``per_class`` rows of each label value, where ``learn`` holds.

    The features are made on the executors; the driver gets ``2 * per_class`` lists of buckets, about ``most_bytes``
    at most: of a sample that has more, a share chosen by a hash. Null labels and ids teach nothing; rows that repeat count once.
    Without labelled rows of both kinds the score is 1 or 0, as all labels say, and 0 if there are none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(features(t.as_py())).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(found, pa.binary())], ["doc_id", "label", "found"])

    rows = labelled_text(docs, labels, label, learn, per_class).select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, found binary")
    rows = bounded(rows, F.octet_length("found"), most_bytes).toPandas().sort_values(["doc_id", "found"], kind="stable")
    y = (rows["label"].to_numpy() > 0).astype(float)
    if len(y) == 0 or y.min() == y.max():
        return Model(np.zeros(1 << BUCKET_BITS), 35.0 if len(y) and y[0] else -35.0)
    return Model(*ftrl([np.frombuffer(x, np.uint32) for x in rows["found"]], y))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every whole text, however long; null and empty texts get the intercept's score.

    Null ids stay null, repeated rows give rows each, an empty table gives no rows; other columns don't matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([own.score(t.as_py()) for t in part.column(1)], pa.float64())], ["doc_id", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows that score below ``threshold``, with all their columns; a null text counts as empty.

    Rows without an id are scored like others, repeated rows stay or go together, an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            texts = batch.column(place).cast(pa.string())
            yield batch.filter(pa.array([own.score(t.as_py() or "") < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
