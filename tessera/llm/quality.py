"""Quality by attention-based multiple-instance learning.

A document is a bag of passages (64 words each, over the whole text). Every passage is encoded
(word shape, punctuation, repetition, and signed hashes of its words), a gated attention layer
weighs the passages of a document, and the weighted sum of their hidden vectors is scored.
Encoder layer, attention and classifier are learnt together from document labels alone, on a
bounded sample; scoring is one pass over whole texts without a shuffle. The model is a few
thousand numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import Shared, slices
from tessera.llm.common import bounded, id_and_text, labelled_text

PASSAGE = 64
SHAPES, HASHES = 10, 32
EXTRA = 4
WIDTH = SHAPES + HASHES + EXTRA
HIDDEN, GATE = 24, 12
CACHE_WORDS, CACHE_LETTERS = 200_000, 4_000_000
#: Passages scored at once.
STEP = 20_000


class Letters:
    """Kinds of characters by code point, looked up once each: letter, upper case, digit, odd."""

    def __init__(self):
        self.kinds = np.full(0x110000, 255, np.uint8)

    def of(self, codes: np.ndarray) -> np.ndarray:
        found = self.kinds[codes]
        if (found == 255).any():
            for code in np.unique(codes[found == 255]).tolist():
                c = chr(code)
                self.kinds[code] = c.isalpha() | c.isupper() << 1 | c.isdigit() << 2 | (not c.isalnum() and c not in ".,;:'-") << 3
            found = self.kinds[codes]
        return found


def word_rows(words: list[str], letters: Letters) -> np.ndarray:
    """Shape features and signed hashes of words (none empty), a row each."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    start, last = np.cumsum(size) - size, codes[np.cumsum(size) - 1]
    kinds = letters.of(codes)
    letter, upper, digit, odd = (np.add.reduceat(kinds >> k & 1, start, dtype=np.int64) for k in range(4))
    ends = lambda marks: np.isin(last, [ord(c) for c in marks])
    own = np.empty((len(words), SHAPES + HASHES), np.float32)
    shapes = (np.minimum(size, 40) / 10, letter / size, upper / size, (upper > 1) & (upper == letter), digit / size, odd / size, odd == size, ends(".!?"), ends(",;:"), odd >= 2)
    for k, x in enumerate(shapes):
        own[:, k] = x
    bits = np.fromiter((zlib.crc32(w.lower().strip(".,;:!?").encode("utf-8", "surrogatepass")) for w in words), np.uint32, len(words))
    own[:, SHAPES:] = (bits[:, None] >> np.arange(HASHES, dtype=np.uint32) & 1).astype(np.float32) * 2 - 1
    return own


class Encoder:
    """Passage vectors of texts; remembers the rows of words it has seen, up to a bound in words and letters."""

    def __init__(self):
        self.letters, self.held = Letters(), 0
        self.seen: dict[str, int] = {}
        self.rows = np.zeros((0, SHAPES + HASHES), np.float32)

    def __getstate__(self):
        return {}

    def __setstate__(self, state):
        self.__init__()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Passages x ``WIDTH`` of each text; a text without words has none."""
        found = [t.split() for t in texts]
        every = {w for ws in found for w in ws}
        new = every - self.seen.keys()
        if len(self.seen) + len(new) > CACHE_WORDS or self.held > CACHE_LETTERS:
            self.seen, self.rows, self.held, new = {}, self.rows[:0], 0, every
        if new:
            more = list(new)
            self.seen.update(zip(more, range(len(self.rows), len(self.rows) + len(more)), strict=True))
            self.rows = np.concatenate([self.rows, word_rows(more, self.letters)])
            self.held += sum(map(len, more))
        return [self._passages(ws) for ws in found]

    def _passages(self, words: list[str]) -> np.ndarray:
        ids = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
        count = max(1, len(words) // PASSAGE) if len(words) else 0
        out = np.empty((count, WIDTH), np.float32)
        for lo in range(0, count, 256):  # the rows of 256 passages are held at once
            hi = min(count, lo + 256)
            part = ids[lo * PASSAGE : None if hi == count else hi * PASSAGE]
            starts = np.arange(hi - lo) * PASSAGE
            sizes = np.diff(np.append(starts, len(part)))
            out[lo:hi, : SHAPES + HASHES] = np.add.reduceat(self.rows[part], starts, axis=0) / sizes[:, None]
            passage = np.repeat(np.arange(hi - lo), sizes)
            distinct = np.unique(passage << 32 | part) >> 32
            same = np.concatenate([[0], part[1:] == part[:-1]])
            out[lo:hi, -4] = np.bincount(distinct, minlength=hi - lo) / sizes
            out[lo:hi, -3] = np.add.reduceat(same, starts) / sizes
            out[lo:hi, -2] = np.log1p(sizes) / 5
            out[lo:hi, -1] = np.log1p(count) / 10
        return out


class Model:
    """tanh encoder layer, gated attention, logistic score."""

    def __init__(self, seed: int = 1):
        draw = np.random.default_rng(seed)
        init = lambda a, b: draw.normal(0, a**-0.5, (a, b))
        self.p = {"w": init(WIDTH, HIDDEN), "b": np.zeros(HIDDEN), "v": init(HIDDEN, GATE), "u": init(HIDDEN, GATE), "a": np.zeros(GATE), "c": np.zeros(HIDDEN), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)
        self.encoder = Encoder()

    def forward(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple:
        p = self.p
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-np.clip(h @ p["u"], -35, 35)))
        e = (t * g) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        att = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(att[:, None] * h, starts, axis=0)
        y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -35, 35)))
        return h, t, g, att, z, y

    def gradients(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h, t, g, att, z, y = self.forward(x, starts, sizes)
        dy = weight * (y - labels) / len(labels)
        dz = np.repeat(dy[:, None] * p["c"], sizes, axis=0)
        datt = (dz * h).sum(axis=1)
        de = att * (datt - np.repeat(np.add.reduceat(att * datt, starts), sizes))
        dt, dg = de[:, None] * p["a"] * g * (1 - t * t), de[:, None] * p["a"] * t * g * (1 - g)
        dh = (dz * att[:, None] + dt @ p["v"].T + dg @ p["u"].T) * (1 - h * h)
        return {"w": x.T @ dh, "b": dh.sum(axis=0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ dy, "d": dy.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.005, decay: float = 1e-4, seed: int = 2) -> None:
        """Adam on the weighted log loss; both labels weigh the same in all."""
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(axis=0), every.std(axis=0) + 1e-3
        weight = len(labels) / (2 * np.where(labels > 0, max(1, (labels > 0).sum()), max(1, (labels <= 0).sum())))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        order, step = np.random.default_rng(seed), 0
        for epoch in range(epochs):
            for ids in np.array_split(order.permutation(len(bags)), max(1, len(bags) // batch)):
                x = (np.concatenate([bags[i] for i in ids]) - self.mean) / self.scale
                sizes = np.array([len(bags[i]) for i in ids])
                found = self.gradients(x, np.cumsum(sizes) - sizes, sizes, labels[ids], weight[ids])
                step += 1
                for k, grad in found.items():
                    grad = grad + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    s[k] = 0.999 * s[k] + 0.001 * grad * grad
                    self.p[k] -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)

    def score(self, texts: list[str]) -> list[float]:
        """Scores in 0 to 1; a text without words gets that of a zero representation."""
        bags = self.encoder.encode(texts)
        empty = float(1 / (1 + np.exp(-np.clip(self.p["d"][0], -35, 35))))
        out = [empty] * len(bags)
        held: list[int] = []
        rows = 0
        for k in range(len(bags) + 1):
            if held and (k == len(bags) or rows + len(bags[k]) > STEP):
                sizes = np.array([len(bags[i]) for i in held])
                x = (np.concatenate([bags[i] for i in held]) - self.mean) / self.scale
                for i, y in zip(held, self.forward(x, np.cumsum(sizes) - sizes, sizes)[-1].tolist(), strict=True):
                    out[i] = y
                held, rows = [], 0
            if k < len(bags) and len(bags[k]):
                held.append(k)
                rows += len(bags[k])
        return out


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", per_class: int = 3_000, most_bytes: int = 32_000_000) -> Model:
    """Fit on at most about ``per_class`` rows of each label value, where ``learn`` holds.

    Passages are encoded on the executors; the driver gets the passage vectors of the sample, about ``most_bytes``
    at most: of a sample that has more, a share chosen by a hash.
    Without rows of both labels the score is the share of label 1 (0.5 if there are no rows).
    """
    encoder = Encoder()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = encoder.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([b.astype(np.float16).tobytes() for b in bags], pa.binary())], ["doc_id", "label", "bag"])

    sample = labelled_text(docs, labels, label, learn, per_class).select("doc_id", "label", "text")
    rows = bounded(sample.mapInArrow(run, "doc_id long, label int, bag binary"), F.octet_length("bag"), most_bytes).toPandas().sort_values(["doc_id", "bag"], kind="stable")
    rows = rows[rows["bag"].map(len) > 0]
    y = (rows["label"].to_numpy() > 0).astype(float)
    model = Model()
    if len(y) and y.min() < y.max():
        model.fit([np.frombuffer(b, np.float16).reshape(-1, WIDTH).astype(np.float64) for b in rows["bag"]], y)
    elif len(y):
        model.p["d"][:] = 35.0 if y[0] else -35.0
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every whole text; null, empty and blank texts get the score of no passage.

    Very long texts are read whole, 256 passages at a time. Null ids stay null, repeated rows give rows each, an empty
    table gives no rows; other columns don't matter.
    """
    shared = Shared(docs.sparkSession.sparkContext.broadcast(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value.value
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.score(part.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double")
