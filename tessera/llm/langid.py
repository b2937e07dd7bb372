"""Language identification in two steps: the family, then the language within it.

Both steps are one-versus-one linear support vector machines over hashed character n-grams
(1 to 4 letters of a word, with its edges). A text's features are relative frequencies, so a
margin is the sum of its words' margins over the number of n-grams; a worker remembers the
margins of words it has seen, and whole texts cost one lookup a word. The model is trained on a
bounded sample of labelled rows and broadcast (a few MB, whatever the corpus); scoring is one pass
without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import Shared, slices
from tessera.llm.common import bounded, id_and_text, per_class_sample

# The families of languages. A language that isn't listed is a family of its own.
FAMILIES: dict[str, list[str]] = {
    "germanic": ["af", "da", "de", "en", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["bg", "cs", "hr", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
}
BUCKETS = 1 << 16
LONGEST = 4
CACHE_WORDS, CACHE_LETTERS = 300_000, 6_000_000
#: Letters whose n-grams are held at once.
STEP_LETTERS = 500_000
UNKNOWN = "und"
_words = re.compile(r"[^\W\d_]+").findall


def family(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of words between their edges, word after word, and how many each word has."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer(f" {'  '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(codes))  # letters to the word's end, this one included
    word = np.repeat(np.arange(len(words)), size)
    h, buckets, of = np.zeros(len(codes), np.uint64), [], []
    for n in range(1, LONGEST + 1):
        h = h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(n)
        whole = left[: len(h)] >= n
        mixed = (h[whole] ^ h[whole] >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        buckets.append((mixed >> np.uint64(32)).astype(np.int64) % BUCKETS)
        of.append(word[: len(h)][whole])
    every = np.concatenate(of)
    return np.concatenate(buckets)[np.argsort(every, kind="stable")], np.bincount(every, minlength=len(words))


def frequencies(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their relative frequencies."""
    words = _words(text.lower())
    found = grams(words)[0] if words else np.empty(0, np.int64)
    buckets, counts = np.unique(found, return_counts=True)
    return buckets, counts / max(1, len(found))


def linear_svm(rows: list[tuple[np.ndarray, np.ndarray]], sides: np.ndarray, cost: float = 50.0, epochs: int = 12, seed: int = 5) -> np.ndarray:
    """Weights (the last is the intercept) of a linear SVM by dual coordinate descent; sides are 1 or -1.

    The cost of a side is weighted by how rare it is.
    """
    w = np.zeros(BUCKETS + 1)
    alpha = np.zeros(len(rows))
    square = np.array([float(x @ x) + 1.0 for _, x in rows])
    most = cost * len(rows) / (2 * np.where(sides > 0, (sides > 0).sum(), (sides < 0).sum()))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)).tolist():
            i, x = rows[k]
            g = sides[k] * (w[i] @ x + w[-1]) - 1
            new = min(max(alpha[k] - g / square[k], 0.0), most[k])
            if new != alpha[k]:
                step = (new - alpha[k]) * sides[k]
                w[i] += step * x
                w[-1] += step
                alpha[k] = new
    return w


class Model:
    """One-versus-one machines between families and within each family."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], langs: list[str]):
        self.langs = sorted(set(langs))
        self.members: dict[str, list[str]] = {}
        for x in self.langs:
            self.members.setdefault(family(x), []).append(x)
        groups = [("", sorted(self.members))] + [(f, m) for f, m in sorted(self.members.items())]
        #: (group, first, second): a positive margin speaks for the first.
        self.duels = [(g, a, b) for g, names in groups for a, b in combinations(names, 2)]
        own = np.array(langs, object)
        above = np.array([family(x) for x in langs], object)
        table = []
        for g, a, b in self.duels:
            names = own if g else above
            at = np.flatnonzero((names == a) | (names == b))
            table.append(linear_svm([rows[i] for i in at], np.where(names[at] == a, 1.0, -1.0)))
        self.weights = np.array(table, np.float32).reshape(len(self.duels), BUCKETS + 1)
        self._seen: dict[str, int] = {}
        self._held = 0
        self._margins = np.zeros((0, len(self.duels) + 1), np.float32)

    def __getstate__(self):
        return self.__dict__ | {"_seen": {}, "_held": 0, "_margins": self._margins[:0]}

    def _learn(self, words: list[str]) -> None:
        """Margins and numbers of n-grams of words, a bounded number of letters at a time."""
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        for part in np.split(np.arange(len(words)), np.flatnonzero(np.diff(ends // STEP_LETTERS)) + 1):
            some = words[part[0] : part[-1] + 1]
            found, n = grams(some)
            rows = np.empty((len(some), len(self.duels) + 1), np.float32)
            if self.duels:
                rows[:, :-1] = np.add.reduceat(self.weights.T[found], np.cumsum(n) - n, axis=0)
            rows[:, -1] = n
            self._seen.update(zip(some, range(len(self._margins), len(self._margins) + len(some)), strict=True))
            self._margins = np.concatenate([self._margins, rows])
        self._held += int(ends[-1])

    def _duel(self, group: str, names: list[str], margins: dict[tuple[str, str, str], float]) -> tuple[str, float]:
        """Most votes, then the largest sum of margins, then the first name; and a confidence."""
        if len(names) == 1:
            return names[0], 1.0
        votes = {x: 0 for x in names}
        total = {x: 0.0 for x in names}
        for a, b in combinations(names, 2):
            m = margins[group, a, b]
            votes[a if m >= 0 else b] += 1
            total[a] += m
            total[b] -= m
        best = min(names, key=lambda x: (-votes[x], -total[x], x))
        return best, float(1 / (1 + np.exp(-np.clip(2 * total[best] / (len(names) - 1), -35, 35))))

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        found = [_words(t.lower()) for t in texts]
        every = {w for ws in found for w in ws}
        new = every - self._seen.keys()
        if len(self._seen) + len(new) > CACHE_WORDS or self._held > CACHE_LETTERS:
            self._seen, self._held, self._margins, new = {}, 0, self._margins[:0], every
        if new:
            self._learn(list(new))
        out = []
        for words in found:
            if not self.langs or not any(x.isalpha() for w in words for x in w):  # a superscript digit is no letter
                out.append((UNKNOWN, 0.0))
                continue
            sums = self._margins[np.fromiter(map(self._seen.__getitem__, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
            margins = dict(zip(self.duels, (sums[:-1] / sums[-1] + self.weights[:, -1]).tolist(), strict=True))
            top, p = self._duel("", sorted(self.members), margins)
            lang, q = self._duel(top, self.members[top], margins)
            out.append((lang, p * q))
        return out


def train(docs: DataFrame, learn: Column, per_class: int = 1_200, most_bytes: int = 48_000_000) -> Model:
    """Fit on at most about ``per_class`` rows of each language, where ``learn`` holds.

    Rows without a language, text or id teach nothing. The driver gets the n-gram counts of the sample, about
    ``most_bytes`` at most: of a sample that has more, a share chosen by a hash.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("label"))
    known = rows.where(F.col("label").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & learn)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [frequencies(t.as_py()) for t in batch.column("text")]
            columns = [pa.array([x[0].tobytes() for x in found], pa.binary()), pa.array([x[1].tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *columns], ["doc_id", "label", "buckets", "shares"])

    sample = per_class_sample(known, "label", per_class).select("doc_id", "label", "text")
    got = bounded(sample.mapInArrow(run, "doc_id long, label string, buckets binary, shares binary"), F.octet_length("buckets") * 2, most_bytes)
    got = got.toPandas().sort_values(["doc_id", "label", "buckets"], kind="stable")
    got = got[got["buckets"].map(len) > 0]
    return Model([(np.frombuffer(a, np.int64), np.frombuffer(b, np.float64)) for a, b in zip(got["buckets"], got["shares"], strict=True)], got["label"].tolist())


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score`` of every whole text.

    ``score`` is the product of both steps' confidences, in 0 to 1. A null text or one without a letter
    gives ``und`` and 0.0, as does a model that has learnt nothing. Very long texts are read whole. Null ids stay null, repeated rows
    give rows each, an empty table gives no rows; other columns don't matter.
    """
    shared = Shared(docs.sparkSession.sparkContext.broadcast(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Model = shared.value.value
        for batch in batches:
            for part in slices(batch):
                found = own.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
