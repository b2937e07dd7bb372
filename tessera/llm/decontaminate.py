"""Benchmark decontamination: SimHash windows of the items' sizes, found by Hamming blocks.

A text is a sequence of 5-word shingles. For each size that the items have, a window of so
many shingles slides over the whole text, one shingle at a time, and gets a 64-bit SimHash
from running counts of the bits. A window and an item are candidates if their fingerprints
differ in ``radius`` bits or fewer. The multi-index: a fingerprint is four blocks of 16 bits, and
two fingerprints within ``radius`` agree up to ``radius // 4`` bits in at least one block, so a
table a block of all values that near to an item's loses no such pair; the full distance
decides. Each candidate is then verified: the weighted Jaccard similarity of the shingles of a window
of the whole item's size and of the item, repeats counted, must be at least ``similarity``. All starts are
tried to which words put in or left out can shift such a window from where the hit says that it begins.

Sizes go up in steps of a fifth from 10 shingles on (of one below) to ``WIDEST``: an item has fingerprints
of as many sections of the step below as cover it, the last one at its end, and a hit of any of them is
a candidate. Some section is at least about as similar as the whole, wherever the edits are.
At similarity 0.8 two fingerprints differ in 10 bits on average (standard deviation 3), so the
default radius of 15 finds about 97 % of the pairs that lie exactly there, and more above.

A window that shares no shingle with any item has similarity 0 with all of them, so windows are only made
where a text has a shingle that some item has, as far as the widest window reaches from there. This leaves
out no match. An item of fewer than 5 words is found where its words follow each other in a text.

Items are read in blocks of bounded bytes, each broadcast and held against every text; the texts
are neither shuffled nor collected, and hot texts or sources make no group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import Shared, slices
from tessera.llm.common import id_and_text
from tessera.llm.simhash import word_shingles

SHINGLE = 5
#: Bytes of item texts that are broadcast at once.
BLOCK_BYTES = 8_000_000
#: Bound of a section in shingles; longer items have more sections.
WIDEST = 512
#: Windows handled at once: their counts stay in a core's cache.
STEP = 4_096


def window_size(shingles: int) -> int:
    """The section that finds an item of so many shingles: the largest step not above it."""
    size = at = 1
    while at <= min(shingles, WIDEST):
        size, at = at, at + max(1, at // 5)
    return size


def section_starts(shingles: int) -> list[int]:
    """Where the sections of an item begin; together they cover it."""
    size = window_size(shingles)
    return sorted({*range(0, shingles - size, size), shingles - size})


def near_values(radius: int) -> np.ndarray:
    """All 16-bit values with ``radius`` ones or fewer."""
    every = np.arange(1 << 16, dtype=np.uint16)
    return every[np.bitwise_count(every) <= radius]


def ones(h: np.ndarray) -> np.ndarray:
    """The 64 bits of each hash, highest first, as 0 and 1."""
    return np.unpackbits(h.astype(">u8").view(np.uint8)).reshape(-1, 64)


def packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits.ravel()).view(">u8").astype(np.uint64)


def window_counts(bits: np.ndarray, n: int, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, ones in each of the first ``n`` windows of so many rows), sizes going up.

    Counts of 1, 2, 4 .. rows are doubled up once; each size adds the few that it has more.
    """
    last = max(sizes)
    doubled = [bits.astype(np.uint16) if last > 255 else bits]
    while 2 << len(doubled) - 1 <= last:
        d, k = doubled[-1], 1 << len(doubled) - 1
        doubled.append(d[:-k] + d[k:])
    counts, at = np.zeros((n, 64), doubled[0].dtype), 0
    for size in sizes:
        while at < size:
            k = (size - at).bit_length() - 1
            counts = counts + doubled[k][at : at + n]
            at += 1 << k
        yield size, counts


class Items:
    """Fingerprints of benchmark items by window size, and their shingles."""

    def __init__(self, items: list[tuple[int, str]], radius: int, similarity: float):
        self.radius, self.similarity = radius, similarity
        self.ids: list[int] = []
        self.parts: list[tuple[np.ndarray, np.ndarray, int]] = []
        #: Items of fewer words than a shingle: number of words -> hash of them -> items.
        self.few: dict[int, dict[int, list[int]]] = {}
        by_size: dict[int, list[tuple[int, int, int]]] = {}
        for item_id, text in items:
            h, _ = word_shingles([text], SHINGLE)
            if not len(h):
                if words := len(text.encode().split()):
                    own = int(word_shingles([text], words)[0][0])
                    self.few.setdefault(words, {}).setdefault(own, []).append(len(self.ids))
                    self.ids.append(item_id)
                    self.parts.append((h, h, 0))
                continue
            size = window_size(len(h))
            for start in section_starts(len(h)):
                mark = int(packed(2 * ones(h[start : start + size]).sum(axis=0, dtype=np.int64)[None, :] > size)[0])
                by_size.setdefault(size, []).append((mark, len(self.ids), start))
            self.ids.append(item_id)
            self.parts.append((*np.unique(h, return_counts=True), len(h)))
        self.marks = {size: (np.array([m for m, _, _ in found], np.uint64), np.array([k for _, k, _ in found]), np.array([at for _, _, at in found])) for size, found in sorted(by_size.items())}
        self.widest = max(by_size, default=0)
        self.shingles = np.unique(np.concatenate([values for values, _, _ in self.parts])) if self.parts else np.empty(0, np.uint64)
        #: Bits that tell most other shingles apart before the exact lookup.
        self.head = np.uint64(64 - max(16, len(self.shingles).bit_length() + 4))
        self._tables: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"_tables": {}}

    def table(self, size: int) -> np.ndarray:
        """4 x 65536: whether a block's value is near that block of any item of the size."""
        if size not in self._tables:
            out = np.zeros((4, 1 << 16), bool)
            near = near_values(self.radius // 4)
            for b in range(4):
                for value in np.unique(self.marks[size][0] >> np.uint64(16 * b) & np.uint64(0xFFFF)).astype(np.uint16):
                    out[b, near ^ value] = True
            self._tables[size] = out
        return self._tables[size]

    def known(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes that some item has."""
        if -1 not in self._tables:
            heads = np.zeros(1 << 64 - int(self.head), bool)
            heads[self.shingles >> self.head] = True
            self._tables[-1] = heads
        at = np.flatnonzero(self._tables[-1][h >> self.head])
        place = np.minimum(np.searchsorted(self.shingles, h[at]), len(self.shingles) - 1)
        return at[self.shingles[place] == h[at]]

    def stretches(self, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first shingle, end, text) of the parts of texts of ``n`` shingles each that a window with a known shingle reaches."""
        at = self.known(h)
        ends = np.cumsum(n)
        text = np.searchsorted(ends, at, side="right")
        lo, hi = np.maximum(at - self.widest + 1, (ends - n)[text]), np.minimum(at + self.widest, ends[text])
        new = np.ones(len(at), bool)
        new[1:] = lo[1:] >= hi[:-1]
        last = np.append(new[1:], True)[: len(at)]
        return lo[new], hi[last], text[new]

    def candidates(self, h: np.ndarray, real: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(start, item, start of the section in the item) of windows within the radius; starts may lie before a text's first shingle.

        ``h`` holds the hashes of texts with ``widest`` zeros around each, ``real`` counts the
        texts' shingles up to each place.
        """
        for at in range(0, len(h) - self.widest, STEP):
            n = min(STEP, len(h) - self.widest - at)
            for size, counts in window_counts(ones(h[at : at + n + self.widest]), n, list(self.marks)):
                filled = real[at + size : at + size + n] - real[at : at + n]
                half = (filled >> 1).astype(counts.dtype)
                found = packed(counts > half[:, None])
                table = self.table(size)
                blocks = found.view(np.uint16).reshape(-1, 4)  # lowest block first
                hit = table[0][blocks[:, 0]] | table[1][blocks[:, 1]] | table[2][blocks[:, 2]] | table[3][blocks[:, 3]]
                rows = np.flatnonzero(hit & (filled > 0))
                marks, items, sections = self.marks[size]
                for lo in range(0, len(marks), 256):
                    near = np.bitwise_count(found[rows, None] ^ marks[None, lo : lo + 256]) <= self.radius
                    if near.any():
                        i, k = np.nonzero(near)
                        yield at + rows[i], items[lo + k], sections[lo + k]

    def similarities(self, own: np.ndarray, item: int, first: int, last: int) -> np.ndarray:
        """Weighted Jaccard similarity with the item of each window of its size that starts at ``first`` .. ``last`` of a text.

        Windows are cut at the text's ends. A shingle counts in the windows that it is in, but for those that have it
        as often as the item before it. Empty if no window can be similar enough.
        """
        values, counts, n = self.parts[item]
        a, b = max(first, 0), min(last + n, len(own))
        k = np.minimum(np.searchsorted(values, own[a:b]), len(values) - 1)
        at = np.flatnonzero(values[k] == own[a:b])
        if len(at) / n < self.similarity:
            return np.empty(0)
        k = k[at]
        order = np.argsort(k, kind="stable")
        k, at = k[order], at[order] + a
        back = np.arange(len(k)) - counts[k]
        full = np.where((back >= 0) & (k[np.maximum(back, 0)] == k), at[np.maximum(back, 0)], at - n)
        lo, hi = np.maximum(np.maximum(full, at - n) + 1, first), np.minimum(at, last)
        lo, hi = lo[lo <= hi] - first, hi[lo <= hi] - first
        size = last - first + 2
        common = np.cumsum(np.bincount(lo, minlength=size) - np.bincount(hi + 1, minlength=size))[:-1]
        starts = np.arange(first, last + 1)
        return common / (n + np.minimum(starts + n, len(own)) - np.maximum(starts, 0) - common)

    def best(self, own: np.ndarray, item: int, starts: list[int]) -> tuple[float, int, int] | None:
        """(best similarity, its first start, number of windows that match) around the starts that hits give."""
        n = self.parts[item][2]
        slack = int(np.ceil(n * (1 - self.similarity) / (1 + self.similarity)))  # what a similar window may have more or less
        runs: list[list[int]] = []
        for s in sorted(set(starts)):
            if runs and s - slack <= runs[-1][1]:
                runs[-1][1] = s + slack
            else:
                runs.append([s - slack, s + slack])
        best, total = None, 0
        for first, last in runs:
            first, last = max(first, 1 - n), min(last, len(own) - 1)
            near = self.similarities(own, item, first, last) if first <= last else np.empty(0)
            hits = int((near >= self.similarity).sum())
            total += hits
            if hits and (best is None or near.max() > best[0]):
                best = (float(near.max()), max(0, first + int(near.argmax())))
        return best and (*best, total)

    def scan(self, texts: list[str]) -> list[dict[int, tuple[float, int, int]]]:
        """For each text: item -> (best similarity, its first start, number of windows that match)."""
        out: list[dict[int, tuple[float, int, int]]] = [{} for _ in texts]
        for words, items in self.few.items():
            found, n = word_shingles(texts, words)
            first = np.cumsum(n) - n
            at = np.flatnonzero(np.isin(found, np.array(list(items), np.uint64)))
            for p, d in zip(at.tolist(), np.searchsorted(np.cumsum(n), at, side="right").tolist(), strict=True):
                for k in items[int(found[p])]:
                    _, start, count = out[d].get(k, (1.0, p - int(first[d]), 0))
                    out[d][k] = (1.0, start, count + 1)
        if not self.marks:
            return out
        found, n = word_shingles(texts, SHINGLE)
        first = np.cumsum(n) - n
        lo, hi, text = self.stretches(found, n)
        if not len(lo):
            return out
        size = hi - lo
        begin = np.cumsum(size) - size + self.widest * np.arange(1, len(size) + 1)
        end = begin + size
        place = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        h = np.zeros(end[-1] + self.widest, np.uint64)
        h[place] = found[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        real = np.zeros(len(h) + 1, np.int64)
        real[place + 1] = 1
        real = np.cumsum(real)
        shift = (lo - first[text] - begin).tolist()  # from a place in ``h`` to one in its text
        hits: dict[tuple[int, int], list[int]] = {}
        for at, items, sections in self.candidates(h, real):
            # a window that begins before its stretch belongs to the one that it reaches
            stretch = np.searchsorted(end, at, side="right")
            for s, k, d in zip((at - sections).tolist(), items.tolist(), stretch.tolist(), strict=True):
                if d < len(size):
                    hits.setdefault((int(text[d]), k), []).append(s + shift[d])
        for (d, k), starts in hits.items():
            leak = self.best(found[first[d] : first[d] + n[d]], k, starts)
            if leak is not None:
                out[d][k] = leak
        return out


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of about ``BLOCK_BYTES`` of text: what the driver holds and sends at once."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    for k in range(blocks):
        yield sorted((r["item_id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toLocalIterator())


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 15) -> DataFrame:
    """``doc_id, item_id, similarity, start_word, n_windows, text_key``: a row for each leak.

    A text leaks an item if a window of it is at least ``similarity`` similar. ``similarity`` is that
    of the best window, ``start_word`` where it begins (the first of equals), ``n_windows`` how many windows
    match, ``text_key`` the text's xxhash64. Words are split at ASCII white space and A-Z lower-cased.
    An item of fewer than 5 words matches, with similarity 1, where its words follow each other. Null items and those
    without a word match nothing; items with one id and other texts are items each. Null and empty texts leak nothing; very long
    ones are searched whole; null ids stay null; repeated rows give rows each. An empty table on either side gives no rows.
    """
    found = None
    for block in item_blocks(benchmark):
        part = _scan(docs, Items(block, radius, similarity))
        found = part if found is None else found.unionByName(part)
    return found


def _scan(docs: DataFrame, items: Items) -> DataFrame:
    shared = Shared(docs.sparkSession.sparkContext.broadcast(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Items = shared.value.value
        for batch in batches:
            for part in slices(batch, 1_000_000):
                rows = [
                    (d, own.ids[k], s, at, n, key)
                    for d, key, hits in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), own.scan(part.column(1).to_pylist()), strict=True)
                    for k, (s, at, n) in sorted(hits.items())
                ]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    names = ["doc_id", "item_id", "similarity", "start_word", "n_windows", "text_key"]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int64()]
    schema = "doc_id long, item_id long, similarity double, start_word int, n_windows int, text_key long"
    return id_and_text(docs).withColumn("text_key", F.xxhash64("text")).mapInArrow(run, schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, radius: int = 15) -> DataFrame:
    """The rows whose text leaks no item, items with a null id among them, with all their columns; null texts stay."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), "text")
    gone = leaks(docs, items, similarity, radius).select("text_key").distinct()
    rows = docs.select(F.struct("*").alias("row")).withColumn("text_key", F.xxhash64(F.coalesce(F.col("row.text").cast("string"), F.lit(""))))
    return rows.join(gone, "text_key", "left_anti").select("row.*")
