"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

The symbols of a word are the leaves. Leaf i holds ``rank << 32 | i`` of the pair that
starts at symbol i, an inner node the smaller of its children, so the root is the leftmost
pair of the lowest rank. A merge changes three leaves, each in logarithmic time; it goes on
until the root holds no mergeable pair. A word of n symbols therefore takes O(n log n),
also where one "word" fills a whole document.

Merging is per word and needs no shuffle: Spark streams whole texts through Arrow batches
and each Python worker keeps a bounded table of the words it has seen.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_and_text

NONE = 1 << 62
#: White-space-free runs a Python worker remembers: those it met in two slices of text. The table is emptied when full.
CACHE_WORDS = 300_000
#: Marks of runs met once, by their hash.
MARKS = 1 << 20
#: Bytes of text that are encoded at once.
SLICE_BYTES = 1_000_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the rest for the code points from 256 on.
    """
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in own}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(own)))
    return [letters[b] for b in range(256)]


def merge_one(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge ``symbols`` by ``pairs`` ((left, right) -> (rank, merged)) until none is left."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = symbols + [-1]
    get = pairs.get
    width = 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * width)
    for i in range(n - 1):
        if found := get((symbols[i], symbols[i + 1])):
            tree[width + i] = found[0] << 32 | i
    for i in range(width - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    after, before = list(range(1, n + 2)), list(range(-1, n))

    def put(i: int, value: int) -> None:
        i += width
        tree[i] = value
        while i > 1:
            least = min(tree[i], tree[i ^ 1])
            i >>= 1
            if tree[i] == least:
                return
            tree[i] = least

    def pair(i: int) -> int:
        found = get((symbols[i], symbols[after[i]]))
        return found[0] << 32 | i if found else NONE

    while (root := tree[1]) < NONE:
        i = root & 0xFFFFFFFF
        j = after[i]
        symbols[i] = get((symbols[i], symbols[j]))[1]
        k = after[i] = after[j]
        before[k] = i
        put(j, NONE)
        put(i, pair(i))
        if i:
            put(before[i], pair(before[i]))
    out, i = [], 0
    while i < n:
        out.append(symbols[i])
        i = after[i]
    return out


class PairTable:
    """Ranks of pairs for arrays: sorted ``left << 32 | right`` keys."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        items = sorted((a << 32 | b, rank) for (a, b), (rank, _) in pairs.items())
        self.keys = np.array([x[0] for x in items] + [1 << 62], np.int64)
        self.ranks = np.array([x[1] for x in items] + [0], np.int64)
        self.merged = np.zeros(len(items) + 1, np.int64)
        for rank, merged in pairs.values():
            self.merged[rank] = merged

    def leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The leaf values of pairs that start at ``at``; a symbol below 0 pairs with nothing."""
        key = left << 32 | right
        k = np.searchsorted(self.keys, key)
        return np.where((self.keys[k] == key) & (right >= 0) & (left >= 0), self.ranks[k] << 8 | at, NONE)


def merge_many(symbols: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """The same for many short words at once, each with a segment tree of its own.

    ``symbols`` is words x width (a power of two, 128 at most), filled up with -1. A round
    does the root's merge in every word that has one. Returns all ids in order, and how many
    each word has.
    """
    count, width = symbols.shape
    s = np.concatenate([symbols, np.full((count, 1), -1)], axis=1)
    alive = symbols >= 0
    tree = np.full((count, 2 * width), NONE)
    tree[:, width:] = table.leaf(s[:, :-1], s[:, 1:], np.arange(width))
    for i in range(width - 1, 0, -1):
        np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
    after = np.tile(np.minimum(np.arange(1, width + 2), width), (count, 1))
    before = np.tile(np.arange(-1, width), (count, 1))
    r = np.flatnonzero(tree[:, 1] < NONE)
    while len(r):
        root = tree[r, 1]
        i = root & 255
        j = after[r, i]
        k = after[r, j]
        s[r, i] = table.merged[root >> 8]
        alive[r, j] = False
        after[r, i] = k
        before[r, k] = i
        h = before[r, i]
        tree[r, width + j] = NONE
        tree[r, width + i] = table.leaf(s[r, i], s[r, k], i)
        some = h >= 0
        rh, h = r[some], h[some]
        tree[rh, width + h] = table.leaf(s[rh, h], s[rh, i[some]], h)
        for rows, at in ((r, i + width), (r, j + width), (rh, h + width)):
            while at.size and at[0] > 1:
                at = at >> 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
        r = r[tree[r, 1] < NONE]
    return s[:, :-1][alive], alive.sum(axis=1)


class Coder:
    """Encoder and decoder for a byte-level BPE vocabulary with an end-of-word suffix.

    Texts are brought to NFC, white space runs become one space, letters are lower-cased,
    and words are what ``PATTERN`` finds. Special tokens in the raw text keep their ids.
    """

    #: Fixed value: the word pattern of the vocabulary file.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.pairs = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        letters = byte_letters()
        self.inner = np.array([vocab[x] for x in letters])
        self.final = np.array([vocab[x + suffix] for x in letters])
        self.table = PairTable(self.pairs)
        self.find = regex.compile(self.PATTERN).findall
        self.odd_space = regex.compile(r"[\s--[\x20\x09-\x0D]]", regex.V1)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.seen: dict[str, bytes] = {}
        self.met = bytearray(MARKS)

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of each word."""
        out: dict[str, bytes] = {}
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode()
            by_width.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append((w, raw))
        for width, found in by_width.items():
            if width > 128:
                for w, raw in found:
                    b = np.frombuffer(raw, np.uint8)
                    ids = merge_one([*self.inner[b[:-1]].tolist(), int(self.final[b[-1]])], self.pairs)
                    out[w] = np.array(ids, dtype="<u4").tobytes()
                continue
            step = 65_536 // width
            for at in range(0, len(found), step):
                part = found[at : at + step]
                sizes = np.array([len(raw) for _, raw in part])
                b = np.frombuffer(b"".join(raw.ljust(width, b"\0") for _, raw in part), np.uint8).reshape(-1, width)
                symbols = np.where(np.arange(width) < sizes[:, None], self.inner[b], -1)
                rows = np.arange(len(part))
                symbols[rows, sizes - 1] = self.final[b[rows, sizes - 1]]
                ids, counts = merge_many(symbols, self.table)
                raw_ids, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
                out.update((w, raw_ids[a:b]) for (w, _), a, b in zip(part, [0, *ends], ends, strict=False))
        return out

    def chunks(self, text: str) -> list[str]:
        """The lower-cased runs between white space: no word of the pattern crosses one."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if self.odd_space.search(text):
                text = self.odd_space.sub(" ", text)
        for space in "\t\n\x0b\x0c\r":
            text = text.replace(space, " ")
        return text.lower().split(" ")

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.cut.split(t) if self.cut and "<|" in t else [t] for t in texts]
        found = [[x if x in self.special else self.chunks(x) for x in parts] for parts in cut]
        every = set().union(*[x for parts in found for x in parts if not isinstance(x, str)])
        new = every - self.seen.keys()
        if len(self.seen) + len(new) > CACHE_WORDS:
            self.seen.clear()
            self.met = bytearray(MARKS)
            new = every
        pieces = {c: self.find(c) for c in new}
        ids = self.learn({w for ws in pieces.values() for w in ws}).__getitem__
        self.seen.update((c, b"".join(map(ids, ws))) for c, ws in pieces.items())
        ids = self.seen.__getitem__
        out = [b"".join([np.array([self.special[x]], dtype="<u4").tobytes() if isinstance(x, str) else b"".join(map(ids, x)) for x in parts]) for parts in found]
        for c in new:  # most runs never come again
            mark = hash(c) % MARKS
            if len(c) > 64 or not self.met[mark]:
                del self.seen[c]
            self.met[mark] = 1
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> str:
        """The tokens joined by spaces: the vocabulary file states no decoder of its own."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def slices(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text each, so long texts don't add up in memory."""
    start = held = 0
    for i, n in enumerate(pc.binary_length(batch.column(1)).to_pylist()):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


_coders: dict[int, Coder] = {}


def coder_of(shared: Shared) -> Coder:
    """One coder for each Python worker and definition."""
    if shared.key not in _coders:
        _coders.clear()
        _coders[shared.key] = Coder(shared.value.value)
    return _coders[shared.key]


class Shared:
    """A broadcast, and a digest of what it holds that tells a worker whether it has made use of it before."""

    def __init__(self, value, key: int = 0):
        self.value, self.key = value, key


def _definition(docs: DataFrame, vocabulary: str) -> Shared:
    with open(vocabulary, encoding="utf-8") as file:
        text = file.read()
    return Shared(docs.sparkSession.sparkContext.broadcast(text), xxhash.xxh64_intdigest(text.encode()))


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, ids array<int>`` of every whole text.

    ``vocabulary`` is a tokenizer file on the driver; its text (a few MB, fixed) is broadcast.
    Null and empty texts give an empty list; null ids and repeated rows stay as they are.
    """
    shared = _definition(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shared)
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                ids = [np.frombuffer(x, dtype="<i4") for x in coder.encode_batch(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``: the inverse lookup, tokens joined by spaces.

    A null list decodes to an empty text.
    """
    shared = _definition(encoded, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shared)
        for batch in batches:
            texts = [coder.decode(np.array(x or [], dtype="<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids``) in one pass over the texts.

    Each text is encoded, its ids decoded, and both digested in the same task, so no ids are
    shuffled. Empty and null texts give zero tokens and the digests of nothing; very long ones are encoded whole.
    Null ids stay null, repeated rows give rows each, an empty table gives no rows; other columns don't matter.
    """
    shared = _definition(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(shared)
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                raw = coder.encode_batch(part.column(1).to_pylist())
                columns = [
                    part.column(0),
                    pa.array([len(x) // 4 for x in raw], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in raw]),
                    pa.array([hashlib.sha256(coder.decode(x).encode()).hexdigest() for x in raw]),
                ]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x, dtype="<i4") for x in raw], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return id_and_text(docs).mapInArrow(run, schema)
