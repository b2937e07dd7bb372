"""SimHash near-duplicate groups by a Gray-order hierarchical index.

Fingerprints are computed once a text and equal ones fold into one row, so groups of exact
copies cost nothing further. Candidate groups come from a cover of the bits: two fingerprints
within ``radius`` bits agree on at least ``blocks - radius`` of ``blocks`` blocks, so keying each
fingerprint by every choice of that many blocks puts every such pair into some common group
(no pair is lost). Inside a group the fingerprints are sorted by Gray rank; runs of ``FAN`` form the
leaves of an index and ``FAN`` nodes an upper node, up to the group. The bits that all below a node share are
factored into it, with their pattern. Going down, a pair of nodes adds up the differences in the bits that both
share and their parents didn't; once these exceed ``radius`` all pairs below are pruned.

A group that outgrows ``GROUP_ROWS`` is keyed again by a finer cover while there
is one that loses no pair; after that it is dealt out in blocks, and every pair of blocks that isn't
one component already is a group of its own, so the size of a group never decides what is found.

A group gives back one link a fingerprint (to its local root), never all pairs, and connected
components follow by alternating large-star and small-star joins, checkpointed each round.

Where a similarity is asked for, fingerprints only propose: the texts of each component so found are
compared again by their whole shingle multisets, in the pairs that the index gives, and only verified links count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import SLICE_BYTES, slices
from tessera.llm.common import checkpoint, id_and_text, small_side

FAN = 8
#: Rows of a candidate group from which it is keyed again by a finer cover, or dealt out in blocks.
GROUP_ROWS = 20_000
#: Bytes of shingle hashes that weigh as much as a row of a group: a group has 8 MB of them at most.
ROW_WEIGHT = 400
#: Bytes of shingle hashes of small groups that are compared in one go.
SET_BYTES = 2_000_000
#: Pairs of nodes taken down a level at once: the bound of a task's working memory.
CHUNK = 2_000


# -- fingerprints ---------------------------------------------------------------------------


def shingle_hashes(text: str, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each ``size``-word shingle, repeats included; fewer words: of the whole sequence."""
    words = text.encode().lower().split()  # bytes: lowers A-Z and splits at ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, seed)], np.uint64)
    spans = zip(starts[: 1 - size or None].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], seed) for a, b in spans), np.uint64, len(words) - size + 1)


_BASE = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_shingles(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the ``size``-word shingles of all texts, and how many each text has.

    Words are hashed as polynomials of their bytes, over all texts at once, for uses that fix no
    hash function; a text of fewer words than ``size`` has no shingle.
    """
    raw = [t.encode() for t in texts]
    b = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space])))
    starts, ends = edge[::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b + np.uint64(1)) * _powers(len(b), _BASE))])
    words = (sums[ends] - sums[starts]) * _powers(len(b), pow(_BASE, -1, 1 << 64))[starts]
    words = remix(words, 1)
    text = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, side="right")
    n = max(0, len(words) - size + 1)
    h = words[:n].copy()
    for k in range(1, size):
        h = h * np.uint64(_BASE) + words[k : k + n]
    whole = text[:n] == text[size - 1 :][:n]
    return remix(h[whole], 1), np.bincount(text[:n][whole], minlength=len(texts))


def remix(h: np.ndarray, k: int) -> np.ndarray:
    """Further 64 bits of each hash (k = 0: the hash itself)."""
    if k == 0:
        return h
    with np.errstate(over="ignore"):
        x = h + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def simhash(h: np.ndarray, words: int = 1) -> list[int]:
    """Signed 64-bit words: a bit is 1 if it is set in over half the hashes. No hash: zero."""
    out = []
    for k in range(words):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), 65_536):
            raw = remix(h[at : at + 65_536], k).astype(">u8").view(np.uint8)
            ones += np.unpackbits(raw).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big", signed=True))
    return out


def fingerprints(docs: DataFrame, shingle_words: int = 4, words: int = 1, with_text: bool = False) -> DataFrame:
    """``doc_id, w0 .. w{words-1}`` of every whole text; null and blank texts have zeros.

    ``with_text`` adds ``mark``, a hash of the shingles with their counts, which tells texts with one fingerprint apart.
    """
    names = [f"w{k}" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                hashes = [shingle_hashes(t.as_py(), shingle_words) for t in part.column(1)]
                found = [simhash(h, words) for h in hashes]
                columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(words)]
                if with_text:
                    columns.append(pa.array([xxhash.xxh64_intdigest(np.sort(h).tobytes()) - (1 << 63) for h in hashes], pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", *names, *["mark"] * with_text])

    return id_and_text(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in [*names, *["mark"] * with_text]))


# -- covers ---------------------------------------------------------------------------------


def cover(radius: int, blocks: int) -> list[int]:
    """Masks over 64 bits; any two values within ``radius`` bits agree under at least one."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(block, blocks - radius)]


def covers(radius: int, rows: int) -> list[list[int]]:
    """Covers from coarse to fine: the first fits ``rows``, the others split groups that grow hot.

    The key has about 64 * (blocks - radius) / blocks bits; the coarsest cover with about 4,096
    rows a key or fewer, were bits even, has the fewest copies of each row.
    """
    fine = [b for b in range(radius + 1, radius + 5)]
    first = next((b for b in fine if rows / 2 ** (64 * (b - radius) // b) <= 4_096), fine[-1])
    return [cover(radius, b) for b in fine if b >= first]


def sampled_masks(words: int, bits: int, tables: int, seed: int = 11) -> list[list[int]]:
    """``tables`` random choices of ``bits`` of the 64 * words bits, as one mask a word."""
    draw = np.random.default_rng(seed)
    out = []
    for _ in range(tables):
        masks = [0] * words
        for bit in draw.choice(64 * words, bits, replace=False).tolist():
            masks[bit // 64] |= 1 << bit % 64
        out.append(masks)
    return out


# -- the index inside a group -----------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each value in the order of the reflected Gray code."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Link a[i] with b[i] in place; a label is the least index of its component."""
    while True:
        la, lb = labels[a], labels[b]
        if (la == lb).all():
            return
        least = np.minimum(la, lb)
        np.minimum.at(labels, la, least)
        np.minimum.at(labels, lb, least)
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


@dataclass
class Level:
    """Nodes of an index over many groups: ``sizes`` counts those of each group, which follow each other.

    ``shared`` and ``pattern`` are the bits that all below a node have in common; its children are
    ``count`` nodes of the level below from ``first`` on, ``parent`` is its node of the level above.
    """

    sizes: np.ndarray
    shared: np.ndarray
    pattern: np.ndarray
    first: np.ndarray
    count: np.ndarray
    parent: np.ndarray


def index_levels(rows: np.ndarray, sizes: np.ndarray) -> list[Level]:
    """The rows (n x words, groups of ``sizes`` one after another) and the levels above them."""
    none = np.empty(0, np.int64)
    levels = [Level(sizes, np.full_like(rows, ~np.uint64(0)), rows, none, none, none)]
    all_of = any_of = rows
    while sizes.max(initial=0) > FAN:
        counts = -(-sizes // FAN)
        place = np.cumsum(sizes) - sizes - FAN * (np.cumsum(counts) - counts)
        at = np.repeat(place, counts) + FAN * np.arange(counts.sum())
        number = np.diff(np.append(at, len(all_of)))
        all_of, any_of = np.bitwise_and.reduceat(all_of, at), np.bitwise_or.reduceat(any_of, at)
        shared = ~(all_of ^ any_of)
        levels[-1].parent = np.repeat(np.arange(len(at)), number)
        levels.append(Level(counts, shared, all_of & shared, at, number, none))
        sizes = counts
    return levels


def product(first_a: np.ndarray, n_a: np.ndarray, first_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (a, b) of each pair of ranges, and how many each pair has."""
    total = n_a * n_b
    k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    wide = np.repeat(n_b, total)
    a = k // wide
    return np.repeat(first_a, total) + a, np.repeat(first_b, total) + k - a * wide, total


def near_pairs(rows: np.ndarray, sizes: np.ndarray, radius: int, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i < j, of one group and within the radius, that ``labels`` doesn't hold as linked when they come up."""
    levels = index_levels(rows, sizes)
    top = levels[-1]
    begin = np.cumsum(top.sizes) - top.sizes
    i, j, _ = product(begin, top.sizes, begin, top.sizes)
    keep = i < j if len(levels) == 1 else i <= j
    stack = [(len(levels) - 1, i[keep], j[keep], np.zeros(int(keep.sum()), np.int64))]
    while stack:
        level, i, j, apart = stack.pop()
        if len(i) > CHUNK and level:
            stack += [(level, i[CHUNK:], j[CHUNK:], apart[CHUNK:])]
            i, j, apart = i[:CHUNK], j[:CHUNK], apart[:CHUNK]
        own = levels[level]
        fresh = own.shared[i] & own.shared[j]
        if level + 1 < len(levels):  # bits that the parents share are added up already
            up = levels[level + 1].shared
            fresh &= ~(up[own.parent[i]] & up[own.parent[j]])
        apart = apart + np.bitwise_count((own.pattern[i] ^ own.pattern[j]) & fresh).sum(axis=-1, dtype=np.int64)
        ok = apart <= radius
        if level == 0:
            ok &= labels[i] != labels[j]
        elif level == 1 and len(i):  # a pair of leaves that already is one component has nothing to add
            low, high = np.minimum.reduceat(labels, own.first), np.maximum.reduceat(labels, own.first)
            ok &= ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))
        i, j, apart = i[ok], j[ok], apart[ok]
        if level == 0:
            if len(i):
                yield i, j
            continue
        a, b, total = product(own.first[i], own.count[i], own.first[j], own.count[j])
        keep = a < b if level == 1 else a <= b
        stack.append((level - 1, a[keep], b[keep], np.repeat(apart, total)[keep]))


class ShingleSets:
    """Sets of shingle hashes of many rows, as numbers from 0, for similarities of one row with others."""

    def __init__(self, raw: list[bytes]):
        self.sizes = np.array([len(x) // 4 for x in raw], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        values, ids = np.unique(np.frombuffer(b"".join(raw), np.uint32), return_inverse=True)
        self.ids = ids.astype(np.int32)
        self.marked = np.zeros(len(values), bool)

    def similarity(self, i: int, js: np.ndarray) -> np.ndarray:
        own = self.ids[self.begin[i] : self.begin[i] + self.sizes[i]]
        self.marked[own] = True
        size = self.sizes[js]
        at = np.repeat(self.begin[js] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        common = np.bincount(np.repeat(np.arange(len(js)), size), self.marked[self.ids[at]], len(js))
        self.marked[own] = False
        either = len(own) + size - common
        return np.where(either > 0, common / np.maximum(either, 1), 1.0)


def group_links(key: np.ndarray, node: np.ndarray, rows: np.ndarray, radius: int, raw: list[bytes] | None = None, similarity: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """One (node, root) link for each row that is linked to another of its key's rows.

    Rows link within ``radius``; with ``raw``, their shingle sets, only at ``similarity`` or more.
    """
    order = np.lexsort((gray_rank(rows[:, 0]), key))
    key, node, rows = key[order], node[order], rows[order]
    sizes = np.diff(np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key)))
    labels = np.arange(len(key))
    sets = ShingleSets([raw[k] for k in order.tolist()]) if raw is not None else None
    for i, j in near_pairs(rows, sizes, radius, labels):
        if sets is None:
            join_labels(labels, i, j)
            continue
        long, short = np.maximum(sets.sizes[i], sets.sizes[j]), np.minimum(sets.sizes[i], sets.sizes[j])
        able = short >= similarity * long
        turn = np.argsort(i[able], kind="stable")
        i, j = i[able][turn], j[able][turn]
        for lo, hi in pairwise([*np.flatnonzero(np.diff(i, prepend=-1)).tolist(), len(i)]):
            others = j[lo:hi][labels[j[lo:hi]] != labels[i[lo]]]
            for at in range(0, len(others), FAN * FAN):  # what the first ones link needs no further look
                part = others[at : at + FAN * FAN]
                part = part[labels[part] != labels[i[lo]]]
                if len(part):
                    part = part[sets.similarity(int(i[lo]), part) >= similarity]
                    join_labels(labels, np.full(len(part), i[lo]), part)
    at = np.flatnonzero((labels != np.arange(len(labels))) & (node != node[labels]))
    return node[at], node[labels[at]]


def links_of(groups: DataFrame, words: int, radius: int, similarity: float = 0.0) -> DataFrame:
    """``u, v`` (u > v) links inside the groups ``key, node, w0 ..`` (and ``shingles``, if they decide)."""
    names = [f"w{k}" for k in range(words)]
    exact, most = "shingles" in groups.columns, SET_BYTES

    def links(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The links of whole groups; where their shingles are at hand, of as many groups at a time as have few bytes of them."""
        whole = pa.Table.from_batches(parts)
        ends = [0, len(whole)]
        if exact:
            size = np.cumsum(pc.binary_length(whole.column("shingles")).to_numpy())
            last = np.flatnonzero(np.diff(whole.column("key").to_numpy(), append=0)) + 1  # a group ends before each
            last = np.union1d(last, len(whole))
            step = size[last - 1] // most
            ends = [0, *last[np.flatnonzero(np.diff(step, append=step[-1] + 1))].tolist()]
        for a, b in pairwise(ends):
            t = whole.slice(a, b - a)
            col = lambda n: t.column(n).to_numpy()  # noqa: B023, E731
            rows = np.stack([col(n).view(np.uint64) for n in names], axis=1)
            u, v = group_links(col("key"), col("node"), rows, radius, t.column("shingles").to_pylist() if exact else None, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of the key that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if held and held[-1].column(0)[-1].as_py() != key[-1] or cut:
                yield from links([*held, batch.slice(0, cut)])
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from links(held)

    rows = groups.select("key", "node", *names, *["shingles"] * exact)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long")


# -- groups over the whole table ------------------------------------------------------------------


def near_links(nodes: DataFrame, words: int, radius: int, levels: list[list[list[int]]]) -> DataFrame:
    """``u, v`` (u > v) links whose components are those of all pairs that share a key and are near.

    ``nodes`` has ``node long, w0 ..``; ``levels`` has masks a word for each key, from coarse to fine.
    A finer level takes the hot keys of the one before, so it must lose no pair of theirs; the hot keys of the
    last one are compared block by block (``hot_links``).
    """
    names = [f"w{k}" for k in range(words)]

    def keyed(df: DataFrame, masks: list[list[int]], *above) -> DataFrame:
        signed = lambda m: m - 2**64 if m >= 2**63 else m
        keys = [F.xxhash64(F.lit(t), *above, *[F.col(n).bitwiseAND(F.lit(signed(m)).cast("long")) for n, m in zip(names, ms, strict=True)]) for t, ms in enumerate(masks)]
        return df.select(F.explode(F.array(*keys)).alias("key"), "node", *names, F.lit(1).cast("long").alias("weight"))

    found, todo = None, keyed(nodes, levels[0])
    for depth in range(len(levels)):
        part, more = sorted_out(todo, words, radius)
        found = part if found is None else found.unionByName(part)
        if more is None:
            return found.distinct()
        if depth + 1 < len(levels):
            todo = keyed(more, levels[depth + 1], F.col("key"))
    return hot_links(found, more, words, radius)


def sorted_out(groups: DataFrame, words: int, radius: int, similarity: float = 0.0) -> tuple[DataFrame, DataFrame | None]:
    """The links of groups that weigh up to ``GROUP_ROWS``, and the rows of the others with their group's weight ``n``."""
    sizes = checkpoint(groups.groupBy("key").agg(F.sum("weight").alias("n")).where(F.col("n") > GROUP_ROWS))
    if sizes.isEmpty():
        return links_of(groups, words, radius, similarity), None
    groups = checkpoint(groups)
    return links_of(groups.join(sizes, "key", "left_anti"), words, radius, similarity), groups.join(sizes, "key")


def hot_links(found: DataFrame, hot: DataFrame, words: int, radius: int, similarity: float = 0.0) -> DataFrame:
    """``found`` and the links of groups too heavy for one task (``key, node, w0 .., weight, n``).

    First each block of a group is linked by itself; then one row of each component, in blocks again, which makes
    one component of a family however many blocks it fills; then every pair of blocks that may have more to add.
    """
    hot = checkpoint(hot)
    dealt = lambda df, salt: df.withColumn("key", F.xxhash64("key", _block(F.col("n"), F.lit(salt), "key", "node")))
    found = checkpoint(found.unionByName(links_of(dealt(hot, 0), words, radius, similarity)).distinct())
    leads = hot.join(components(found), "node", "left_anti").drop("n")
    leads = leads.join(leads.groupBy("key").agg(F.sum("weight").alias("n")), "key")
    found = checkpoint(found.unionByName(links_of(dealt(leads, 1), words, radius, similarity)).distinct())
    return found.unionByName(links_of(block_pairs(hot, components(found)), words, radius, similarity)).distinct()


def _block(n, *by):
    """A block of about ``GROUP_ROWS / 2`` of a weight of ``n``: two of them make a group."""
    return F.pmod(F.xxhash64(*by, F.lit(5)), F.ceil(n * 2 / GROUP_ROWS))


def block_pairs(hot: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``hot`` (``key, node, w0 .., weight, n``) once for each pair of blocks of their key, ``key`` naming the pair.

    ``roots`` (``node, root``) are the components known so far. A component with more than half of
    ``GROUP_ROWS`` in a key has blocks of its own, the others share the rest by a hash of the node. Two
    blocks of one component have nothing to add; every other pair of blocks, and every mixed block with
    itself, is a group. So a large family costs its rows times the blocks of what isn't in it yet.
    """
    held = [c for c in hot.columns if c not in ("key", "node", "n", "weight")]
    rooted = hot.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    large = rooted.groupBy("key", "root").agg(F.sum("weight").alias("n_root")).where(F.col("n_root") > GROUP_ROWS // 2)
    own = F.col("n_root").isNotNull()
    of = F.when(own, F.col("root"))
    block = F.when(own, _block(F.col("n_root"), "node")).otherwise(_block(F.col("n"), "node"))
    rows = checkpoint(rooted.join(large, ["key", "root"], "left").select("key", "node", *held, of.alias("of"), F.xxhash64(of.isNull(), of, block).alias("block")))
    blocks = rows.select("key", "of", "block").distinct()
    one, other = (blocks.select("key", F.col("of").alias(f"of_{x}"), F.col("block").alias(f"block_{x}")) for x in "ab")
    new = ~F.coalesce(F.col("of_a") == F.col("of_b"), F.lit(False))
    pairs = one.join(other, "key").where((F.col("block_a") <= F.col("block_b")) & new)
    pairs = pairs.withColumn("pair", F.xxhash64("key", "block_a", "block_b"))
    sides = pairs.select("key", F.explode(F.array_distinct(F.array("block_a", "block_b"))).alias("block"), "pair")
    return rows.join(sides, ["key", "block"]).select(F.col("pair").alias("key"), "node", *held)


# -- components -----------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every linked node that isn't its component's least one.

    ``links`` has u > v. Large-star and small-star take turns until nothing changes; the number
    of rounds grows with the logarithm of the longest chain. Minima are aggregated on the map side
    and written before they are joined, so a hub's links are split by the skew join.
    """
    links = checkpoint(links.distinct())
    before = None
    while True:
        state = links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if state == before or not state[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = links.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(links.select(F.col("v").alias("a"), F.col("u").alias("b")))
        least = checkpoint(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = checkpoint(both.where("b > a").join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct())
        least = checkpoint(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = checkpoint(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())


# -- verification ---------------------------------------------------------------------------------


def occurrences(h: np.ndarray) -> np.ndarray:
    """Sorted 32-bit hashes of the shingles with their number among equal ones: sets whose Jaccard similarity is the weighted one.

    In two texts of a thousand shingles one pair of different ones in 4,000 texts meets by chance, and counts as one of the thousand.
    """
    h = np.sort(h)
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    nth = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
    with np.errstate(over="ignore"):
        return np.sort((remix(h + nth.astype(np.uint64) * np.uint64(_BASE), 3) >> np.uint64(32)).astype(np.uint32))


def verified_links(docs: DataFrame, roots: DataFrame, shingle_words: int, words: int, radius: int, similarity: float) -> DataFrame:
    """``u, v`` links of nodes of one component (``roots``: ``node, root``) whose texts are at least ``similarity`` similar.

    Only texts of components with more than one node are read again. A component is a group; one that is too
    heavy for a task is compared block by block.
    """
    names = [f"w{k}" for k in range(words)]
    members = checkpoint(roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, SLICE_BYTES):
                hashes = [shingle_hashes(t, shingle_words) for t in part.column(1).to_pylist()]
                sets = [occurrences(h).tobytes() for h in hashes]
                prints = [simhash(h, words) for h in hashes]
                columns = [part.column(2), part.column(0), *[pa.array([f[k] for f in prints], pa.int64()) for k in range(words)]]
                marks = pa.array([xxhash.xxh64_intdigest(x) - (1 << 63) for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([*columns, marks, pa.array(sets, pa.binary())], ["key", "node", *names, "mark", "shingles"])

    texts = id_and_text(docs).join(small_side(members.select(F.col("node").alias("doc_id"), "root")), "doc_id").select("doc_id", "text", "root")
    rows = texts.mapInArrow(run, f"key long, node long, {', '.join(f'{n} long' for n in names)}, mark long, shingles binary")
    once = rows.groupBy("key", "node", *names, "mark").agg(F.first("shingles").alias("shingles"))  # rows that repeat an id and its text
    weighed = once.withColumn("weight", F.lit(1) + F.floor(F.octet_length("shingles") / ROW_WEIGHT)).drop("mark")
    found, hot = sorted_out(checkpoint(weighed), words, radius, similarity)
    return found.distinct() if hot is None else hot_links(found, hot, words, radius, similarity)


# -- the operator -----------------------------------------------------------------------------


def near_duplicate_groups(
    docs: DataFrame,
    shingle_words: int = 4,
    words: int = 1,
    radius: int = 4,
    sampled: tuple[int, int] | None = None,
    similarity: float | None = None,
) -> DataFrame:
    """``doc_id, w0 .., component_id``: component_id is the least doc_id reachable by links.

    Texts link if their fingerprints (64 * ``words`` bits) differ in ``radius`` bits or fewer and, with
    ``similarity``, if the weighted Jaccard similarity of their shingles, repeats counted, is that or more.
    With ``sampled`` None (one word only) every pair within the radius is found. ``sampled=(bits, tables)``
    keys longer fingerprints by that many random choices of bits, for radii too wide for a cover;
    a pair at a share p of differing bits is then found with probability 1 - (1 - (1-p)^bits)^tables,
    however many rows share its keys.

    Null and blank texts have fingerprint zero and no shingles and link like any other; very long texts count whole.
    Rows that share a doc_id are one node; a null doc_id takes no part as a root and gets the component of its fingerprint
    (null if no row with an id has it). Repeated rows stay. An empty table gives no rows.
    """
    names = [f"w{k}" for k in range(words)]
    prints = checkpoint(fingerprints(docs, shingle_words, words, with_text=similarity is not None))
    same_text = [c for c in prints.columns if c != "doc_id"]
    nodes = checkpoint(prints.groupBy(*same_text).agg(F.min("doc_id").alias("node")))
    known = nodes.where(F.col("node").isNotNull()).select("node", *names)
    if sampled is None:
        levels = [[[m] for m in masks] for masks in covers(radius, known.count())]
    else:
        bits, tables = sampled
        levels = [sampled_masks(words, bits, tables)]
    roots = components(near_links(known, words, radius, levels))
    if similarity is not None:
        roots = components(verified_links(docs, roots, shingle_words, words, radius, similarity))
    named = nodes.join(roots, "node", "left").select(*[F.col(n).alias(f"r_{n}") for n in same_text], F.coalesce("root", "node").alias("component_id"))
    same = F.lit(True)
    for n in same_text:
        same = same & (F.col(n) == F.col(f"r_{n}"))
    return prints.join(named, same).select("doc_id", *names, "component_id")


def one_of_each_group(
    docs: DataFrame, shingle_words: int = 5, words: int = 4, radius: int = 56, sampled: tuple[int, int] | None = (14, 96), similarity: float | None = 0.8
) -> DataFrame:
    """The rows of the least doc_id of each group of near-duplicates, with all their columns.

    The defaults take five-word shingles and a similarity of 0.8. Two texts that similar differ in
    39 of 256 bits on average, with a standard deviation of 5.7, so 56 bits propose all but 1 in 700 of the pairs that lie exactly
    there; keys of 14 bits in 96 tables miss about 1 in 1,000 of them. Above 0.85 next to nothing is lost, and no pair below 0.8 links.
    Rows without an id stay; rows that repeat an id are one document and stay or go together. An empty table gives no rows.
    """
    groups = near_duplicate_groups(docs.where(F.col("doc_id").isNotNull()), shingle_words, words, radius, sampled, similarity)
    gone = checkpoint(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct())
    return docs.select(F.struct("*").alias("row")).join(small_side(gone), F.col("row.doc_id").cast("long") == F.col("gone_id"), "left_anti").select("row.*")
