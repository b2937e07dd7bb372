"""Registries of type trees (A21, A22): files that hold the trees of every class by engine version.

A registry is a few MB whatever the corpus. Its trees become rows ``class_id, since, tree`` and
objects whose file was stripped of its trees find theirs by an as-of lookup on the version.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.operators import relational as R
from tessera.sources import typetree as tt
from tessera.sources.assets import _flat_map
from tessera.sources.binary import Cursor, brotli_unpack, lzma_unpack, unpack

# The head of a registry file, its codecs and its kinds of content.
MAGIC, VERSION = 0x2A4B5054, 1
PLAIN, LZ4, LZMA, BROTLI = range(4)
TYPE_TREES, COLLECTION, FILE_SYSTEM, JSON = range(4)
#: Codec number of LZ4 blocks among the codecs of containers.
BLOCK_LZ4 = 2
HAS_EDITOR, HAS_RELEASE = 64, 128

TREES = "path string, class_id int, since bigint, name string, base string, flags int, tree string, error string"
STRINGS = "path string, since bigint, strings array<string>"


def _text(c: Cursor) -> str:
    """A string after its length in groups of seven bits, lowest first."""
    size = shift = 0
    while True:
        b = c.read("u8")
        size |= (b & 0x7F) << shift
        if b < 0x80:
            return c.take(size).decode()
        shift += 7


def _signed(version: int) -> int:
    """A version as a bigint; the parts of real ones leave the sign bit free."""
    return version - (1 << 64) if version >> 63 else version


def open_registry(data: bytes) -> tuple[int, bytes]:
    """Kind and content of a registry file."""
    c = Cursor(data, "<")
    magic, version, codec, kind, _, _, packed, size = c.read("u32", "u8", "u8", "u8", "u8", "u32", "u32", "u32")
    if magic != MAGIC or version != VERSION:
        raise ValueError("this is no registry")
    raw = c.take(packed)
    if codec == PLAIN:
        return kind, raw
    if codec == LZ4:
        return kind, unpack(raw, size, BLOCK_LZ4)
    if codec == LZMA:
        return kind, lzma_unpack(raw, size)
    if codec == BROTLI:
        return kind, brotli_unpack(raw)
    raise ValueError(f"codec {codec} is unknown")


def contents(kind: int, c: Cursor, path: str = "") -> Iterator[tuple[str, int, object]]:
    """(path, kind, content) of a registry; collections give those of all their members."""
    if kind == COLLECTION:
        for _ in range(c.read("i32")):
            name = _text(c)
            yield from contents(c.read("i8"), c, f"{path}/{name}" if path else name)
    elif kind == FILE_SYSTEM:
        for _ in range(c.read("i32")):
            name = _text(c)
            yield f"{path}/{name}" if path else name, kind, c.take(c.read("i32"))
    elif kind == JSON:
        yield path, kind, _text(c)
    elif kind == TYPE_TREES:
        yield path, kind, read_trees(c)
    else:
        raise ValueError(f"content of kind {kind} can't be read")


class Trees:
    """Classes by version, nodes and strings, as a registry holds them."""

    def __init__(self) -> None:
        self.created = 0
        self.versions: list[int] = []
        #: class id, since which version, and (name, base, flags, editor root, release root) or None.
        self.classes: list[tuple[int, int, tuple | None]] = []
        #: Number of common strings since a version, and all of them as places in ``strings``.
        self.common: list[tuple[int, int]] = []
        self.common_places: list[int] = []
        #: type, name, byte size, version, type flags, meta flag, children.
        self.nodes: list[tuple] = []
        self.strings: list[str] = []

    def tree(self, root: int) -> tt.Node:
        """The tree below a node: nodes are shared, so each visit makes a new one."""
        out: list[tt.Node] = []
        todo = [(root, 0)]
        while todo:
            at, level = todo.pop()
            kind, name, size, version, flags, meta, children = self.nodes[at]
            out.append(tt.Node(level, self.strings[kind], self.strings[name], size, version, flags, meta, len(out)))
            todo.extend((k, level + 1) for k in reversed(children))
        return tt.link(out)


def read_trees(c: Cursor) -> Trees:
    t = Trees()
    t.created = c.read("i64")
    t.versions = c.many("u64", c.read("i32"))
    for _ in range(c.read("i32")):
        class_id, count = c.read("i32", "i32")
        for _ in range(count):
            since, present = c.read("u64", "u8")
            found = None
            if present:
                name, base, flags = c.read("u16", "u16", "u8")
                found = (name, base, flags, c.read("u16") if flags & HAS_EDITOR else None, c.read("u16") if flags & HAS_RELEASE else None)
            t.classes.append((class_id, since, found))
    t.common = [c.read("u64", "u8") for _ in range(c.read("i32"))]
    t.common_places = c.many("u16", c.read("i32"))
    for _ in range(c.read("i32")):
        *own, count = c.read("u16", "u16", "i32", "i16", "u8", "u32", "u16")
        t.nodes.append((*own, c.many("u16", count)))
    t.strings = [_text(c) for _ in range(c.read("i32"))]
    return t


# -- as DataFrames --------------------------------------------------------------------------------------


def _registries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def type_trees(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, class_id, since, name, base, flags, tree, error``: a row for each class and version.

    ``since`` orders like ``columns.version_key``; ``tree`` is the release tree as JSON, null where the
    class isn't there from that version on. A file that can't be read is a row with its error.
    """

    def each(r: dict) -> Iterator[tuple]:
        try:
            kind, raw = open_registry(r["content"])
            found = [t for _, k, t in contents(kind, Cursor(raw, "<")) if k == TYPE_TREES]
        except Exception as error:  # noqa: BLE001  the row says what is wrong
            yield r["path"], *[None] * 6, f"{type(error).__name__}: {error}"
            return
        for t in found:
            for class_id, since, own in t.classes:
                name, base, flags, _, root = own or (None,) * 5
                tree = None if root is None else json.dumps(tt.to_dicts(t.tree(root)))
                yield r["path"], class_id, _signed(since), None if name is None else t.strings[name], None if base is None else t.strings[base], flags, tree, None

    return _flat_map(_registries(spark, path), TREES, each)


def common_strings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, since, strings``: the shared strings from each version on."""

    def each(r: dict) -> Iterator[tuple]:
        kind, raw = open_registry(r["content"])
        for _, k, t in contents(kind, Cursor(raw, "<")):
            if k == TYPE_TREES:
                for since, count in t.common:
                    yield r["path"], _signed(since), [t.strings[p] for p in t.common_places[:count]]

    return _flat_map(_registries(spark, path), STRINGS, each)


def with_registry(objects: DataFrame, trees: DataFrame) -> DataFrame:
    """``objects`` with the registry's tree where their file has none.

    The lookup is by distinct (class, engine), so payloads don't take part in it: the last entry that
    isn't after the engine's version counts, and one that has no tree gives none.
    """
    asked = objects.where("tree IS NULL AND class_id IS NOT NULL AND engine IS NOT NULL").select("class_id", "engine").distinct()
    asked = asked.withColumn("since", C.version_key(C.version_parts(F.col("engine")))).where("since IS NOT NULL")
    entries = trees.where("error IS NULL").select("class_id", "since", F.struct("tree").alias("entry"), F.coalesce("name", F.lit("")).alias("tie"))
    found = R.asof(asked, entries, "class_id", "since", ["entry"], "tie")
    found = found.select(F.col("class_id").alias("__class"), F.col("engine").alias("__engine"), F.col("entry.tree").alias("__tree")).where("__tree IS NOT NULL")
    joined = objects.join(found, (F.col("class_id") == F.col("__class")) & (F.col("engine") == F.col("__engine")), "left")
    return joined.select(*[F.coalesce("tree", "__tree").alias("tree") if c == "tree" else F.col(c) for c in objects.columns])
