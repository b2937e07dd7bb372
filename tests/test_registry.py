"""Registries of type trees: a made-up one, and objects that find their trees in it."""

import pyarrow as pa
import pytest

from tessera.sources import registry as rg
from tessera.sources import typetree as tt
from tessera.sources.binary import Cursor, Writer, brotli_pack, lzma_pack


def version(*parts):
    return sum(p << s for p, s in zip(parts, (48, 32, 16, 8, 0), strict=False))


def text(w, s):
    raw = s.encode()
    size = len(raw)
    while size > 127:
        w.put("u8", size & 127 | 128)
        size >>= 7
    return w.put("u8", size).raw(raw)


def trees():
    """Class 49: one field from 5.0 on, two from 2019.1 on, gone in 2021.1."""
    strings = ["TextAsset", "Base", "string", "m_Name", "m_Script", "Object", "x" * 200]
    w = Writer("<").put("i64", 7).put("i32 u64 u64", 2, version(5), version(2019, 1))
    w.put("i32", 1).put("i32 i32", 49, 3)
    w.put("u64 u8", version(5), 1).put("u16 u16 u8 u16", 0, 5, 128, 2)
    w.put("u64 u8", version(2019, 1), 1).put("u16 u16 u8 u16 u16", 0, 5, 64 | 128, 2, 3)
    w.put("u64 u8", version(2021, 1), 0)
    w.put("i32 u64 u8 u64 u8", 2, version(5), 1, version(2019, 1), 2).put("i32 u16 u16", 2, 0, 6)
    nodes = [(2, 3, []), (2, 4, []), (0, 1, [0]), (0, 1, [0, 1])]
    w.put("i32", len(nodes))
    for kind, name, children in nodes:
        w.put("u16 u16 i32 i16 u8 u32 u16", kind, name, -1, 1, 0, 0, len(children))
        for c in children:
            w.put("u16", c)
    w.put("i32", len(strings))
    for s in strings:
        text(w, s)
    return bytes(w.out)


def pack(kind, raw, codec=0):
    packed = {0: lambda x: x, 1: lambda x: pa.Codec("lz4_raw").compress(x, asbytes=True), 2: lzma_pack, 3: brotli_pack}[codec](raw)
    return bytes(Writer("<").put("u32 u8 u8 u8 u8 u32 u32 u32", rg.MAGIC, 1, codec, kind, 0, 0, len(packed), len(raw)).raw(packed).out)


@pytest.mark.parametrize("codec", [0, 1, 2, 3])
def test_reads_trees(codec):
    kind, raw = rg.open_registry(pack(rg.TYPE_TREES, trees(), codec))
    [(_, _, t)] = list(rg.contents(kind, Cursor(raw, "<")))
    assert t.created == 7 and len(t.versions) == 2 and t.common == [(version(5), 1), (version(2019, 1), 2)]
    assert [n.name for n in tt.flat(t.tree(3))] == ["Base", "m_Name", "m_Script"]
    assert [(n.level, n.index) for n in tt.flat(t.tree(3))] == [(0, 0), (1, 1), (1, 2)]


def test_collections_and_errors():
    w = Writer("<").put("i32", 2)
    text(w, "a").put("i8", rg.JSON)
    text(w, "{}")
    text(w, "b").put("i8", rg.FILE_SYSTEM).put("i32", 1)
    text(w, "f").put("i32", 3).raw(b"xyz")
    kind, raw = rg.open_registry(pack(rg.COLLECTION, bytes(w.out)))
    assert list(rg.contents(kind, Cursor(raw, "<"))) == [("a", rg.JSON, "{}"), ("b/f", rg.FILE_SYSTEM, b"xyz")]
    with pytest.raises(ValueError):
        rg.open_registry(b"junk" + bytes(40))
    with pytest.raises(ValueError):
        list(rg.contents(4, Cursor(b"", "<")))


def test_objects_find_their_tree(spark, tmp_path):
    (tmp_path / "good.tpk").write_bytes(pack(rg.TYPE_TREES, trees(), 2))
    (tmp_path / "bad.tpk").write_bytes(b"no registry")
    found = rg.type_trees(spark, str(tmp_path)).cache()
    assert found.where("error IS NOT NULL").count() == 1 and found.where("error IS NULL").count() == 3
    asked = [("a", 49, "5.6.1f1", None), ("b", 49, "2019.4.1f1", None), ("c", 49, "2021.3.0f1", None), ("d", 49, "2019.4.1f1", "own"), ("e", 1, "2019.4.1f1", None), ("f", 49, None, None), ("g", 49, "4.0.0", None)]
    rows = spark.createDataFrame(asked, "k string, class_id int, engine string, tree string")
    got = {r["k"]: r["tree"] for r in rg.with_registry(rows, found).collect()}
    assert got["a"].count("m_Name") == 1 and "m_Script" not in got["a"] and "m_Script" in got["b"]
    assert [got[k] for k in "cdefg"] == [None, "own", None, None, None]
    assert {len(r["strings"]) for r in rg.common_strings(spark, str(tmp_path / "good.tpk")).collect()} == {1, 2}
