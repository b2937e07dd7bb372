"""Small synthetic containers."""

from __future__ import annotations

from tessera.sources import containers as ct
from tessera.sources import typetree as tt

POINTER = [("int", "m_FileID"), ("SInt64", "m_PathID")]


def tree(*rows):
    """A tree from (level, type, name[, aligned]) rows."""
    return tt.link([tt.Node(r[0], r[1], r[2], meta_flag=tt.ALIGNED if len(r) > 3 and r[3] else 0) for r in rows])


def pointer(level, name, target="Object"):
    return [(level, f"PPtr<{target}>", name), *[(level + 1, t, n) for t, n in POINTER]]


def array(level, name, *item):
    return [(level, "vector", name), (level + 1, "Array", "Array", True), (level + 2, "int", "size"), *item]


TEXT = tree((0, "TextAsset", "Base"), (1, "string", "m_Name"), (1, "string", "m_Script"))
HOLDER = tree(
    (0, "GameObject", "Base"),
    *array(1, "m_Component", *pointer(3, "data")),
    (1, "unsigned int", "m_Layer"),
    (1, "string", "m_Name"),
    (1, "UInt64", "m_Big"),
    (1, "bool", "m_IsActive", True),
    (1, "pair", "m_Pair"),
    (2, "int", "first"),
    (2, "float", "second"),
)
BUNDLE = tree(
    (0, "AssetBundle", "Base"),
    (1, "string", "m_Name"),
    *array(1, "m_PreloadTable", *pointer(3, "data")),
    (1, "map", "m_Container"),
    (2, "Array", "Array", True),
    (3, "int", "size"),
    (3, "pair", "data"),
    (4, "string", "first"),
    (4, "AssetInfo", "second"),
    (5, "int", "preloadIndex"),
    (5, "int", "preloadSize"),
    *pointer(5, "asset"),
)


def to(path_id, file_id=0):
    return {"m_FileID": file_id, "m_PathID": path_id}


def holder(name, *targets):
    return {"m_Component": list(targets), "m_Layer": 4_000_000_000, "m_Name": name, "m_Big": 2**64 - 1, "m_IsActive": True, "m_Pair": {"first": -3, "second": 0.5}}


def serialized(version=17, order="<", texts=("one", "two"), external="archive:/CAB-b/CAB-b"):
    types = [ct.Type(49, tree=TEXT), ct.Type(1, tree=HOLDER), ct.Type(142, tree=BUNDLE)]
    values = [(k, 0, {"m_Name": t, "m_Script": f"text of {t}"}) for k, t in enumerate(texts, 10)]
    values.append((1, 1, holder("root", to(10), to(2), to(0), to(11, 1))))
    values.append((2, 1, holder("child", to(1), to(99))))
    made = {"preloadIndex": 0, "preloadSize": 2}
    values.append((3, 2, {"m_Name": "b", "m_PreloadTable": [to(10), to(2)], "m_Container": [{"first": "assets/a.txt", "second": made | {"asset": to(10)}}, {"first": "assets/a.txt", "second": made | {"asset": to(2)}}]}))
    trees = [TEXT, HOLDER, BUNDLE]
    classes = [49, 1, 142]
    objects = [ct.Entry(i, k if version >= 16 else classes[k], classes[k], tt.encode(v, trees[k], order)) for i, k, v in values]
    return ct.Serialized(version, order, "2019.4.1f1", 5, True, types, objects, externals=[("", bytes(16), 0, external)])


def bundle(*entries, codec=2, engine="2019.4.1f1"):
    return ct.write_bundle(ct.Bundle("UnityFS", 6, "5.x.x", engine, codec, entries=[(n, d, 4) for n, d in entries]))
