import gzip
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.sources import assets
from tessera.sources import binary as bn
from tessera.sources import containers as ct
from tessera.sources import typetree as tt
from tests import fixtures as fx


@pytest.mark.parametrize("version", [7, 8, 9, 10, 11, 13, 14, 15, 16, 17, 19, 20, 21, 22])
@pytest.mark.parametrize("order", ["<", ">"])
def test_serialized_round_trip(version, order):
    f = fx.serialized(version, order)
    data = ct.write_serialized(f)
    back = ct.read_serialized(data)
    assert ct.write_serialized(back) == data
    assert {(o.path_id, o.class_id, o.data) for o in back.objects} == {(o.path_id, o.class_id, o.data) for o in f.objects}
    value = tt.decode(next(o.data for o in back.objects if o.path_id == 1), back.types[1].tree, order)
    assert value["m_Big"] == 2**64 - 1 and value["m_Layer"] == 4_000_000_000 and value["m_Component"][3] == fx.to(11, 1)


@pytest.mark.parametrize("codec", [0, 1, 2, 3])
def test_bundle_round_trip(codec):
    big = random.Random(1).randbytes(200_000) + bytes(300_000)
    data = fx.bundle(("CAB-a", big), ("CAB-a.resS", b"xyz"), codec=codec)
    b = ct.read_bundle(data)
    assert [(n, d) for n, d, _ in b.entries] == [("CAB-a", big), ("CAB-a.resS", b"xyz")]
    assert ct.write_bundle(b) == ct.write_bundle(ct.read_bundle(ct.write_bundle(b)))
    assert codec in (0, 1) or len(b.blocks) == 4


@pytest.mark.parametrize("packer", ["none", "gzip", "brotli"])
def test_web_round_trip(packer):
    entries = [("a/b.bin", bytes(500)), ("c", b"12")]
    assert ct.read_web(ct.write_web("UnityWebData1.0", packer, entries)) == ("UnityWebData1.0", packer, entries)


@pytest.mark.parametrize("size", [0, 19, 20, 127, 128, 400])
def test_sniff_junk(size):
    assert ct.sniff(b"\xff" * size) == "resource"


def test_sniff_kinds():
    assert ct.sniff(fx.bundle(("a", b"1"))) == "bundle"
    assert ct.sniff(ct.write_serialized(fx.serialized())) == "serialized"
    assert ct.sniff(gzip.compress(b"UnityWebData1.0\0" + random.Random(2).randbytes(300))) == "web"
    assert ct.sniff(ct.write_serialized(fx.serialized()), "x.resS") == "resource"


def test_nested_and_blob_trees_agree():
    for version, read, write in ((9, tt.read_nested, tt.write_nested), (2, tt.read_nested, tt.write_nested), (17, tt.read_blob, tt.write_blob), (19, tt.read_blob, tt.write_blob)):
        w = bn.Writer()
        write(w, fx.HOLDER, version)
        back = read(bn.Cursor(bytes(w.out)), version)
        assert [(n.level, n.type, n.name, n.meta_flag) for n in tt.flat(back)] == [(n.level, n.type, n.name, n.meta_flag) for n in tt.flat(fx.HOLDER)]
    assert tt.dump(fx.TEXT).split("\n")[1].startswith("  string m_Name")
    assert tt.spark_type(fx.HOLDER).simpleString().startswith("struct<m_Component:array<struct<m_FileID:int,m_PathID:bigint>>,m_Layer:bigint")


def test_decode_demands_all_bytes():
    data = tt.encode({"m_Name": "a", "m_Script": "b"}, fx.TEXT)
    with pytest.raises(ValueError):
        tt.decode(data + b"\0", fx.TEXT)
    with pytest.raises(ValueError):
        tt.decode(data[:-2], fx.TEXT)
    with pytest.raises(ValueError):
        bn.unpack(b"", 0, 4)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("assets")
    a, b = ct.write_serialized(fx.serialized(external="archive:/x/CAB-B")), ct.write_serialized(fx.serialized(22, ">", ("three", "four")))
    (d / "a.bundle").write_bytes(fx.bundle(("CAB-a", a), ("CAB-a.resS", bytes(40)), codec=1))
    web = ct.write_web("UnityWebData1.0", "gzip", [("in.bundle", fx.bundle(("CAB-b", b)))])
    with zipfile.ZipFile(d / "pkg.zip", "w") as z:
        z.writestr("deep/w.gz", web)
    whole = ct.write_serialized(fx.serialized(texts=("five",)))
    for k, at in enumerate(range(0, len(whole), 600)):
        (d / f"level.split{k}").write_bytes(whole[at : at + 600])
    (d / "level.split99").write_bytes(b"left out: there is a gap before it")
    (d / "broken").write_bytes(b"UnityFS\0" + bytes(40))
    return str(d)


def test_files_to_objects(spark, folder):
    found = assets.files(spark, folder)
    kinds = {(r["name"], r["file_type"]) for r in found.collect()}
    assert kinds == {("a.bundle", "bundle"), ("CAB-a", "serialized"), ("CAB-a.resS", "resource"), ("pkg.zip", "zip"), ("w.gz", "web"), ("in.bundle", "bundle"), ("CAB-b", "serialized"), ("level", "serialized"), ("broken", "error")}
    rows = assets.objects(found)
    assert rows.groupBy("file_name").count().collect().__len__() == 3
    texts = assets.decode(rows.where("class_id = 49"), name_only=True)
    assert {r["value"] for r in texts.collect()} == {"one", "two", "three", "four", "five"}
    one = assets.typed(assets.decode(rows.where("class_id = 1 and path_id = 1 and file_name = 'cab-a'")), tt.to_dicts(fx.HOLDER)).first()
    assert one["object"]["m_Name"] == "root" and int(one["object"]["m_Big"]) == 2**64 - 1 and one["decode_error"] is None


def test_pointers_container_export(spark, folder):
    found = assets.files(spark, [folder, folder + "/absent"])
    every = assets.objects(found)
    decoded = assets.decode(every).persist()
    links = assets.resolved(assets.externals(found), found, "target_name")
    assert {r["target_name"] for r in links.collect()} == {"cab-b"}
    edges = assets.deref(assets.pointers(decoded.where("class_id = 1")), links, every)
    name = F.lower(F.regexp_extract("dst_path", "([^/]*)$", 1))
    got = {(r["src_path_id"], r["m_file_id"], r["m_path_id"], r["dst_name"], r["class_id"]) for r in edges.where("src_path LIKE '%CAB-a'").withColumn("dst_name", name).collect()}
    assert got == {(1, 0, 10, "cab-a", 49), (1, 0, 2, "cab-a", 1), (1, 1, 11, "cab-b", 49), (2, 0, 1, "cab-a", 1), (2, 0, 99, "cab-a", None)}
    path = edges.where("src_path LIKE '%CAB-a'").first()["src_path"]
    reach = R.closure(
        edges.where("class_id is not null").select(F.struct(F.col("src_path").alias("f"), F.col("src_path_id").alias("p")).alias("src"), F.struct(F.col("dst_path").alias("f"), F.col("m_path_id").alias("p")).alias("dst")),
        spark.createDataFrame([(path, 1)], "f string, p long").select(F.struct("f", "p").alias("seed")),
    )
    assert {(r["node"]["f"].rsplit("/")[-1], r["node"]["p"]) for r in reach.collect()} == {("CAB-a", 1), ("CAB-a", 10), ("CAB-a", 2), ("CAB-b", 11)}
    items = assets.container(decoded).where("path LIKE '%CAB-a'")
    assert [(r["asset_path"], r["m_path_id"]) for r in items.orderBy("pos").collect()] == [("assets/a.txt", 10), ("assets/a.txt", 2)]
    assert R.last_wins(items, "asset_path", ["pos"], ["m_path_id"]).first()["m_path_id"] == 2
    out = assets.manifest(decoded.where("file_name = 'level'"), F.concat_ws("/", "file_name", F.col("path_id")))
    assert {r["dest"]: r["content"] for r in out.collect()}["level/10.txt"] == "text of five"
    values = assets.deref_decoded(assets.pointers(decoded.where("class_id = 1 and path LIKE '%CAB-a'")), links, every)
    assert {(r["m_path_id"], r["value"] and "text of four" in r["value"]) for r in values.where("m_file_id = 1").collect()} == {(11, True)}
    texts = assets.leaves(decoded.where("class_id = 1 and path_id = 1 and path LIKE '%CAB-a'")).where("field = 'm_Component.3.m_PathID' or field = 'm_Name'").orderBy("pos").collect()
    assert [r["leaf"] for r in texts] == ["11", "root"]
    back = assets.encode(decoded.where("decode_error IS NULL").select("path", "path_id", "tree", "endian", "refs", "value", F.col("payload").alias("was")))
    assert back.where("payload IS NULL OR payload <> was OR encode_error IS NOT NULL").count() == 0
    assert {(r["class_id"], r["class_name"]) for r in assets.types(found).collect()} == {(49, "TextAsset"), (1, "GameObject"), (142, "AssetBundle")}
    assert assets.objects(found, [142], payloads=False).where("class_name <> 'AssetBundle' OR payload IS NOT NULL").count() == 0
    decoded.unpersist()


def test_files_of_one_name_stay_apart(spark, tmp_path):
    """Two folders and two bundles hold files of the same names: a pointer stays one row and finds the file beside it."""
    for k, where in enumerate(("x", "y")):
        (tmp_path / where).mkdir()
        level = ct.write_serialized(fx.serialized(texts=(f"level {where}", "b"), external="archive:/other/other"))
        (tmp_path / where / "level0").write_bytes(level)
        (tmp_path / where / "other").write_bytes(ct.write_serialized(fx.serialized(texts=(f"other {where}", f"far {where}"))))
        (tmp_path / f"{where}.bundle").write_bytes(fx.bundle(("level0", level), ("other", ct.write_serialized(fx.serialized(texts=("q", f"in bundle {where}")))), codec=k))
    (tmp_path / "cut").write_bytes(ct.write_serialized(fx.serialized())[:900])
    found = assets.files(spark, str(tmp_path))
    every = assets.objects(found)
    links = assets.externals(found)
    assert {r["path"].rsplit("/")[-1] for r in links.where("error IS NOT NULL").collect()} <= {"cut"}
    links = assets.resolved(links, found, "target_name")
    decoded = assets.decode(every)
    edges = assets.pointers(decoded.where("class_id = 1 AND path_id = 1 AND file_name = 'level0'"))
    got = assets.deref_decoded(edges, links, every).collect()
    assert edges.count() == len(got) == 4 * 3
    side = {(r["src_path"].split("/")[-2], r["value"].split('"')[-2]) for r in got if r["m_file_id"] == 1}
    assert side == {("x", "text of far x"), ("y", "text of far y"), ("x.bundle", "text of in bundle x"), ("y.bundle", "text of in bundle y")}
    out = assets.manifest(decoded.where("class_id = 49"), F.concat_ws("/", "path", F.col("path_id")))
    assert out.count() == 16 and out.select("dest").distinct().count() == 16
    loaded = assets.preload_paths(decoded.where("path LIKE '%x/level0'"), links, every)
    assert {(r["path_id"], r["asset_path"], r["direct"]) for r in loaded.collect()} == {(10, "assets/a.txt", True), (2, "assets/a.txt", True)}


def test_resources_by_four_names(spark, tmp_path):
    for where, data in (("x", b"0123456789"), ("y", b"abcdefghij")):
        (tmp_path / where).mkdir()
        (tmp_path / where / "snd.resource").write_bytes(data)
    (tmp_path / "only.resS").write_bytes(b"far away!")
    found = assets.files(spark, str(tmp_path))
    at = lambda where: f"{found.where('name = ' + repr('only.resS')).first()['path'].rsplit('/', 1)[0]}/{where}/level0"
    asks = [(at("x"), "archive:/a/snd.resource", 2, 3), (at("y"), "snd.assets", 0, 2), (at("y"), "only.assets", 4, 4), (at("y"), "none", 0, 1)]
    got = assets.resource_bytes(spark.createDataFrame(asks, "path string, source string, offset long, size long"), found)
    assert {(r["source"], bytes(r["data"]) if r["data"] is not None else None) for r in got.collect()} == {("archive:/a/snd.resource", b"234"), ("snd.assets", b"ab"), ("only.assets", b"away"), ("none", None)}
    assert {r["path"].rsplit("/")[-2] for r in assets.find_files(spark, str(tmp_path), "snd").collect()} == {"x", "y"}


def test_referenced_types_round_trip(spark):
    held = fx.tree((0, "Thing", "Base"), (1, "int", "hp"), (1, "string", "label"))
    root = fx.tree(
        (0, "MonoBehaviour", "Base"), (1, "string", "m_Name"), (1, "ManagedReferencesRegistry", "references"), (2, "int", "version"),
        (2, "vector", "RefIds"), (3, "Array", "Array", True), (4, "int", "size"), (4, "ReferencedObject", "data"), (5, "SInt64", "rid"),
        (5, "ReferencedManagedType", "type"), (6, "string", "class"), (6, "string", "ns"), (6, "string", "asm"), (5, "ReferencedObjectData", "data"),
    )
    kind = {"class": "Thing", "ns": "game", "asm": "main"}
    none = {"class": "", "ns": "", "asm": ""}
    value = {"m_Name": "m", "references": {"version": 2, "RefIds": [{"rid": 1, "type": kind, "data": {"hp": 7, "label": "seven"}}, {"rid": 2, "type": none}]}}
    refs = {("Thing", "game", "main"): held}
    types = [ct.Type(114, script_index=0, script_id=bytes(16), tree=root)]
    f = ct.Serialized(21, "<", "2021.3.1f1", 5, True, types, [ct.Entry(1, 0, 114, tt.encode(value, root, "<", refs))], scripts=[(1, 99)], reference_types=[ct.Type(-1, tree=held, reference=("Thing", "game", "main"))])
    found = assets.unfolded(spark.createDataFrame([("f", bytearray(ct.write_serialized(f)))], "path string, content binary"))
    decoded = assets.decode(assets.objects(found))
    row = decoded.first()
    assert row["decode_error"] is None and '"label": "seven"' in row["value"]
    assert assets.encode(decoded.withColumn("was", F.col("payload"))).where("payload = was").count() == 1
    assert assets.types(found).where("is_reference").select("script_class", "script_namespace", "script_assembly").first() == ("Thing", "game", "main")
    assert assets.scripts(found).select("script_idx", "file_index", "identifier").first() == (0, 1, 99)


def test_codecs_go_to_the_tasks(spark):
    codecs = bn.with_codec(9, lambda data, size: bytes(b ^ 90 for b in data), lambda data: bytes(b ^ 90 for b in data))
    b = ct.Bundle("UnityFS", 7, "5.x.x", "2019.4.1f1", 0, entries=[("CAB-a", ct.write_serialized(fx.serialized()), 4)])
    raw = spark.createDataFrame([("p", bytearray(ct.write_bundle(b, (64 | 9, 9), codecs)))], "path string, content binary")
    assert assets.unfolded(raw, codecs=codecs).where("file_type = 'serialized'").count() == 1
    assert "not available" in assets.unfolded(raw).first()["error"]
    for packer in ("none", "lz4", "lzma", "original", (194, 1)):
        for engine, version, signature in (("2019.4.1f1", 6, "UnityFS"), ("2022.3.2f1", 8, "UnityFS"), ("5.3.0f1", 6, "UnityRaw")):
            one = ct.Bundle(signature, version, "5.x.x", engine, 65, entries=[("a", bytes(300_000), 4), ("b", b"xyz", 0)])
            back = ct.read_bundle(ct.write_bundle(one, packer))
            assert (back.signature, back.version, back.entries) == (signature, version, one.entries)


def test_patch(spark, folder):
    found = assets.files(spark, folder)
    path = found.where("name = 'CAB-a'").first()["path"]
    new = tt.encode({"m_Name": "new", "m_Script": "longer than it was"}, fx.TEXT)
    out = assets.patched_files(found, spark.createDataFrame([(path, 10, bytearray(new))], "path string, path_id long, payload binary")).collect()
    assert len(out) == 1
    before, after = fx.serialized(external="archive:/x/CAB-B"), ct.read_serialized(bytes(out[0]["content"]))
    assert {o.path_id: o.data for o in after.objects} == {o.path_id: o.data for o in before.objects} | {10: new}


def test_ingest_and_writing_files(spark, tmp_path):
    """New containers are decoded once, batch by batch; exported files appear whole, below the folder only."""
    from tessera.sources import sinks
    from tessera.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(ct.write_serialized(fx.serialized()))
    for name, count in ((None, 5), ("b", 10), (None, 10)):
        if name:
            (tmp_path / "in" / name).write_bytes(fx.bundle(("CAB-x", ct.write_serialized(fx.serialized(texts=("x", "y"))))))
        ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
        assert spark.read.parquet(str(tmp_path / "out")).where("decode_error IS NULL").count() == count
    rows = spark.createDataFrame([("d/one.txt", bytearray(b"1")), ("../../two.txt", bytearray(b"22")), ("three", None)], "dest string, content binary")
    done = sinks.write_files(rows, str(tmp_path / "files")).collect()
    assert {(r["dest"], r["bytes"]) for r in done} == {("d/one.txt", 1), ("two.txt", 2)}
    assert (tmp_path / "files/d/one.txt").read_bytes() == b"1" and (tmp_path / "files/two.txt").read_bytes() == b"22"


def test_web_files_and_repacked_bundles(spark):
    from tessera.sources import sinks

    a, b = ct.write_serialized(fx.serialized()), ct.write_serialized(fx.serialized(texts=("old", "two")))
    entries = spark.createDataFrame([("w", "a", bytearray(a)), ("w", "b.resS", bytearray(b"xyz"))], "path string, name string, content binary")
    for packer in ("none", "gzip"):  # a brotli stream is told by a mark that only the engine's own tool leaves in it
        assert {r["name"]: r["file_type"] for r in assets.unfolded(sinks.web_files(entries, packer)).collect()} == {"w": "web", "a": "serialized", "b.resS": "resource"}
    raw = sinks.bundles(spark.createDataFrame([("p", "one", bytearray(a)), ("p", "two", bytearray(b)), ("q", "one", bytearray(a))], "path string, name string, content binary"), "2019.4.1f1")
    new = ct.write_serialized(fx.serialized(texts=("new", "two")))
    out = sinks.repacked(raw, spark.createDataFrame([("p/two", bytearray(new))], "path string, content binary"))
    assert {r["path"]: bytes(r["content"]) for r in assets.unfolded(out).where("depth = 1").collect()} == {"p/one": a, "p/two": new}
