"""Asset containers as DataFrames: files, objects, pointers, decoded values, exports and patches.

Files are read by Spark's ``binaryFile`` source (any Hadoop file system), one row each; containers
unfold into their entries inside the tasks, nested ones too. Everything after that is joins and
filters on columns; payloads are decoded by their type tree in Arrow batches, after the filters.

A file is known by its ``path``, which holds the path of the container it is in; names repeat. A broken file or
object is a row with an error.
"""

from __future__ import annotations

import base64
import io
import json
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import simple_name
from tessera.operators import relational as R
from tessera.sources import containers as ct
from tessera.sources import typetree as tt
from tessera.sources.binary import Codecs

FILES = "root string, path string, name string, file_type string, engine string, depth int, content binary, error string"
OBJECTS = (
    "root string, path string, file_name string, engine string, platform int, format_version int, endian string, path_id bigint, type_id int, class_id int, class_name string, "
    "byte_start bigint, byte_size bigint, tree string, refs string, payload binary, error string"
)
TYPES = "path string, type_idx int, class_id int, class_name string, is_reference boolean, script_class string, script_namespace string, script_assembly string, stripped boolean, script_index int, script_id binary, tree string, dependencies array<int>, error string"
SCRIPTS = "path string, script_idx int, file_index int, identifier bigint, error string"
EXTERNALS = "root string, path string, file_name string, ext_idx int, target string, guid binary, type int, error string"
# Names of the classes that this library treats in a way of their own; other names come from the type trees.
CLASS_NAMES = {1: "GameObject", 4: "Transform", 21: "Material", 23: "MeshRenderer", 28: "Texture2D", 33: "MeshFilter", 43: "Mesh", 48: "Shader", 49: "TextAsset", 83: "AudioClip", 114: "MonoBehaviour", 115: "MonoScript", 128: "Font", 137: "SkinnedMeshRenderer", 142: "AssetBundle", 213: "Sprite", 687078895: "SpriteAtlas"}
LONGEST_BATCH = 16


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _flat_map(df: DataFrame, ddl: str, each: Callable[[dict], Iterator[tuple]]) -> DataFrame:
    """``each`` row to any number of rows, a row at a time so that only one file is held."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                held = []
                for out in each({n: batch.column(k)[row].as_py() for k, n in enumerate(batch.schema.names)}):
                    held.append(out)
                    if len(held) == LONGEST_BATCH:
                        yield _arrow(held, schema)
                        held = []
                if held:
                    yield _arrow(held, schema)

    return df.mapInArrow(run, ddl)


# -- files (A01-A09, A14, A15, A24) ------------------------------------------------------------------------


def entries_of(kind: str, content: bytes, engine: str | None, codecs: Codecs | None = None) -> tuple[str | None, list[tuple[str, bytes]]]:
    if kind == "bundle":
        b = ct.read_bundle(content, engine, codecs)
        return b.engine, [(path, data) for path, data, _ in b.entries]
    if kind == "web":
        return engine, ct.read_web(content)[2]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return engine, [(n.filename, z.read(n)) for n in z.infolist() if not n.is_dir()]


def unfold(root: str, path: str, content: bytes, engine: str | None, depth: int = 0, codecs: Codecs | None = None) -> Iterator[tuple]:
    """The file and, of containers, all that is in it."""
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    try:
        kind = ct.sniff(content, name)
        inner = entries_of(kind, content, engine, codecs) if kind in ("bundle", "web", "zip") else None
    except Exception as error:  # noqa: BLE001  one broken file must not end the job: its row says what is wrong
        yield root, path, name, "error", engine, depth, content, f"{type(error).__name__}: {error}"
        return
    if inner is None:
        yield root, path, name, kind, engine, depth, content, None
        return
    found, entries = inner
    yield root, path, name, kind, found, depth, None, None
    for sub, data in entries:
        yield from unfold(root, f"{path}/{sub}", data, found, depth + 1, codecs)


def merged(parts: DataFrame) -> DataFrame:
    """``path, content`` of rows ``path, content`` of numbered parts, put together up to the first gap after the first part."""
    numbered = parts.withColumn("part", F.regexp_extract("path", PART, 1).try_cast("int"))
    listed = numbered.groupBy(F.regexp_replace("path", PART, "").alias("path")).agg(F.array_sort(F.collect_list(F.struct("part", F.hex("content").alias("hex")))).alias("parts"))
    kept = F.filter("parts", lambda x, i: (x["part"] - F.col("parts")[0]["part"]) == i)
    return listed.select("path", F.unhex(F.array_join(F.transform(kept, lambda x: x["hex"]), "")).alias("content"))


PART = r"\.split(\d+)$"


def existing(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """Those of a list of paths that are there (A04), by the file system that each names."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    asked = [paths] if isinstance(paths, str) else list(paths)
    return [p for p in asked if hadoop.Path(p).getFileSystem(conf).exists(hadoop.Path(p))]


def find_files(spark: SparkSession, folder: str, part: str = "") -> DataFrame:
    """``path, length`` of the files below ``folder`` whose name holds ``part`` (A24), those of version control left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    return found.where(~F.col("path").contains("/.git/") & F.col("path").endswith(F.regexp_extract("path", r"([^/]*)$", 1)) & F.regexp_extract("path", r"([^/]*)$", 1).contains(part))


def files(spark: SparkSession, path: str | list[str], fallback_version: str | None = None, recursive: bool = True, glob: str | None = None, codecs: Codecs | None = None) -> DataFrame:
    """All files below ``path`` and the entries of containers among them; paths that aren't there are left out.

    ``codecs`` (``binary.with_codec``) go to the tasks with the plan.
    """

    def reader(pattern: str | None):
        r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        return r.option("pathGlobFilter", pattern) if pattern else r

    there = existing(spark, path)
    if not there:
        return spark.createDataFrame([], FILES)
    split = F.col("path").rlike(PART)
    whole = reader(glob).load(there).select("path", "content").where(~split)
    parts = reader(glob or "*.split*").load(there).select("path", "content").where(split)
    return unfolded(whole.unionByName(merged(parts)), fallback_version, codecs)


def unfolded(raw: DataFrame, fallback_version: str | None = None, codecs: Codecs | None = None) -> DataFrame:
    """The files of rows ``path, content``, and the entries of containers among them."""
    return _flat_map(raw.select("path", "content"), FILES, lambda r: unfold(r["path"], r["path"], r["content"], fallback_version, 0, codecs))


# -- objects, types, scripts and externals (A16-A19, B15, C07-C09) ----------------------------------------------


def class_name(class_id: int, tree: tt.Node | None) -> str:
    """A class's name: the type of its tree's root, or a name known here, or one that holds the number."""
    return tree.type if tree is not None else CLASS_NAMES.get(class_id, f"Unknown ({class_id})")


def objects(found: DataFrame, class_ids: list[int] | None = None, payloads: bool = True) -> DataFrame:
    """A row for each object of each serialized file; its type tree as JSON, its payload not decoded.

    ``class_ids`` keeps other classes, and ``payloads`` false all bytes, from leaving the task. ``refs`` has the trees
    of the file's referenced types, for objects whose tree makes use of them.
    """
    wanted = None if class_ids is None else set(class_ids)

    def each(r: dict) -> Iterator[tuple]:
        try:
            f = ct.read_serialized(r["content"], r["engine"])
        except Exception as error:  # noqa: BLE001  as above
            yield r["root"], r["path"], r["name"].lower(), r["engine"], *[None] * 12, f"{type(error).__name__}: {error}"
            return
        trees = [json.dumps(tt.to_dicts(t.tree)) if t.tree else None for t in f.types]
        managed = [bool(t.tree) and any(n.type == "ReferencedObjectData" for n in tt.flat(t.tree)) for t in f.types]
        refs = json.dumps([[*t.reference, tt.to_dicts(t.tree)] for t in f.reference_types if t.tree]) if f.reference_types else None
        by_class = {t.class_id: k for k, t in reversed(list(enumerate(f.types)))}
        for e in f.objects:
            if wanted is None or e.class_id in wanted:
                k = e.type_id if f.version >= 16 else by_class.get(e.type_id)
                name = class_name(e.class_id, f.types[k].tree if k is not None else None)
                own = (trees[k], refs if managed[k] else None) if k is not None else (None, None)
                yield r["root"], r["path"], r["name"].lower(), f.engine, f.platform, f.version, f.order, e.path_id, e.type_id, e.class_id, name, e.start, len(e.data), *own, e.data if payloads else None, None

    return _flat_map(found.where("file_type = 'serialized'"), OBJECTS, each)


def _sections(found: DataFrame, ddl: str, rows: Callable[[ct.Serialized], Iterator[tuple]], width: int) -> DataFrame:
    def each(r: dict) -> Iterator[tuple]:
        try:
            out = list(rows(ct.read_serialized(r["content"], r["engine"])))
        except Exception as error:  # noqa: BLE001  as above
            yield r["path"], *[None] * width, f"{type(error).__name__}: {error}"
            return
        for x in out:
            yield r["path"], *x, None

    return _flat_map(found.where("file_type = 'serialized'"), ddl, each)


def types(found: DataFrame) -> DataFrame:
    """A row for each type of each serialized file, referenced types among them."""

    def rows(f: ct.Serialized) -> Iterator[tuple]:
        for is_reference, listed in ((False, f.types), (True, f.reference_types)):
            for k, t in enumerate(listed):
                tree = json.dumps(tt.to_dicts(t.tree)) if t.tree else None
                yield k, t.class_id, class_name(t.class_id, t.tree), is_reference, *(t.reference or (None,) * 3), t.stripped, t.script_index, t.script_id, tree, t.dependencies

    return _sections(found, TYPES, rows, 12)


def scripts(found: DataFrame) -> DataFrame:
    """``path, script_idx, file_index, identifier``: the scripts that each serialized file lists."""
    return _sections(found, SCRIPTS, lambda f: ((k, *x) for k, x in enumerate(f.scripts)), 3)


def externals(found: DataFrame) -> DataFrame:
    """Files that each serialized file points to, numbered from 1 as pointers do; a file that can't be read is a row with its error."""

    def each(r: dict) -> Iterator[tuple]:
        try:
            listed = ct.read_serialized(r["content"], r["engine"]).externals
        except Exception as error:  # noqa: BLE001  as above
            yield r["root"], r["path"], r["name"].lower(), *[None] * 4, f"{type(error).__name__}: {error}"
            return
        for k, (_, guid, kind, path) in enumerate(listed, 1):
            yield r["root"], r["path"], r["name"].lower(), k, path, guid, kind, None

    rows = _flat_map(found.where("file_type = 'serialized'"), EXTERNALS, each)
    plain = F.regexp_replace(F.regexp_replace("target", "^archive:/", ""), "^assets/", "")
    return rows.withColumn("target_name", simple_name(plain))


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, r"/[^/]*$", "")


def resolved(asks: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """``asks`` (with ``path`` and a lower-cased ``name``) with ``target_path``: the file of that name in the same container or folder,
    else in the same top-level file, else anywhere; of several the first path (D01, D08). Each rank is a join with one row a name.
    """
    names = found.where("content IS NOT NULL").select(F.lower("name").alias("__name"), _parent(F.col("path")).alias("__parent"), F.col("root").alias("__root"), "path")
    out = asks.withColumn("__in", _parent(F.col("path")))
    if "root" not in out.columns:
        out = out.join(found.select("path", "root").distinct(), "path", "left")
    ranks = []
    for k, (column, own) in enumerate((("__parent", "__in"), ("__root", "root"), (None, None))):
        keys = ["__name", *([column] if column else [])]
        firsts = names.groupBy(*keys).agg(F.min("path").alias(f"__t{k}")).select(F.col("__name").alias(f"__n{k}"), *([F.col(column).alias(f"__c{k}")] if column else []), f"__t{k}")
        on = F.col(name) == F.col(f"__n{k}")
        out = out.join(firsts, on & (F.col(own) == F.col(f"__c{k}")) if column else on, "left")
        ranks.append(f"__t{k}")
    return out.select(*asks.columns, F.coalesce(*ranks).alias("target_path"))


def resource_bytes(asks: DataFrame, found: DataFrame) -> DataFrame:
    """``asks`` (``path, source, offset, size``) with ``data``: the bytes that an object keeps in another file.

    The name itself is tried, then it without its ending and with ``.resource``, ``.assets.resS`` and ``.resS``; each near the asking file first.
    Only files that are named leave the scan with their content.
    """
    base = simple_name(F.col("source"))
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    rows = asks.withColumn("__id", F.monotonically_increasing_id())
    tried = rows.select("__id", "path", F.posexplode(F.array(base, *[F.concat(stem, F.lit(x)) for x in (".resource", ".assets.ress", ".ress")])).alias("__rank", "__ask"))
    near = resolved(tried, found, "__ask").where("target_path IS NOT NULL").groupBy("__id").agg(F.min_by("target_path", "__rank").alias("__file"))
    held = found.where("content IS NOT NULL").select(F.col("path").alias("__file"), "content").join(near.select("__file").distinct(), "__file", "left_semi")
    joined = rows.join(near, "__id", "left").join(held, "__file", "left")
    return joined.select(*asks.columns, F.substring(F.col("content"), (F.col("offset") + 1).cast("int"), F.col("size").cast("int")).alias("data"))


# -- decoding (C01, C02, C06) ---------------------------------------------------------------------------------


def _plain(x):
    if isinstance(x, bytes):
        return base64.b64encode(x).decode()
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, list):
        return [_plain(v) for v in x]
    return x


def decode(rows: DataFrame, name_only: bool = False) -> DataFrame:
    """``rows`` with ``value``, the object as JSON (bytes in base 64), and ``decode_error``.

    ``name_only`` reads each payload up to its name and gives just that. A tree is parsed once a worker.
    """
    known: dict[str, tt.Node | None] = {}
    managed: dict[str | None, tt.Refs | None] = {None: None}

    def one(tree: str | None, payload: bytes | None, order: str | None, refs: str | None = None) -> tuple[str | None, str | None]:
        if tree is None or payload is None:
            return None, None
        if tree not in known:
            root = tt.from_dicts(json.loads(tree))
            known[tree] = tt.name_prefix(root) if name_only else root
        root = known[tree]
        if root is None:
            return None, None
        if refs not in managed:
            managed[refs] = _trees_of(refs)
        try:
            value = tt.decode(payload, root, order, not name_only, managed[refs])
        except Exception as error:  # noqa: BLE001  the row says what is wrong
            return None, f"{type(error).__name__}: {error}"
        return (value.get("m_Name", value.get("name")) if name_only else json.dumps(_plain(value), ensure_ascii=False)), None

    place = [rows.columns.index(c) for c in ("tree", "payload", "endian", "refs") if c in rows.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(*x) for x in zip(*[batch.column(k).to_pylist() for k in place], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.string())], [*batch.schema.names, "value", "decode_error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, schema + ", value string, decode_error string")


def trees_from_json(tree: str) -> tt.Node:
    return tt.from_dicts(json.loads(tree))


def _trees_of(refs: str | None) -> tt.Refs | None:
    return refs and {(c, n, m): tt.from_dicts(tree) for c, n, m, tree in json.loads(refs)}


def encode(rows: DataFrame) -> DataFrame:
    """``rows`` with ``payload``: the bytes of ``value`` (JSON, as ``decode`` gives it) by its ``tree`` (J04, J05), or ``encode_error``."""
    plain = rows.drop("payload", "encode_error")
    known: dict[str, tt.Node] = {}
    place = [plain.columns.index(c) if c in plain.columns else None for c in ("tree", "value", "endian", "refs")]

    def one(tree: str | None, value: str | None, order: str | None, refs: str | None) -> tuple[bytes | None, str | None]:
        if tree is None or value is None:
            return None, None
        try:
            if tree not in known:
                known[tree] = tt.from_dicts(json.loads(tree))
            named = _trees_of(refs)
            return tt.encode(tt.from_plain(known[tree], json.loads(value), named), known[tree], order or "<", named), None
        except Exception as error:  # noqa: BLE001  the row says what is wrong
            return None, f"{type(error).__name__}: {error}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [one(*x) for x in zip(*[batch.column(k).to_pylist() if k is not None else [None] * batch.num_rows for k in place], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in got], pa.binary()), pa.array([x[1] for x in got], pa.string())], [*batch.schema.names, "payload", "encode_error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, schema + ", payload binary, encode_error string")


def typed(decoded: DataFrame, tree: list[dict]) -> DataFrame:
    """``object``: the value as the struct that a tree stands for."""
    return decoded.withColumn("object", F.from_json("value", tt.spark_type(tt.from_dicts(tree))))


def leaves(decoded: DataFrame) -> DataFrame:
    """``path, path_id, pos, field, leaf``: every scalar of each value in order, whatever holds it (F05); ``field`` says where it was."""

    def flat(x, field: str) -> Iterator[tuple[str, str | None]]:
        if isinstance(x, dict | list):
            for k, v in x.items() if isinstance(x, dict) else enumerate(x):
                yield from flat(v, f"{field}.{k}" if field else str(k))
        else:
            yield field, x if isinstance(x, str) or x is None else json.dumps(x)

    def each(r: dict) -> Iterator[tuple]:
        for pos, (field, leaf) in enumerate(flat(json.loads(r["value"]), "")):
            yield r["path"], r["path_id"], pos, field, leaf

    return _flat_map(decoded.where("value IS NOT NULL").select("path", "path_id", "value"), "path string, path_id bigint, pos int, field string, leaf string", each)


# -- pointers (D01-D06, D10, E01-E05) ----------------------------------------------------------------------------


def pointers(decoded: DataFrame) -> DataFrame:
    """``src_path, src_path_id, m_file_id, m_path_id``: every pointer in the values, null ones left out."""
    pair = r'\{"m_FileID": (-?\d+), "m_PathID": (-?\d+)\}'
    found = decoded.select(F.col("path").alias("src_path"), F.col("path_id").alias("src_path_id"), F.explode(F.regexp_extract_all("value", F.lit(pair), F.lit(0))).alias("p"))
    return found.select("src_path", "src_path_id", F.regexp_extract("p", pair, 1).cast("int").alias("m_file_id"), F.regexp_extract("p", pair, 2).cast("long").alias("m_path_id")).where("m_path_id <> 0")


def deref(edges: DataFrame, links: DataFrame, targets: DataFrame) -> DataFrame:
    """Pointers with ``dst_path`` and the target's ``class_id`` (D01, D03): within the file, or through the externals; unresolved ones stay with nulls.

    ``edges`` has ``src_path, m_file_id, m_path_id``; ``links`` are externals with ``target_path`` (``resolved``). An edge stays one row.
    """
    outer = links.where("error IS NULL").select(F.col("path").alias("__n"), F.col("ext_idx").alias("__k"), F.col("target_path").alias("__t"))
    named = edges.join(outer, (F.col("src_path") == F.col("__n")) & (F.col("m_file_id") == F.col("__k")), "left")
    named = named.withColumn("dst_path", F.when(F.col("m_file_id") == 0, F.col("src_path")).otherwise(F.col("__t"))).drop("__n", "__k", "__t")
    goal = targets.where("path_id IS NOT NULL").select(F.col("path").alias("__n"), F.col("path_id").alias("__p"), "class_id")
    return named.join(goal, (F.col("dst_path") == F.col("__n")) & (F.col("m_path_id") == F.col("__p")), "left").drop("__n", "__p")


def deref_decoded(edges: DataFrame, links: DataFrame, targets: DataFrame) -> DataFrame:
    """Resolved pointers with the decoded ``value`` of their target (D02); only objects that are pointed to are decoded."""
    found = deref(edges, links, targets).where("class_id IS NOT NULL")
    goals = found.select(F.col("dst_path").alias("path"), F.col("m_path_id").alias("path_id")).distinct()
    values = decode(targets.join(goals, ["path", "path_id"], "left_semi")).select(F.col("path").alias("dst_path"), F.col("path_id").alias("m_path_id"), "value", "decode_error")
    return found.join(values, ["dst_path", "m_path_id"], "left")


def container(decoded: DataFrame) -> DataFrame:
    """``path, pos, asset_path, m_file_id, m_path_id, preload_index, preload_size, table_size`` of bundle objects."""
    pointer = "struct<m_FileID:int,m_PathID:bigint>"
    shape = f"struct<m_PreloadTable:array<{pointer}>,m_Container:array<struct<first:string,second:struct<asset:{pointer},preloadIndex:int,preloadSize:int>>>>"
    bundle = decoded.where(F.col("class_id") == ct.BUNDLE_CLASS).select("path", F.from_json("value", shape).alias("b"))
    rows = bundle.select("path", F.coalesce(F.size("b.m_PreloadTable"), F.lit(0)).alias("table_size"), F.posexplode("b.m_Container").alias("pos", "c"))
    second = F.col("c")["second"]
    return rows.select(
        "path",
        "pos",
        F.col("c")["first"].alias("asset_path"),
        second["asset"]["m_FileID"].alias("m_file_id"),
        second["asset"]["m_PathID"].alias("m_path_id"),
        second["preloadIndex"].alias("preload_index"),
        second["preloadSize"].alias("preload_size"),
        "table_size",
    )


def preload_paths(decoded: DataFrame, links: DataFrame, targets: DataFrame) -> DataFrame:
    """``dst_path, path_id, asset_path, direct``: the container path by which each object is loaded.

    A container entry that points to the object comes first, then the first entry whose range of the preload table has it. Ranges
    that are empty or leave the table, null pointers and unresolved ones give nothing.
    """
    entries = container(decoded)
    table = decoded.where(F.col("class_id") == ct.BUNDLE_CLASS).select("path", F.posexplode(F.from_json("value", "struct<m_PreloadTable:array<struct<m_FileID:int,m_PathID:bigint>>>")["m_PreloadTable"]).alias("at", "p"))
    table = table.select("path", "at", F.col("p.m_FileID").alias("m_file_id"), F.col("p.m_PathID").alias("m_path_id")).where("m_path_id <> 0")
    owners = entries.select("path", "pos", "asset_path", "preload_index", "preload_size", "table_size")
    loaded = R.slice_rows(owners, table, "path", "preload_index", "preload_size", "at", "table_size").select(F.col("path").alias("src_path"), "m_file_id", "m_path_id", "asset_path", "pos", "at", F.lit(1).alias("rank"))
    direct = entries.where("m_path_id <> 0").select(F.col("path").alias("src_path"), "m_file_id", "m_path_id", "asset_path", "pos", F.lit(0).alias("at"), F.lit(0).alias("rank"))
    found = deref(direct.unionByName(loaded), links, targets).where("class_id IS NOT NULL")
    # of direct entries the last counts, of ranges the first
    order = [F.col("rank"), F.when(F.col("rank") == 0, -F.col("pos")).otherwise(F.col("pos")), F.col("at"), F.col("src_path")]
    best = R.first_wins(found.withColumnRenamed("m_path_id", "path_id"), ["dst_path", "path_id"], order, ["asset_path", "rank"])
    return best.select("dst_path", "path_id", "asset_path", (F.col("rank") == 0).alias("direct"))


# -- export and write-back (J01-J04, J06, J07) ----------------------------------------------------------------------


def manifest(decoded: DataFrame, destination: Column) -> DataFrame:
    """``dest, content``: text objects as their script, others as JSON; each object once."""
    text = F.get_json_object("value", "$.m_Script")
    once = decoded.where("value IS NOT NULL").dropDuplicates(["path", "path_id"])
    is_text = F.col("class_id") == 49
    return once.select(F.concat(destination, F.when(is_text, ".txt").otherwise(".json")).alias("dest"), F.when(is_text, text).otherwise(F.col("value")).alias("content"))


def patched_files(found: DataFrame, patches: DataFrame) -> DataFrame:
    """``path, content`` of the serialized files that ``patches`` (``path, path_id, payload``) change, written anew."""
    edits = patches.groupBy("path").agg(F.collect_list(F.struct("path_id", "payload")).alias("edits"))
    both = found.where("file_type = 'serialized'").join(edits, "path").select("path", "content", "engine", "edits")

    def each(r: dict) -> Iterator[tuple]:
        f = ct.read_serialized(r["content"], r["engine"])
        new = {e["path_id"]: e["payload"] for e in r["edits"]}
        for e in f.objects:
            e.data = new.get(e.path_id, e.data)
        yield r["path"], ct.write_serialized(f)

    return _flat_map(both, "path string, content binary", each)
