"""Queries that store the plain tables in asset containers and read them back through the sources.

The world they make: each region is a bundle ``region-<key>`` with one file ``cab-<key>`` of its nations (text objects), a
holder that points to them, and the bundle's listing. Suppliers are objects of files ``sup-<n>`` that point to
their nation in another file. Everything is written by ``sinks`` and read by ``assets``; the SQL twins read the tables.

Rows may lack their keys: nations without a region are in ``cab-none``, those without a key have ids from ``KEYLESS`` on, and
suppliers without a key are in files ``sup-none-<n>``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.columns import version_key, version_parts
from tessera.plans.kernels import table
from tessera.operators import relational as R
from tessera.sources import assets, registry, sinks
from tessera.sources import typetree as tt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
ENGINE = "2021.3.5f1"
SUPPLIER_FILES = 7
#: Path ids beyond those of any nation's key: of nations without one, and of no object at all.
KEYLESS, NOWHERE = 2**40, 2**50


def stored(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- trees of the objects ---------------------------------------------------------------------------


def tree(*rows: tuple) -> str:
    """A tree as JSON, of (level, type, name[, aligned]) rows."""
    return sinks.json_of(tt.link([tt.Node(r[0], r[1], r[2], index=k, meta_flag=tt.ALIGNED if r[3:] else 0) for k, r in enumerate(rows)]))


def pointer(level: int, name: str) -> list[tuple]:
    return [(level, "PPtr<Object>", name), (level + 1, "int", "m_FileID"), (level + 1, "SInt64", "m_PathID")]


def array(level: int, name: str, *item: tuple) -> list[tuple]:
    return [(level, "vector", name), (level + 1, "Array", "Array", True), (level + 2, "int", "size"), *item]


NATION = tree((0, "TextAsset", "Base"), (1, "string", "m_Name"), (1, "string", "m_Script"))
NAMELESS = tree((0, "TextAsset", "Base"), (1, "bool", "named"))
HOLDER = tree((0, "GameObject", "Base"), *array(1, "m_Component", *pointer(3, "data")), (1, "string", "m_Name"), (1, "bool", "m_IsActive", True))
SUPPLIER = tree((0, "MonoBehaviour", "Base"), *pointer(1, "m_Nation"), (1, "string", "m_Name"), (1, "double", "balance"), (1, "Words", "big"), (2, "UInt64", "high"), (2, "UInt64", "low"), (1, "pair", "ends"), (2, "SInt64", "first"), (2, "string", "second"), (1, "bool", "named"), (1, "bool", "balanced", True))
LISTING = tree(
    (0, "AssetBundle", "Base"), (1, "string", "m_Name"), *array(1, "m_PreloadTable", *pointer(3, "data")), (1, "map", "m_Container"), (2, "Array", "Array", True), (3, "int", "size"),
    (3, "pair", "data"), (4, "string", "first"), (4, "AssetInfo", "second"), (5, "int", "preloadIndex"), (5, "int", "preloadSize"), *pointer(5, "asset"),
)


def _to(path_id, file_id=0):
    return F.struct(F.lit(file_id).cast("int").alias("m_FileID"), F.lit(path_id).cast("long").alias("m_PathID"))


def _word():
    """2^64, one more than a word of a supplier's ``big`` holds."""
    return F.lit(str(2**64)).cast("decimal(20,0)")


def _region_file():
    return F.concat(F.lit("cab-"), F.coalesce(F.col("n_regionkey").cast("string"), F.lit("none")))


def region_of(path: str):
    """The region's key of a region file's path; null for the file of nations without one."""
    return F.nullif(F.regexp_extract(path, r"(?i)cab-(-?\d+)$", 1), F.lit("")).cast("int")


def nation_id(path_id):
    """A nation's path id, null if it has no key."""
    return F.when(F.col(path_id) < KEYLESS, F.col(path_id))


def named_place():
    """A nation's path in the listing, null if it has no name."""
    return F.when(~F.col("asset_path").startswith("unnamed/"), F.col("asset_path"))


def supplier_key(path, path_id):
    """The key of the supplier that is object ``path_id`` of the file ``path``; null in the files of those without one."""
    return F.when(~F.col(path).rlike("(^|/)sup-none-"), F.col(path_id))


def region_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``path, path_id, class_id, tree, value, externals`` of the region files: nations from 100 on, holder 1, listing 2."""
    own = Window.partitionBy("path").orderBy(F.col("n_nationkey").asc_nulls_last(), "n_name")
    nations = table(spark, sf_dir, "nation").withColumn("path", _region_file()).withColumn("k", F.row_number().over(own) - 1)
    nations = nations.withColumn("id", F.coalesce(F.col("n_nationkey") + 100, F.col("k") + F.lit(KEYLESS)))
    row = lambda path_id, class_id, tree_, value: (F.lit(path_id).cast("long").alias("path_id"), F.lit(class_id).alias("class_id"), F.lit(tree_).alias("tree"), F.to_json(value).alias("value"))
    kind = F.when(F.col("n_name").isNull(), NAMELESS).otherwise(NATION)
    texts = nations.select("path", *row(F.col("id"), 49, kind, F.struct(F.col("n_name").alias("m_Name"), F.concat(F.lit("nation "), F.lower("n_name"), F.lit(" ü")).alias("m_Script"), F.lit(False).alias("named"))))
    place = F.coalesce(F.lower(F.concat(F.lit("assets/"), F.col("n_name"))), F.concat(F.lit("unnamed/"), F.col("id").cast("string")))
    listed = nations.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("k", place.alias("place"), "id"))).alias("all"))
    held = F.transform("all", lambda x: _to(x["id"]))
    entry = lambda place, start, size, to: F.struct(place.alias("first"), F.struct(start.cast("int").alias("preloadIndex"), size.cast("int").alias("preloadSize"), _to(to).alias("asset")).alias("second"))
    # each nation's path, then the first one's path again with the last nation, and one whose range has the holder too
    zero, top, last = F.lit(0), F.col("all")[0], F.element_at("all", -1)
    again = entry(top["place"], zero, zero, last["id"])
    # where the last nation has no key, the first one's path goes on to the last that has one, which then keeps its own
    keyed = F.element_at(F.filter("all", lambda x: x["id"] < KEYLESS), F.lit(-1))
    further = F.when((last["id"] >= KEYLESS) & (top["id"] < KEYLESS), F.array(entry(top["place"], zero, zero, keyed["id"]), entry(keyed["place"], zero, zero, keyed["id"])))
    loads = entry(F.lit("assets/all.prefab"), zero, F.size("all") + 2, 0)
    holder = listed.select("path", *row(F.lit(1), 1, HOLDER, F.struct(F.concat(held, F.array(_to(0), _to(NOWHERE))).alias("m_Component"), F.col("path").alias("m_Name"), F.lit(True).alias("m_IsActive"))))
    preload = F.concat(held, F.array(_to(0), _to(1)))
    entries = F.concat(F.transform("all", lambda x: entry(x["place"], x["k"], F.lit(1), x["id"])), F.array(again), F.coalesce(further, F.array()), F.array(loads))
    listing = listed.select("path", *row(F.lit(2), 142, LISTING, F.struct(F.col("path").alias("m_Name"), preload.alias("m_PreloadTable"), entries.alias("m_Container"))))
    return texts.unionByName(holder).unionByName(listing).withColumn("externals", F.array().cast("array<string>")).withColumn("endian", F.lit("<"))


def supplier_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns of the supplier files: pointers leave the file by the region's place among the externals, null ones without a nation.

    A tree holds no nulls: ``named`` and ``balanced`` say whether the row has a name and a balance, the file's name whether it has a key.
    """
    nations = table(spark, sf_dir, "nation").withColumn("file", _region_file())
    regions = nations.agg(F.sort_array(F.collect_set("file")).alias("files"))
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"), "left").crossJoin(F.broadcast(regions))
    key = F.coalesce("s_suppkey", F.lit(0))
    big = F.lit("18446744073709550000").cast("decimal(20,0)") + key  # from key 1,616 on more than 64 bits
    value = F.struct(
        _to(F.coalesce(F.col("n_nationkey") + 100, F.lit(0)), F.coalesce(F.array_position("files", F.col("file")), F.lit(0))).alias("m_Nation"),
        F.coalesce("s_name", F.lit("")).alias("m_Name"),
        F.coalesce("s_acctbal", F.lit(0.0)).alias("balance"),
        F.struct((big >= _word()).cast("int").alias("high"), (big % _word()).alias("low")).alias("big"),
        F.struct(key.alias("first"), F.coalesce(F.upper("s_name"), F.lit("")).alias("second")).alias("ends"),
        F.col("s_name").isNotNull().alias("named"),
        F.col("s_acctbal").isNotNull().alias("balanced"),
    )
    path = F.concat(F.lit("sup-"), F.when(F.col("s_suppkey").isNull(), F.lit("none-")).otherwise(F.lit("")), (F.col("id") % SUPPLIER_FILES).cast("string"))
    links = F.transform("files", lambda x: F.concat(F.lit("archive:/"), F.upper(x), F.lit("/"), F.upper(x)))
    rows = rows.withColumn("id", F.coalesce("s_suppkey", F.monotonically_increasing_id()))
    return rows.select(path.alias("path"), F.col("id").alias("path_id"), F.lit(114).alias("class_id"), F.lit(SUPPLIER).alias("tree"), F.to_json(value).alias("value"), links.alias("externals"), F.lit(">").alias("endian"))


def suppliers(decoded: DataFrame) -> DataFrame:
    """Decoded suppliers with their ``object`` and, null where the row had none, ``s_suppkey``, ``name``, ``second`` and ``balance``."""
    rows = assets.typed(decoded, tt.to_dicts(assets.trees_from_json(SUPPLIER)))
    o = F.col("object")
    return rows.withColumns({"s_suppkey": supplier_key("path", "path_id"), "name": F.when(o["named"], o["m_Name"]), "second": F.when(o["named"], o["ends"]["second"]), "balance": F.when(o["balanced"], o["balance"])})


def world(spark: SparkSession, sf_dir: str, packer: str = "lz4") -> DataFrame:
    """``path, content``: the bundles of the regions and the bare files of the suppliers."""
    inner = sinks.serialized_files(assets.encode(region_objects(spark, sf_dir)), ENGINE)
    regions = sinks.bundles(inner.select(F.regexp_replace("path", "^cab-", "w/region-").alias("path"), F.upper("path").alias("name"), "content"), ENGINE, packer)
    return regions.unionByName(sinks.serialized_files(assets.encode(supplier_objects(spark, sf_dir)), ENGINE, 17, ">").withColumn("path", F.concat(F.lit("w/"), "path")))


def read(spark: SparkSession, sf_dir: str, packer: str = "lz4") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, objects and resolved externals of the world; files are few and written once, as each of the three reads them."""
    found = R.cut(spark)(assets.unfolded(world(spark, sf_dir, packer)))
    return found, assets.objects(found), assets.resolved(assets.externals(found), found, "target_name")


# -- queries ---------------------------------------------------------------------------------------------


@stored("""
SELECT 'cab-' || n_regionkey AS file_name, 'TextAsset' AS class_name, count(*) AS n FROM nation GROUP BY n_regionkey
UNION ALL SELECT DISTINCT 'cab-' || n_regionkey, 'GameObject', 1 FROM nation
UNION ALL SELECT DISTINCT 'cab-' || n_regionkey, 'AssetBundle', 1 FROM nation
UNION ALL SELECT 'sup-' || s_suppkey % 7, 'MonoBehaviour', count(*) FROM supplier GROUP BY s_suppkey % 7
""")
def stored_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of nested and bare files by class (A08-A18, B15, C07, F01): no payload leaves the tasks."""
    found = assets.unfolded(world(spark, sf_dir))
    # 'cab-' and 'sup-' with a key that is null are null
    name = F.when(~F.col("file_name").rlike("^(cab|sup)-none"), F.col("file_name"))
    return assets.objects(found, payloads=False).groupBy(name.alias("file_name"), "class_name").agg(F.count(F.lit(1)).alias("n"))


@stored("SELECT s_suppkey, s_name AS name, s_acctbal AS balance, CAST(18446744073709550000 + s_suppkey AS DECIMAL(20,0)) AS big, CAST(s_suppkey AS INTEGER) AS first, upper(s_name) AS second FROM supplier")
def stored_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects decoded by their tree into a struct (C01-C05, J05): big-endian scalars, strings, pairs, words of 64 unsigned bits."""
    found = assets.unfolded(sinks.serialized_files(assets.encode(supplier_objects(spark, sf_dir)), ENGINE, 17, ">"))
    rows = suppliers(assets.decode(assets.objects(found, [114])))
    o = F.col("object")
    big = (o["big"]["high"].cast("int") * _word() + o["big"]["low"]).cast("decimal(20,0)")
    keyed = F.col("s_suppkey").isNotNull()
    return rows.select("s_suppkey", "name", "balance", F.when(keyed, big).alias("big"), F.when(keyed, o["ends"]["first"]).cast("int").alias("first"), "second")


@stored("SELECT n_nationkey + 100 AS path_id, n_name AS name FROM nation UNION ALL SELECT s_suppkey, NULL FROM supplier")
def stored_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by a cut tree (B10, C06); a tree that has its name behind a pointer is read up to it."""
    _, every, _ = read(spark, sf_dir)
    named = assets.decode(every.where("class_name IN ('TextAsset', 'MonoBehaviour')"), name_only=True)
    nation = F.col("class_name") == "TextAsset"
    return named.select(F.when(nation, nation_id("path_id")).otherwise(supplier_key("path", "path_id")).alias("path_id"), F.when(nation, F.col("value")).alias("name"))


@stored("SELECT s_suppkey, n_name, 'nation ' || lower(n_name) || ' ü' AS script FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def stored_deref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointers through externals into another bundle, and what they point to."""
    _, every, links = read(spark, sf_dir)
    edges = assets.pointers(assets.decode(every.where("class_id = 114")))
    got = assets.deref_decoded(edges, links, every)
    return got.select(supplier_key("src_path", "src_path_id").alias("s_suppkey"), F.get_json_object("value", "$.m_Name").alias("n_name"), F.get_json_object("value", "$.m_Script").alias("script"))


@stored("""
SELECT n_regionkey AS region, count(*) AS resolved, CAST(1 AS BIGINT) AS dangling, CAST(1 AS BIGINT) AS null_pointers FROM nation GROUP BY n_regionkey
""")
def stored_null_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null pointers and ones that nothing resolves (D04, D10), of each holder."""
    _, every, links = read(spark, sf_dir)
    holders = assets.decode(every.where("class_id = 1"))
    edges = assets.deref(assets.pointers(holders), links, every).groupBy("src_path").agg(F.count("class_id").alias("resolved"), F.count_if(F.col("class_id").isNull()).alias("dangling"))
    nulls = assets.leaves(holders).where("field LIKE 'm_Component.%.m_PathID' AND leaf = '0'").groupBy("path").agg(F.count(F.lit(1)).alias("null_pointers"))
    return edges.join(nulls, F.col("src_path") == F.col("path")).select(region_of("path").alias("region"), "resolved", "dangling", "null_pointers")


@stored("""
WITH one AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k, max(n_nationkey) OVER (PARTITION BY n_regionkey) AS last FROM nation)
SELECT n_regionkey AS region, 'assets/' || lower(n_name) AS asset_path, CAST(CASE WHEN k = 1 THEN last ELSE n_nationkey END + 100 AS BIGINT) AS path_id FROM one
UNION ALL SELECT DISTINCT n_regionkey, 'assets/all.prefab', CAST(0 AS BIGINT) FROM nation
""")
def stored_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container paths, the last entry of each."""
    _, every, _ = read(spark, sf_dir)
    entries = assets.container(assets.decode(every.where("class_id = 142")))
    return R.last_wins(entries, ["path", "asset_path"], ["pos"], ["m_path_id"]).select(region_of("path").alias("region"), named_place().alias("asset_path"), nation_id("m_path_id").alias("path_id"))


@stored("""
WITH one AS (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k, count(*) OVER (PARTITION BY n_regionkey) AS n,
  first_value(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS top FROM nation)
SELECT n_regionkey AS region, CAST(n_nationkey + 100 AS BIGINT) AS path_id, 'assets/' || lower(CASE WHEN k = n THEN top ELSE n_name END) AS asset_path, true AS direct FROM one
UNION ALL SELECT DISTINCT n_regionkey, CAST(1 AS BIGINT), 'assets/all.prefab', false FROM nation
""")
def stored_preload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path by which each object is loaded: direct entries first, then ranges of the preload table."""
    _, every, links = read(spark, sf_dir)
    got = assets.preload_paths(assets.decode(every.where("class_id = 142")), links, every)
    return got.select(region_of("dst_path").alias("region"), nation_id("path_id").alias("path_id"), named_place().alias("asset_path"), "direct")


@stored("SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN s_name || ' in debt' ELSE s_name END AS name, s_acctbal AS balance FROM supplier")
def stored_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values changed, encoded, written into their files and read again."""
    found = R.cut(spark)(assets.unfolded(sinks.serialized_files(assets.encode(supplier_objects(spark, sf_dir)), ENGINE, 17, ">")))
    old = assets.decode(assets.objects(found, [114]))
    debts = suppliers(old).where("balance < 0").select(*old.columns)
    new = assets.encode(debts.withColumn("value", F.regexp_replace("value", r'("m_Name": "(?:[^"\\]++|\\.)*+)"', '$1 in debt"'))).select("path", "path_id", "payload")
    untouched = found.join(new.select("path").distinct(), "path", "left_anti")
    after = assets.patched_files(found, new).unionByName(untouched.select("path", "content"))
    rows = suppliers(assets.decode(assets.objects(assets.unfolded(after), [114])))
    return rows.select("s_suppkey", "name", "balance")


@stored("SELECT DISTINCT packer, 'cab-' || n_regionkey AS name, true AS same FROM nation, (VALUES ('none'), ('lz4'), ('lzma')) p(packer)")
def stored_packers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles by every packer hold the same files."""
    inner = R.cut(spark)(sinks.serialized_files(assets.encode(region_objects(spark, sf_dir)), ENGINE))
    out = None
    for packer in ("none", "lz4", "lzma"):
        read_back = assets.unfolded(sinks.bundles(inner.select(F.concat(F.lit("b/"), "path").alias("path"), F.col("path").alias("name"), "content"), ENGINE, packer)).where("depth = 1")
        part = read_back.select("name", "content").join(inner.select(F.col("path").alias("name"), F.col("content").alias("was")), "name")
        part = part.select(F.lit(packer).alias("packer"), F.nullif("name", F.lit("cab-none")).alias("name"), (F.col("content") == F.col("was")).alias("same"))
        out = part if out is None else out.unionByName(part)
    return out


@stored("""
WITH RECURSIVE edges AS (
  SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst FROM supplier
  UNION ALL SELECT DISTINCT 'h' || n_regionkey, 'n' || n_nationkey FROM nation
), reach AS (SELECT src AS seed, src AS node FROM edges WHERE src LIKE 'h%' UNION SELECT seed, dst FROM reach JOIN edges ON node = src)
SELECT CAST(substr(seed, 2) AS INTEGER) AS region, count(*) AS reached FROM reach GROUP BY seed
""")
def stored_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All objects that each holder reaches by its pointers (F04), nodes being (file, path id)."""
    _, every, links = read(spark, sf_dir)
    edges = assets.deref(assets.pointers(assets.decode(every.where("class_id IN (1, 114)"))), links, every).where("class_id IS NOT NULL")
    node = lambda path, at: F.struct(F.col(path).alias("path"), F.col(at).alias("id"))
    seeds = every.where("class_id = 1").select(node("path", "path_id").alias("seed"))
    reach = R.closure(edges.select(node("src_path", "src_path_id").alias("src"), node("dst_path", "m_path_id").alias("dst")), seeds)
    # nations without a key can't be told apart in the tables, so a holder reaches one of them
    found = reach.select(region_of("seed.path").alias("region"), F.least("node.id", F.lit(KEYLESS)).alias("id")).where("region IS NOT NULL").distinct()
    return found.groupBy("region").agg(F.count(F.lit(1)).alias("reached"))


@stored("""
SELECT c_custkey, CASE WHEN v.m >= 2021 THEN 'new' WHEN v.m >= 2018 THEN 'old' END AS label FROM (SELECT c_custkey, 2015 + c_custkey % 9 AS m FROM customer) v
""")
def stored_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stripped objects get the tree that holds for their engine's version."""
    engine = F.concat((F.col("c_custkey") % 9 + 2015).cast("string"), F.lit(".2.3f1"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.lit(49).alias("class_id"), engine.alias("engine"), F.lit(None).cast("string").alias("tree"))
    since = lambda v: version_key(version_parts(F.lit(v)))
    entry = lambda v, t: spark.range(1).select(F.lit(49).alias("class_id"), since(v).alias("since"), F.lit("TextAsset").alias("name"), F.lit(t).cast("string").alias("tree"), F.lit(None).cast("string").alias("error"))
    trees = entry("2021.1.0a1", NATION).unionByName(entry("2018.2.0b1", HOLDER)).unionByName(entry("5.0.0f1", None))
    got = registry.with_registry(rows, trees)
    return got.select("c_custkey", F.when(F.col("tree") == NATION, "new").when(F.col("tree") == HOLDER, "old").alias("label"))
