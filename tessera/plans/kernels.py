"""Relational kernels of the engine over plain tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.functions.text import obj_vertices
from tessera.operators import relational as R
from tessera.operators import shaders as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def kernel(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@kernel("""
SELECT n.n_name, count(*) AS n_lines, CAST(sum(l.l_linenumber) AS BIGINT) AS sum_linenumber
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name
""")
def deref_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pointer chain (D01, D02): each line's order, its customer, the customer's nation."""
    lines, orders, customers, nations = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(customers, F.col("o_custkey") == customers.c_custkey)
        .join(nations, F.col("c_nationkey") == nations.n_nationkey)
        .groupBy("n_name")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_linenumber").cast("long").alias("sum_linenumber"))
    )


# -- pointers and names ----------------------------------------------------------------------------


@kernel("""
WITH p AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_custkey END AS ptr FROM orders)
SELECT c_mktsegment, count(*) AS n FROM p JOIN customer ON ptr = c_custkey WHERE ptr <> 0 GROUP BY c_mktsegment
UNION ALL SELECT NULL, count(*) FROM p WHERE ptr = 0
""")
def deref_null_pointer_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null pointers (D04) are left out before the join, and counted."""
    pointer = F.when(F.col("o_orderstatus") == "P", F.lit(0).cast("long")).otherwise(F.col("o_custkey"))
    orders, customers = table(spark, sf_dir, "orders").select(pointer.alias("ptr")), table(spark, sf_dir, "customer")
    found = orders.where("ptr <> 0").join(customers, F.col("ptr") == F.col("c_custkey")).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return found.unionByName(orders.where("ptr = 0").agg(F.count(F.lit(1)).alias("n")).withColumn("c_mktsegment", F.lit(None).cast("string")))


@kernel("SELECT c_custkey, c_name FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
def deref_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependencies that nothing resolves (D10): an anti join."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return customers.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@kernel("SELECT p_type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type")
def target_type_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pointer's target type (D03): only the type column is read."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@kernel("SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE event_type IN ('click', 'view') GROUP BY event_type")
def type_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of some types (C08, C09): the filter reaches the scan."""
    found = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    return found.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").cast("long").alias("ids"))


@kernel("SELECT d.doc_id, d.source FROM documents d JOIN labels l USING (doc_id) WHERE d.lang = 'en' AND l.toxic = 0 AND contains(d.text, 'the ')")
def two_phase_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter on metadata, then one on the payload."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.where("lang = 'en'").join(labels.where("toxic = 0"), "doc_id").where(F.col("text").contains("the ")).select("doc_id", "source")


@kernel("SELECT p_partkey, split_part(p_name, ' ', 1) AS name FROM part")
def peek_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the name of each object (B10, C06): a pruned scan."""
    return table(spark, sf_dir, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"))


@kernel("SELECT n_nationkey, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey WHERE lower(n_name) = lower(upper(n_name))")
def case_insensitive_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that differ in case only (D07, D09) meet on their lower-cased key."""
    nations, suppliers = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    asked = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("Dir\\"), F.upper("n_name")).alias("path"))
    return asked.join(nations, C.simple_name(F.col("path")) == F.lower("n_name")).select("n_nationkey", "s_suppkey")


@kernel("""
WITH asked AS (
  SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN n_name WHEN 1 THEN upper(n_name) || '!' ELSE 'dir/' || lower(n_name) END AS request
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
), found AS (
  SELECT s_suppkey, 1 AS rank, n_nationkey FROM asked JOIN nation ON request = n_name
  UNION ALL SELECT s_suppkey, 2, n_nationkey FROM asked JOIN nation ON request = 'dir/' || lower(n_name)
  UNION ALL SELECT s_suppkey, 3, n_nationkey FROM asked JOIN nation ON request = upper(n_name) || '!'
)
SELECT s_suppkey, CAST(rank AS INTEGER) AS rank, n_nationkey FROM (
  SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY rank, n_nationkey) AS r FROM found) WHERE r = 1
""")
def ranked_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file name tried against candidates in order."""
    nations, suppliers = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    request = F.expr("CASE s_suppkey % 3 WHEN 0 THEN n_name WHEN 1 THEN concat(upper(n_name), '!') ELSE concat('dir/', lower(n_name)) END")
    asked = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", request.alias("request"))
    names = nations.select("n_nationkey", "n_name")
    keys = [F.col("n_name"), F.concat(F.lit("dir/"), F.lower("n_name")), F.concat(F.upper("n_name"), F.lit("!"))]
    return R.resolve_ranked(asked, "request", [(names, k) for k in keys], ["n_nationkey"], "s_suppkey")


@kernel("""
SELECT page_id, min(t.rank) AS rank FROM pages JOIN (VALUES ('.html', 1), ('/1', 2), ('5', 3), ('a', 4)) t(ending, rank)
ON ends_with(url, ending) GROUP BY page_id
""")
def suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a fixed list of endings that a path has."""
    ranks = F.array(*[F.when(F.col("url").endswith(e), F.lit(k)) for k, e in enumerate([".html", "/1", "5", "a"], 1)])
    return table(spark, sf_dir, "pages").select("page_id", F.array_min(ranks).alias("rank")).where("rank IS NOT NULL")


@kernel("""
SELECT page_id, list_aggregate(list_filter(string_split(url, '/')[3:], lambda x: x <> ''), 'string_agg', '/') AS destination
FROM pages WHERE len(list_filter(string_split(url, '/')[3:], lambda x: x <> '')) > 0
""")
def container_path_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export paths without their first directories."""
    return table(spark, sf_dir, "pages").select("page_id", C.destination(F.col("url"), 2).alias("destination")).where("destination <> ''")


@kernel("""
SELECT doc_id, CASE WHEN length(text) < 20 THEN 'resource' WHEN starts_with(text, 'The') THEN 'bundle'
  WHEN length(text) < 128 THEN 'small' WHEN text[1] BETWEEN 'A' AND 'M' THEN 'serialized' ELSE 'unknown' END AS file_type FROM documents
""")
def sniff_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type by an ordered list of tests on a file's head and length."""
    text = F.col("text")
    kind = (
        F.when(F.length(text) < 20, "resource")
        .when(text.startswith("The"), "bundle")
        .when(F.length(text) < 128, "small")
        .when(F.substring(text, 1, 1).between("A", "M"), "serialized")
        .otherwise("unknown")
    )
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("file_type"))


# -- multimap ----------------------------------------------------------------------------------------


@kernel("SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem")
def multimap_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a multimap, duplicates kept."""
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber")


@kernel("SELECT DISTINCT l_partkey FROM lineitem")
def multimap_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys."""
    return table(spark, sf_dir, "lineitem").select("l_partkey").distinct()


@kernel("SELECT count(*) AS entries, count(DISTINCT l_partkey) AS keys FROM lineitem")
def multimap_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length with duplicates, and number of keys."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.sum("n").cast("long").alias("entries"), F.count(F.lit(1)).alias("keys"))


@kernel("SELECT user_id, arg_max(event_type, {'a': ts, 'b': event_id}) AS event_type, max_by(event_id, {'a': ts, 'b': event_id}) AS event_id FROM events GROUP BY user_id")
def container_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last entry of each key."""
    return R.last_wins(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_type", "event_id"])


@kernel("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, ts, event_id) AS r FROM events) WHERE r = 1
""")
def path_setdefault_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A direct entry wins over preloaded ones, then the first."""
    direct = F.when(F.col("event_type") == "purchase", 0).otherwise(1)
    return R.first_wins(table(spark, sf_dir, "events"), "user_id", [direct, F.col("ts"), F.col("event_id")], ["event_id", "event_type"])


@kernel("""
WITH owners AS (SELECT o_orderkey, o_orderkey % 4 AS start, o_custkey % 4 AS size FROM orders),
items AS (SELECT l_orderkey, l_linenumber - 1 AS pos, l_partkey, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT o_orderkey, l_partkey, CAST(pos AS INTEGER) AS pos FROM owners JOIN items ON o_orderkey = l_orderkey
WHERE size > 0 AND start + size <= n AND pos >= start AND pos < start + size
""")
def preload_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each container's range of the preload table."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") - 1).cast("int").alias("pos"), "l_partkey")
    counts = lines.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    owners = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS k", "o_orderkey % 4 AS start", "o_custkey % 4 AS size").join(counts, "k")
    return R.slice_rows(owners, lines, "k", "start", "size", "pos", "n").select(F.col("k").alias("o_orderkey"), "l_partkey", "pos")


@kernel("""
SELECT e.event_id, max_by(o.o_orderkey, {'a': o.o_orderdate, 'b': o.o_orderkey}) AS o_orderkey
FROM events e LEFT JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderdate <= e.ts GROUP BY e.event_id
""")
def asof_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry in force at a time."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("ts").cast("timestamp").alias("at"), "event_id")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("at"), "o_orderkey")
    return R.asof(events, orders, "k", "at", ["o_orderkey"], "o_orderkey").select("event_id", "o_orderkey")


@kernel("""
SELECT d.doc_id, max(v.doc_id) AS version FROM documents d
LEFT JOIN (SELECT doc_id, lang FROM documents WHERE source = 'src1') v ON v.lang = d.lang AND v.doc_id <= d.doc_id GROUP BY d.doc_id
""")
def asof_type_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version at or below a key, for each type."""
    docs = table(spark, sf_dir, "documents")
    versions = docs.where("source = 'src1'").select("lang", F.col("doc_id").alias("at"), F.col("doc_id").alias("version"))
    return R.asof(docs.select("lang", F.col("doc_id").alias("at"), "doc_id"), versions, "lang", "at", ["version"], "version").select("doc_id", "version")


@kernel("""
SELECT conv_id, count(*) AS parts, string_agg(role, '|' ORDER BY turn) AS content FROM (
  SELECT *, turn - min(turn) OVER (PARTITION BY conv_id) - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations)
WHERE g = -1 GROUP BY conv_id
""")
def split_parts_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered parts up to the first gap, put together in order."""
    kept = R.contiguous_prefix(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return kept.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts"), F.array_join(F.transform(ordered, lambda x: x["role"]), "|").alias("content"))


@kernel("""
SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 999 END, event_id) AS INTEGER) AS place FROM events
""")
def export_priority_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export order: by type priority, unknown types last, ties by id (G01), for each owner."""
    w = Window.partitionBy("user_id").orderBy(R.priority(F.col("event_type"), ["purchase", "click"]), "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.row_number().over(w).alias("place"))


@kernel("""
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey
  ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 999 END, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1
""")
def export_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each object is exported once, by the first reference in export order."""
    order = [R.priority(F.col("l_returnflag"), ["R", "A"]), F.col("l_orderkey"), F.col("l_linenumber")]
    return R.first_wins(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], order, ["l_orderkey", "l_linenumber"])


@kernel("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def export_manifest_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the manifest doesn't list yet."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@kernel("""
SELECT l_suppkey, l_returnflag, count(*) AS n, count(*) > 1 AS tier, arg_min(l_linestatus, {'a': l_orderkey, 'b': l_linenumber}) AS first_platform
FROM lineitem GROUP BY l_suppkey, l_returnflag
""")
def shader_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-programs by blob and type, a tier flag for more than one, the first platform."""
    first = F.min_by("l_linestatus", F.struct("l_orderkey", "l_linenumber")).alias("first_platform")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > 1).alias("tier"), first)


@kernel("""
WITH programs AS (SELECT l_orderkey, l_linenumber, l_suppkey % 22 AS platform, l_partkey % 32 AS program FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE platform WHEN 0 THEN 'openGL' WHEN 1 THEN 'd3d9' WHEN 2 THEN 'xbox360' WHEN 4 THEN 'd3d11' WHEN 5 THEN 'gles'
  WHEN 8 THEN 'd3d11_9x' WHEN 9 THEN 'gles3' WHEN 10 THEN 'psp2' WHEN 11 THEN 'ps4' WHEN 12 THEN 'xboxone' WHEN 14 THEN 'metal' WHEN 15 THEN 'glcore'
  WHEN 16 THEN 'n3ds' WHEN 17 THEN 'wiiu' WHEN 18 THEN 'vulkan' WHEN 19 THEN 'switch' ELSE 'xboxone+_d3d12' END AS platform, program
FROM programs WHERE platform = 0 AND program = 1 OR platform = 1 AND program BETWEEN 9 AND 12 OR platform = 4 AND program BETWEEN 15 AND 22
  OR platform = 5 AND program = 5 OR platform = 8 AND program BETWEEN 13 AND 14 OR platform = 9 AND program BETWEEN 2 AND 4
  OR platform = 14 AND program = 23 OR platform = 15 AND program BETWEEN 6 AND 8 OR platform = 18 AND program = 25
  OR platform IN (2, 10, 11, 12, 16, 17, 19, 20) AND program BETWEEN 26 AND 30
""")
def shader_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Programs that their platform can use, with the platform's name."""
    programs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 22).alias("platform"), (F.col("l_partkey") % 32).alias("program"))
    return S.usable_programs(programs, "platform", "program").withColumn("platform", S.platform_name("platform"))


@kernel("""
SELECT l_orderkey, CAST(min(l_linenumber) FILTER (l_returnflag = 'A') AS INTEGER) AS a, CAST(min(l_linenumber) FILTER (l_returnflag = 'N') AS INTEGER) AS n,
  CAST(min(l_linenumber) FILTER (l_returnflag = 'R') AS INTEGER) AS r FROM lineitem GROUP BY l_orderkey
""")
def component_first_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first component of each type of an object."""
    wide = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.min("l_linenumber").cast("int"))
    return wide.select("l_orderkey", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@kernel("""
SELECT l_orderkey, l_linenumber, CAST(l_linenumber - min(l_linenumber) OVER (PARTITION BY l_orderkey) AS INTEGER) AS material FROM lineitem
""")
def material_index_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Material of a submesh: its place less the first one's."""
    first = F.min("l_linenumber").over(Window.partitionBy("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") - first).cast("int").alias("material"))


@kernel("SELECT user_id, event_type, max_by(value, {'a': ts, 'b': event_id}) AS value FROM events WHERE value IS NOT NULL GROUP BY user_id, event_type")
def property_map_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Material properties: nulls dropped, the last of equal keys wins."""
    return R.last_wins(table(spark, sf_dir, "events").where("value IS NOT NULL"), ["user_id", "event_type"], ["ts", "event_id"], ["value"])


# -- layout ------------------------------------------------------------------------------------------


@kernel("SELECT doc_id, CAST(coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM documents")
def directory_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each entry of a container begins."""
    return R.offsets(table(spark, sf_dir, "documents"), "source", "doc_id", F.col("n_chars")).select("doc_id", "offset")


@kernel("SELECT doc_id, CAST(coalesce(sum((n_chars + 15) // 16 * 16) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM documents")
def aligned_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with entries padded to 16 bytes."""
    return R.offsets(table(spark, sf_dir, "documents"), "source", "doc_id", C.align_up(F.col("n_chars"), 16)).select("doc_id", "offset")


@kernel("""
SELECT doc_id, CAST(k AS INTEGER) AS chunk, CAST(least(128, n_chars - k * 128) AS BIGINT) AS size
FROM (SELECT doc_id, n_chars, unnest(range(CAST(ceil(n_chars / 128) AS BIGINT))) AS k FROM documents)
""")
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that each block is compressed in."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.chunk_sizes(F.col("n_chars"), 128)).alias("chunk", "size"))


@kernel("SELECT p_partkey, CAST(coalesce(sum(length(p_name) + 1) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM part")
def common_string_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of strings in a shared table: lengths and their ends added up."""
    return R.offsets(table(spark, sf_dir, "part"), "p_brand", "p_partkey", F.length("p_name") + 1).select("p_partkey", "offset")


# -- schemas -------------------------------------------------------------------------------------------


@kernel("""
WITH c AS (SELECT conv_id, turn, (turn * 7 + conv_id) % 4 AS level FROM conversations)
SELECT a.conv_id, a.turn, (SELECT max(b.turn) FROM c b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.level = a.level - 1) AS parent FROM c a
""")
def typetree_parent_from_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of a flat tree from its levels."""
    nodes = table(spark, sf_dir, "conversations").select("conv_id", "turn", ((F.col("turn") * 7 + F.col("conv_id")) % 4).alias("level"))
    return R.parent_of_level(nodes, "conv_id", "turn", "level", 4).select("conv_id", "turn", "parent")


@kernel("""
SELECT r_regionkey, r_name || chr(10) || string_agg('  ' || n_name, chr(10) ORDER BY n_nationkey) AS dump
FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name
""")
def typetree_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree as indented text."""
    both = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.concat(F.lit("  "), x["n_name"]))
    return both.groupBy("r_regionkey", "r_name").agg(F.array_join(lines, "\n").alias("rest")).select("r_regionkey", F.concat_ws("\n", "r_name", "rest").alias("dump"))


@kernel("""
SELECT key, count(DISTINCT event_type) AS versions, count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events) AS required
FROM (SELECT event_type, unnest(json_keys(props)) AS key FROM events) GROUP BY key
""")
def schema_merge_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field is required if every version has it."""
    events = table(spark, sf_dir, "events")
    fields = events.select("event_type", F.explode(F.json_object_keys("props")).alias("key"))
    every = events.agg(F.count_distinct("event_type").alias("every"))
    return fields.groupBy("key").agg(F.count_distinct("event_type").alias("versions")).join(F.broadcast(every)).select("key", "versions", (F.col("versions") == F.col("every")).alias("required"))


@kernel(r"""
WITH raw AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '(int&)' || p_name || '?' WHEN 1 THEN 'pass' WHEN 2 THEN p_size || '-' || p_name
  WHEN 3 THEN 'a.b:' || p_brand || '[0]' ELSE p_type END AS name FROM part),
plain AS (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(name, '^\(int&\)', ''), '\?$', ''), '[ .:\-\[\]]', '_', 'g') AS name FROM raw)
SELECT p_partkey, CASE WHEN name IN ('pass', 'from') THEN name || '_' WHEN regexp_matches(name, '^[0-9]') THEN 'x' || name ELSE name END AS name FROM plain
""")
def clean_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field names as identifiers."""
    raw = F.expr("CASE p_partkey % 5 WHEN 0 THEN concat('(int&)', p_name, '?') WHEN 1 THEN 'pass' WHEN 2 THEN concat(p_size, '-', p_name) WHEN 3 THEN concat('a.b:', p_brand, '[0]') ELSE p_type END")
    return table(spark, sf_dir, "part").select("p_partkey", C.clean_name(raw).alias("name"))


@kernel("SELECT p_partkey, CASE p_size % 7 WHEN 1 THEN 'Alpha8' WHEN 3 THEN 'RGB24' WHEN 4 THEN 'RGBA32' ELSE 'Unknown (' || (p_size % 7) || ')' END AS format FROM part")
def enum_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enum names, with a made-up one for unknown values."""
    return table(spark, sf_dir, "part").select("p_partkey", C.enum_name({1: "Alpha8", 3: "RGB24", 4: "RGBA32"}, F.col("p_size") % 7).alias("format"))


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.expr("concat(2000 + p_size % 23, '.', p_size % 4, '.', p_partkey % 50, element_at(array('a1', 'b2', 'f3', 'z4', 'p12', 'f1c1', ''), cast(p_partkey % 7 + 1 as int)))")
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("v"))


_VERSIONS = r"""
WITH raw AS (SELECT p_partkey, concat(2000 + p_size % 23, '.', p_size % 4, '.', p_partkey % 50, ['a1', 'b2', 'f3', 'z4', 'p12', 'f1c1', ''][p_partkey % 7 + 1]) AS v FROM part),
parts AS (SELECT p_partkey, v, CAST(split_part(v, '.', 1) AS INTEGER) AS major, CAST(split_part(v, '.', 2) AS INTEGER) AS minor,
  CAST(regexp_extract(v, '^\d+\.\d+\.(\d+)', 1) AS INTEGER) AS build, regexp_extract(v, '^\d+\.\d+\.\d+([a-z]+)', 1) AS letter,
  coalesce(TRY_CAST(regexp_extract(v, '^\d+\.\d+\.\d+[a-z]+(\d+)', 1) AS INTEGER), 0) AS type_number, regexp_extract(v, '^\d+\.\d+\.\d+[a-z]+\d+(.*)$', 1) AS postfix FROM raw),
typed AS (SELECT *, CAST(CASE letter WHEN 'a' THEN 0 WHEN 'b' THEN 1 WHEN 'c' THEN 2 WHEN 'f' THEN 3 WHEN 'p' THEN 4 WHEN 'x' THEN 5 WHEN '' THEN 3 ELSE 255 END AS INTEGER) AS type FROM parts),
packed AS (SELECT *, CAST(major AS BIGINT) * 281474976710656 + CAST(minor AS BIGINT) * 4294967296 + CAST(build AS BIGINT) * 65536 + type * 256 + type_number AS key FROM typed)
"""


@kernel(_VERSIONS + "SELECT p_partkey, major, minor, build, type, type_number, postfix FROM packed")
def version_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engine versions from text."""
    return _versions(spark, sf_dir).select("p_partkey", C.version_parts(F.col("v")).alias("x")).select("p_partkey", "x.*")


@kernel(_VERSIONS + "SELECT p_partkey, key, major, type FROM packed")
def version_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions as one number and back."""
    keyed = _versions(spark, sf_dir).select("p_partkey", C.version_key(C.version_parts(F.col("v"))).alias("key"))
    return keyed.select("p_partkey", "key", C.version_field(F.col("key"), "major").alias("major"), C.version_field(F.col("key"), "type").alias("type"))


@kernel(_VERSIONS + "SELECT p_partkey, (major, minor) >= (2017, 2) AS newer FROM packed")
def version_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions against a short tuple."""
    return _versions(spark, sf_dir).select("p_partkey", C.version_at_least(C.version_key(C.version_parts(F.col("v"))), 2017, 2).alias("newer"))


# -- bits and numbers -----------------------------------------------------------------------------------


@kernel("""
SELECT l_orderkey, l_linenumber, CAST(floor(l_discount * 255) AS BIGINT) + CAST(floor(l_tax * 255) AS BIGINT) * 256 + CAST(floor(l_quantity / 50 * 255) AS BIGINT) * 65536 + CAST(255 AS BIGINT) * 16777216 AS rgba,
  CAST(floor(l_tax * 255) AS BIGINT) AS g FROM lineitem
""")
def rgba_pack_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours as 32 bits and back."""
    rgba = C.pack_rgba(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50, F.lit(1.0))
    packed = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rgba.alias("rgba"))
    return packed.withColumn("g", F.round(C.unpack_rgba(F.col("rgba"))[1] * 255).cast("long"))


@kernel("SELECT p_partkey, p_partkey & 1 AS packed, (p_partkey >> 1) & 1 AS mode, (p_partkey >> 2) & 15 AS rotation, (p_partkey >> 6) & 1 AS mesh_type FROM part")
def sprite_settings_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sprite settings."""
    fields = C.bit_fields(F.col("p_partkey"), [1, 1, 4, 1])
    return table(spark, sf_dir, "part").select("p_partkey", *[f.alias(n) for f, n in zip(fields, ["packed", "mode", "rotation", "mesh_type"], strict=True)])


@kernel("SELECT p_partkey, CAST(i AS INTEGER) AS pos, ((p_partkey * 2654435761) >> (5 * i)) & 31 AS value FROM part, range(6) t(i)")
def bit_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed integers."""
    packed = (F.col("p_partkey") * F.lit(2654435761)).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(C.unpack_ints(packed, 5, 6)).alias("pos", "value"))


@kernel("""
SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, CAST(floor((embedding[i] + 8) / 16 * 255) AS BIGINT) AS q, round(CAST(floor((embedding[i] + 8) / 16 * 255) AS BIGINT) * 16.0::DOUBLE / 255 - 8, 6) AS x
FROM embeddings, range(1, 65) t(i) WHERE i <= len(embedding)
""")
def quantise_dequantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floats as 8 bits and back."""
    first = F.transform("embedding", lambda x: F.floor((x + F.lit(8.0).cast("float")) / F.lit(16.0).cast("float") * F.lit(255.0).cast("float")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(first).alias("pos", "q"))
    return rows.select("vec_id", "pos", F.col("q").cast("long").alias("q"), F.round(C.dequantise(F.col("q"), F.lit(-8.0), F.lit(16.0), 8), 6).alias("x"))


@kernel("SELECT vec_id, CAST(r AS INTEGER) AS row, round(CAST(list_sum(embedding[r * 4 + 1 : r * 4 + 4]::DOUBLE[]) AS DOUBLE), 6) AS total FROM embeddings, range(16) t(r)")
def reshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flat array as rows."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(C.reshape(F.col("embedding"), 4)).alias("row", "v"))
    return rows.select("vec_id", "row", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


@kernel("""
SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, round(embedding[i]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS x
FROM embeddings, range(1, 65) t(i) WHERE i <= len(embedding)
""")
def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(C.normalise(v)).alias("pos", "x")).withColumn("x", F.round("x", 6))


@kernel("""
WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)
SELECT vec_id, round(CASE WHEN 1 - x * x - y * y >= 0 THEN x ELSE x / sqrt(x * x + y * y) END, 6) AS nx,
  round(CASE WHEN 1 - x * x - y * y >= 0 THEN sqrt(1 - x * x - y * y) ELSE 0 END, 6) AS nz FROM v
""")
def normal_from_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normals from two components."""
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", C.normal_from_xy(x, y).alias("n"))
    return rows.select("vec_id", F.round(F.col("n")[0], 6).alias("nx"), F.round(F.col("n")[2], 6).alias("nz"))


# -- meshes and images ------------------------------------------------------------------------------------

_INDICES = "WITH m AS (SELECT l_orderkey, list(l_suppkey % 7 ORDER BY l_linenumber, l_suppkey) AS ix FROM lineitem GROUP BY l_orderkey)"


def _indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(ordered, lambda x: x["l_suppkey"] % 7).alias("ix"))


def _triples(rows: DataFrame, triangles) -> DataFrame:
    return rows.select("l_orderkey", F.posexplode(triangles).alias("pos", "t")).select("l_orderkey", "pos", *[F.col("t")[k].alias(n) for k, n in enumerate("abc")])


@kernel(_INDICES + " SELECT l_orderkey, CAST(k AS INTEGER) AS pos, ix[3 * k + 1] AS a, ix[3 * k + 2] AS b, ix[3 * k + 3] AS c FROM (SELECT *, unnest(range(len(ix) // 3)) AS k FROM m)")
def triangles_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of an index list."""
    return _triples(_indices(spark, sf_dir), C.triangles(F.col("ix")))


@kernel(
    _INDICES
    + """, t AS (SELECT l_orderkey, k, CASE WHEN k % 2 = 1 THEN ix[k] ELSE ix[k + 1] END AS a, CASE WHEN k % 2 = 1 THEN ix[k + 1] ELSE ix[k] END AS b, ix[k + 2] AS c
  FROM (SELECT *, unnest(range(1, len(ix) - 1)) AS k FROM m))
SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY k) - 1 AS INTEGER) AS pos, a, b, c FROM t WHERE a <> b AND b <> c AND a <> c"""
)
def triangles_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of a strip."""
    return _triples(_indices(spark, sf_dir), C.strip_triangles(F.col("ix")))


@kernel(
    _INDICES
    + """ SELECT l_orderkey, CAST(2 * k + h AS INTEGER) AS pos, ix[4 * k + 1] AS a, ix[4 * k + 2 + h] AS b, ix[4 * k + 3 + h] AS c
FROM (SELECT *, unnest(range(len(ix) // 4)) AS k FROM m), range(2) s(h)"""
)
def triangles_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two triangles for each quad."""
    return _triples(_indices(spark, sf_dir), C.quad_triangles(F.col("ix")))


@kernel("SELECT vec_id, CAST(k AS INTEGER) AS vertex, embedding[k * 8 + 4] AS u, embedding[k * 8 + 5] AS v FROM embeddings, range(8) t(k)")
def vertex_deinterleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One channel of interleaved vertex data."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(C.deinterleave(F.col("embedding"), 8, 3, 2)).alias("vertex", "x"))
    return rows.select("vec_id", "vertex", F.col("x")[0].alias("u"), F.col("x")[1].alias("v"))


@kernel("SELECT vec_id, list_min(embedding) AS low, list_max(embedding) AS high FROM embeddings")
def mesh_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extent of each mesh."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_min("embedding").alias("low"), F.array_max("embedding").alias("high"))


@kernel("SELECT doc_id, CAST(k AS INTEGER) AS layer, substring(text, CAST(k * (length(text) // 3) + 1 AS BIGINT), CAST(length(text) // 3 AS BIGINT)) AS data FROM documents, range(3) t(k)")
def texture_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of a texture array."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.text_slices(F.col("text"), 3)).alias("layer", "data"))


@kernel("""
SELECT x, y, ((y // 8 // 2 * 16 + x // 4) * 2 + y // 8 % 2) * 32
  + (y & 1) + 2 * ((y >> 1) & 1) + 4 * (x & 1) + 8 * ((y >> 2) & 1) + 16 * ((x >> 1) & 1) AS place FROM range(64) a(x), range(64) b(y)
""")
def swizzle_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block-linear places of a 64 x 64 grid of texels (I14): a permutation."""
    cells = spark.range(64 * 64).select((F.col("id") % 64).alias("x"), F.floor(F.col("id") / 64).alias("y"))
    return cells.select("x", "y", C.gob_offset(F.col("x"), F.col("y"), 2, F.lit(16)).alias("place"))


@kernel("SELECT p_partkey, CAST(ceil(p_size * 3 / 4) * ceil(p_size / 4) * 16 AS BIGINT) AS bytes FROM part")
def pad_block_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a block-compressed image."""
    return table(spark, sf_dir, "part").select("p_partkey", C.block_bytes(F.col("p_size") * 3, F.col("p_size"), 4, 16).alias("bytes"))


# -- graph ---------------------------------------------------------------------------------------------------


@kernel("""
WITH RECURSIVE edges AS (SELECT n_regionkey AS src, 100 + n_nationkey AS dst FROM nation UNION ALL SELECT 100 + n_nationkey, (n_regionkey + 1) % 5 FROM nation),
reach(seed, node) AS (SELECT r_regionkey, r_regionkey FROM region UNION SELECT seed, dst FROM reach JOIN edges ON node = src)
SELECT CAST(seed AS INTEGER) AS seed, CAST(node AS INTEGER) AS node FROM reach
""")
def closure_region_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a root reaches over a graph with cycles."""
    nations = table(spark, sf_dir, "nation")
    edges = nations.selectExpr("n_regionkey AS src", "100 + n_nationkey AS dst").unionByName(nations.selectExpr("100 + n_nationkey AS src", "(n_regionkey + 1) % 5 AS dst"))
    return R.closure(edges, table(spark, sf_dir, "region").selectExpr("r_regionkey AS seed")).select("seed", "node")


@kernel("""
SELECT s_suppkey, lpad(n_regionkey::VARCHAR, 3, '0') || '/' || lpad(n_nationkey::VARCHAR, 3, '0') || '/' || lpad(s_suppkey::VARCHAR, 9, '0') AS path
FROM supplier JOIN nation ON s_nationkey = n_nationkey
""")
def tree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path that sorts depth first."""
    both = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    part = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    return both.select("s_suppkey", F.concat_ws("/", part("n_regionkey", 3), part("n_nationkey", 3), part("s_suppkey", 9)).alias("path"))


@kernel("""
WITH c AS (SELECT DISTINCT c_custkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P')
SELECT 'customer' AS kind, c_custkey AS id FROM c
UNION ALL SELECT DISTINCT 'nation', CAST(c_nationkey AS BIGINT) FROM c
UNION ALL SELECT DISTINCT 'region', CAST(n_regionkey AS BIGINT) FROM c JOIN nation ON c_nationkey = n_nationkey
""")
def dirty_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds something that changed, up to the root (F06): every level folds to distinct keys before the next join."""
    changed = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    holders = table(spark, sf_dir, "customer").join(changed, "c_custkey", "left_semi").select("c_custkey", "c_nationkey")
    nations = table(spark, sf_dir, "nation").join(holders, F.col("n_nationkey") == F.col("c_nationkey"), "left_semi")
    level = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).cast("long").alias("id")).distinct()
    return level(holders, "customer", "c_custkey").unionByName(level(nations, "nation", "n_nationkey")).unionByName(level(nations, "region", "n_regionkey"))


# -- objects ---------------------------------------------------------------------------------------------------


@kernel("SELECT event_id, CAST(props ->> 'k' AS BIGINT) AS k FROM events")
def json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A self-describing payload with a given schema."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@kernel("""SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS json FROM nation""")
def json_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects as JSON."""
    return table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_name")).alias("json"))


@kernel("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'patched ' || s_name ELSE s_name END AS s_name, s_nationkey FROM supplier")
def patch_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patched objects in place of the old ones."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    patches = suppliers.where("s_suppkey % 3 = 0").select("s_suppkey", F.concat(F.lit("patched "), F.col("s_name")).alias("s_name"))
    return R.upsert(suppliers, patches, "s_suppkey", ["s_name"])


@kernel()
def obj_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertex lines of an OBJ file (H24, I08): the exact number format needs Python."""
    return table(spark, sf_dir, "embeddings").select("vec_id", obj_vertices("embedding").alias("obj"))
