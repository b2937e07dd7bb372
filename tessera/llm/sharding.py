"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records hash into ``SLOTS`` slots, a number that never changes. Bytes are added up a slot, and a
small map says which shard each slot belongs to. Only the map is edited when shards grow or
drift apart; a new version is stored beside the others and the records' slots stay.

Rows of one group (equal texts) share a slot, so copies stay together. A group that outweighs a
``HOT`` fair slots, in bytes or in rows, is spread over all slots row by row; there are at most
``2 * SLOTS / HOT`` such groups, whatever the data, which bounds the broadcast of their hashes.

Only DataFrame functions touch the rows; the driver sees the slot totals (``SLOTS`` rows).
"""

from __future__ import annotations

import uuid
from bisect import bisect_right, insort
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint, id_and_text, shared_folder

SLOTS = 4096
#: A group heavier than so many fair slots is spread.
HOT = 8
#: Bytes a row weighs besides its text.
ROW_BYTES = 8


def place_in_slots(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, vslot`` of each row; a null text weighs ``ROW_BYTES``."""
    rows = checkpoint(
        id_and_text(docs).select(
            "doc_id",
            (F.octet_length("text") + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
            F.xxhash64("text").alias("g"),
        )
    ).withColumn("nth", F.pmod(F.monotonically_increasing_id(), F.lit(SLOTS)))  # of rows written already: rows that repeat an id, or have none, are told apart
    total = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    fair_bytes, fair_rows = (total["bytes"] or 0) / SLOTS, total["rows"] / SLOTS
    hot = (
        rows.groupBy("g")
        .agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
        .where((F.col("b") > HOT * fair_bytes) | (F.col("n") > HOT * max(fair_rows, 1.0)))
        .select("g", F.lit(True).alias("hot"))
    )
    return rows.join(F.broadcast(hot), "g", "left").select(
        "doc_id",
        "size",
        "text_crc32",
        F.pmod(F.when(F.col("hot"), F.xxhash64("doc_id", "g", "nth")).otherwise(F.col("g")), F.lit(SLOTS)).cast("int").alias("vslot"),
    )


def slot_loads(placed: DataFrame) -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot that holds any: at most ``SLOTS`` entries."""
    found = placed.groupBy("vslot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return {r["vslot"]: (r["b"], r["n"]) for r in found}


def rebalanced_map(slot_map: Sequence[int], loads: dict[int, tuple[int, int]], shards: int) -> list[int]:
    """The map edited until shards weigh the same, as far as whole slots allow.

    The heaviest shard gives the lightest its largest slot that weighs at most half of what lies between
    them, until there is none: every move brings them nearer, and slots that needn't move stay.
    """
    out = list(slot_map)
    held: dict[int, list[tuple[int, int]]] = {s: [] for s in range(shards)}
    for slot, s in enumerate(out):
        if loads.get(slot, (0, 0))[0]:
            held[s].append((loads[slot][0], slot))
    for slots in held.values():
        slots.sort()
    size = {s: sum(b for b, _ in slots) for s, slots in held.items()}
    while True:
        light, heavy = min(size, key=lambda s: (size[s], s)), max(size, key=lambda s: (size[s], -s))
        at = bisect_right(held[heavy], ((size[heavy] - size[light]) // 2, SLOTS)) - 1
        if at < 0:
            return out
        b, slot = held[heavy].pop(at)
        insort(held[light], (b, slot))
        size[heavy], size[light], out[slot] = size[heavy] - b, size[light] + b, light


def grown_map(slot_map: Sequence[int], loads: dict[int, tuple[int, int]], shards: int) -> list[int]:
    """The map edited for one more shard: slots move only into the new shard, none between others."""
    out = list(slot_map)
    held: dict[int, list[int]] = {s: [] for s in range(shards)}
    for slot, s in enumerate(out):
        held[s].append(slot)
    size = {s: sum(loads.get(k, (0, 0))[0] for k in ks) for s, ks in held.items()}
    fair, got = sum(size.values()) / (shards + 1), 0
    for s in held:
        for slot in sorted(held[s], key=lambda k: (-loads.get(k, (0, 0))[0], k)):
            b = loads.get(slot, (0, 0))[0]
            if size[s] - b >= fair and got + b <= fair:
                out[slot], size[s], got = shards, size[s] - b, got + b
    return out


def map_frame(spark: SparkSession, slot_map: Sequence[int], loads: dict[int, tuple[int, int]], version: int) -> DataFrame:
    """``version, vslot, shard, bytes, rows, first_row``: the map as a table of ``SLOTS`` rows.

    ``first_row`` is where a slot's rows begin within its shard (slots in order of number).
    """
    seen: dict[int, int] = {}
    first = []
    for slot, s in enumerate(slot_map):
        first.append(seen.get(s, 0))
        seen[s] = first[-1] + loads.get(slot, (0, 0))[1]

    def at(values: Sequence[int]):
        return F.expr(f"array({','.join(f'{v}L' for v in values)})[cast(id as int)]")

    return spark.range(SLOTS, numPartitions=1).select(
        F.lit(version).alias("version"),
        F.col("id").cast("int").alias("vslot"),
        at(list(slot_map)).cast("int").alias("shard"),
        at([loads.get(k, (0, 0))[0] for k in range(SLOTS)]).alias("bytes"),
        at([loads.get(k, (0, 0))[1] for k in range(SLOTS)]).alias("rows"),
        at(first).alias("first_row"),
    )


def save_map(frame: DataFrame, path: str) -> None:
    """Store a map version under ``path/version=N``; earlier versions stay readable."""
    frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the newest by default: ``SLOTS`` rows."""
    stored = spark.read.parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == version)


def slots_of(frame: DataFrame) -> list[int]:
    """A stored version as a list, slot -> shard."""
    return [r["shard"] for r in frame.orderBy("vslot").select("shard").collect()]


def shard(docs: DataFrame, shards: int = 24, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows with their shard, and the map they follow.

    The map's versions are stored below ``path`` (a new folder in the shared one by default). If there is none yet, version 1
    deals out the slots in turn, before anything is known of their weight. What is stored is then read back and
    edited by the weight of the slots: that is the next version, and the rows go by it as it is stored.

    Rows: ``doc_id, size, text_crc32, shard, slot, vslot, map_version``. ``slot`` numbers the rows of
    a shard from 0 without gaps: the slot's first row plus the row's place in its slot, so
    the only window is over one of ``SLOTS`` slots. Null texts weigh ``ROW_BYTES``, very long ones all their bytes; null ids come
    first in their slot; repeated rows are rows of their own. An empty table gives no rows; other columns don't matter.
    """
    spark = docs.sparkSession
    placed = checkpoint(place_in_slots(docs))
    loads = slot_loads(placed)
    if path is None:
        path = f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
        save_map(map_frame(spark, [slot % shards for slot in range(SLOTS)], loads, 1), path)
    old = load_map(spark, path)
    version = old.first()["version"] + 1
    save_map(map_frame(spark, rebalanced_map(slots_of(old), loads, shards), loads, version), path)
    frame = load_map(spark, path, version)
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size"))
    rows = placed.join(F.broadcast(frame), "vslot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first_row") + rank - 1).alias("slot"), "vslot", F.col("version").alias("map_version")
    )
    return rows, frame


def grow(rows: DataFrame, path: str, shards: int) -> DataFrame:
    """``rows`` of ``shard`` with ``next_shard``, after the newest map below ``path`` was edited for one more shard and stored.

    Rows stay in their shard or go to the new one, number ``shards``.
    """
    spark = rows.sparkSession
    old = load_map(spark, path)
    loads = {r["vslot"]: (r["bytes"], r["rows"]) for r in old.collect()}
    version = old.first()["version"] + 1
    save_map(map_frame(spark, grown_map(slots_of(old), loads, shards), loads, version), path)
    return rows.join(F.broadcast(load_map(spark, path, version).select("vslot", F.col("shard").alias("next_shard"))), "vslot")
