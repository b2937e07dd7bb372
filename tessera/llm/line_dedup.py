"""Line dedup: range-partitioned line hashes, streamed in order of document and position.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. A key of
at least ``min_chars`` code points that more than one document holds stays only in the
document with the smallest id. What comes back is one compressed bitmap a document, not text.

Plan. (1) Lines become ``(h1, h2, block, doc_id, pos)``: a 128-bit hash of the key and one of 64
blocks of documents. (2) One aggregation, combined on the map side, gives each key's first
document and the set of blocks that hold it (a 64-bit mask). (3) Those heads and the lines are
dealt out together by ranges of ``(h1, h2, block)`` and sorted by document and position; a window
streams over them and carries the head's first document. A key that a third of all lines share is
64 groups, so no task gets all of it. (4) Dropped positions fold into 64-bit words by ``bit_or``.

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ASCII_SPACE, LOWER, UPPER, checkpoint, id_and_text

BLOCKS = 64


def _rows(docs: DataFrame) -> DataFrame:
    """The texts with a hash, which tells rows with one doc_id but other texts apart."""
    return id_and_text(docs).withColumn("text_key", F.xxhash64("text"))


def drop_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``doc_id, text_key, n_dropped, words``: the lines to drop of each document that loses any.

    ``words`` is an array of ``struct<word int, drop long>`` ordered by word: bit b of word w is
    line ``64 * w + b``; words that drop nothing are left out (a keep bitmap is its complement).
    Rows with a null doc_id neither hold keys nor lose lines. Rows that repeat a doc_id count
    as the same document. An empty table gives no rows.
    """
    lines = _rows(docs).where(F.col("doc_id").isNotNull()).select("doc_id", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc_id", "text_key", "pos", F.translate(F.btrim("line", F.lit(ASCII_SPACE)), UPPER, LOWER).alias("key")).where(F.length("key") >= min_chars)
    hashed = checkpoint(
        keyed.select(
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit(1), F.col("key")).alias("h2"),
            F.pmod(F.xxhash64("doc_id"), F.lit(BLOCKS)).cast("int").alias("block"),
            "doc_id",
            "text_key",
            "pos",
        )
    )
    heads = (
        hashed.groupBy("h1", "h2")
        .agg(
            F.min("doc_id").alias("first_doc"),
            F.max("doc_id").alias("last_doc"),
            F.bit_or(F.expr("shiftleft(1L, block)")).alias("blocks"),
        )
        .where("first_doc < last_doc")
        .select("h1", "h2", "first_doc", F.explode(F.expr(f"filter(sequence(0, {BLOCKS - 1}), b -> (shiftright(blocks, b) & 1L) = 1L)")).alias("block"))
    )
    both = heads.select("h1", "h2", "block", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("text_key"), F.lit(-1).alias("pos"), "first_doc").unionByName(
        hashed.withColumn("first_doc", F.lit(None).cast("long"))
    )
    in_order = Window.partitionBy("h1", "h2", "block").orderBy(F.col("doc_id").asc_nulls_first(), "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dropped = both.repartitionByRange("h1", "h2", "block").withColumn("first_doc", F.first("first_doc").over(in_order)).where("doc_id > first_doc")
    return (
        dropped.groupBy("doc_id", "text_key", F.expr("cast(pos div 64 as int)").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("drop"))
        .groupBy("doc_id", "text_key")
        .agg(
            F.sum(F.bit_count("drop")).cast("long").alias("n_dropped"),
            F.sort_array(F.collect_list(F.struct("word", "drop"))).alias("words"),
        )
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``, its text rewritten), ``n_lines``, ``n_dropped``.

    Each remaining line keeps its place; lines are joined by a newline.
    """
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])  # the text travels once
    own = docs.select(others.alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("whole")).withColumn("key", F.xxhash64("whole"))
    marks = bitmaps.select(F.col("doc_id").alias("mark_doc"), F.col("text_key").alias("mark_key"), F.col("n_dropped").alias("n"), F.map_from_entries("words").alias("marks"))
    joined = own.join(marks, (F.col("row.doc_id").cast("long") == F.col("mark_doc")) & (F.col("key") == F.col("mark_key")), "left").withColumn("lines", F.split("whole", "\n", -1))
    stays = "filter(lines, (x, i) -> (shiftright(coalesce(marks[cast(i div 64 as int)], 0L), i % 64) & 1L) = 0L)"
    kept = joined.withColumn("kept", F.when(F.col("marks").isNull(), F.col("whole")).otherwise(F.array_join(F.expr(stays), "\n")))
    return kept.select(
        F.struct(*[F.col("kept").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]).alias("row"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n_dropped"),
    )


def dedup_rows(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``row, n_lines, n_dropped``: the documents with repeated lines dropped, whatever their columns are called.

    Null and empty texts are one empty line; very long texts count whole; of documents that tie for a line the smallest id keeps it,
    in every row that has this id. Rows with a null id lose nothing. An empty table gives no rows.
    """
    return apply_bitmaps(docs, drop_bitmaps(docs, min_chars))


def line_dedup(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """``dedup_rows`` with the columns of ``docs`` side by side and ``__n_lines, __n_dropped``, which replace columns of these names."""
    own = [c for c in docs.columns if c.lower() not in ("__n_lines", "__n_dropped")]
    return dedup_rows(docs, min_chars).select(*[F.col(f"row.`{c}`").alias(c) for c in own], F.col("n_lines").alias("__n_lines"), F.col("n_dropped").alias("__n_dropped"))
