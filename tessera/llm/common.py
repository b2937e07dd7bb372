"""Shared pieces of the training-data operators: inputs, checkpoints, bounded samples.

Inputs are read by name and projected at once to the columns an operator needs, so
extra columns (whatever they are called) never reach a join.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters of the contracts: space and U+0009 to U+000D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id long, text string``; a null text is an empty one."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


#: Rows of ids up to which a side of a join is broadcast: the driver collects, hashes and serializes them.
BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which all executors share.

    Only in local mode, where there is one machine, a temporary folder stands in for a missing setting.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder, so a lost executor costs nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def small_side(ids: DataFrame) -> DataFrame:
    """A checkpointed table of a few ids a row, marked for broadcast where it has at most ``BROADCAST_ROWS`` rows.

    A larger one goes to the join as it is, and the join shuffles.
    """
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def crc_mod(doc_id: Column, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``: the fold of a row (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(mod)


def per_class_sample(rows: DataFrame, label: str, per_class: int, seed: int = 7) -> DataFrame:
    """About ``per_class`` rows of each value of ``label``, chosen by a hash of ``doc_id``.

    The bound makes the sample safe to broadcast and to collect: its expected size is
    ``per_class`` for each label value, whatever the table's size. A class with fewer rows
    keeps them all. Label values are few by nature (languages, 0 or 1).
    """
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    share = F.least(F.lit(1.0), F.lit(float(per_class)) / F.col("__n"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) / F.lit(1e6)
    return rows.join(F.broadcast(counts), label).where(draw < share).drop("__n")


def bounded(sample: DataFrame, size: Column, most_bytes: int, seed: int = 9) -> DataFrame:
    """The distinct rows of a sample, or a share of them chosen by a hash, so that ``size`` adds up to about ``most_bytes``.

    A sample is bounded in rows; texts of any length, and rows that repeat an id, make this bound necessary before it is collected.
    """
    rows = checkpoint(sample.distinct())
    total = rows.agg(F.sum(size)).first()[0] or 0
    if total <= most_bytes:
        return rows
    draw = F.pmod(F.xxhash64(*rows.columns, F.lit(seed)), F.lit(1_000_000)) / F.lit(1e6)
    return rows.where(draw < most_bytes / total)


def labelled_text(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int) -> DataFrame:
    """``doc_id, text, label`` of a bounded sample of the rows that may be learnt from.

    Labels are sampled first, so the side broadcast to the text scan has at most about
    ``2 * per_class`` rows. Null labels and null ids are left out; of repeated label rows
    the largest value counts.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & learn)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    chosen = per_class_sample(known, "label", per_class)
    return id_and_text(docs).join(F.broadcast(chosen), "doc_id")
