"""Incremental ingest: newly arrived containers are decoded and appended, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tessera.sources import assets


# The columns of Spark's source of whole files; a stream must state them.
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Objects of new files below ``source`` go to Parquet in ``target``, a folder for each batch.

    A batch that is run again after a failure overwrites its own folder, so each file counts once.
    """
    incoming = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true").load(source)

    def write(batch: DataFrame, number: int) -> None:
        found = assets.unfolded(batch)
        assets.decode(assets.objects(found)).drop("payload").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return incoming.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
