"""A folder of stacks as a stream: each micro-batch of new files is traced and written."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..plans.trace import trace
from ..sources.swc import write_swc
from ..sources.volume import STACKS, read_tiff


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, threshold: int = -1, local: bool = False, **options):
    """Start the query. Each batch writes a folder of its own, so that a batch run again after a
    failure replaces what it wrote."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", STACKS).load(folder).select("path")

    def one(batch, number: int) -> None:
        paths = [r["path"] for r in batch.collect()]  # names of new files only
        if paths:
            write_swc(trace(read_tiff(spark, paths), threshold, local, **options), f"{out}/batch={number}")

    return files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
