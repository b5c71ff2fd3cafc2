"""A queue of specifications in a folder, handled by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def watch_queue(spark: SparkSession, path: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """A stream over a folder of queued specifications: what is there is handled in batches, once each, then it ends."""
    stream = spark.readStream.schema(schema).json(path)
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
