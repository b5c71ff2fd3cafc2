"""Balanced contiguous shards by global byte-size prefix sums (DataFrame functions only).

Documents are range-partitioned by id, which leaves each partition a total of bytes and rows. A running sum over those
totals (one row per partition) gives every partition its offset; a running sum inside the partition finishes the global
prefix sum. Shard k takes the documents whose prefix lies in the k-th of equal parts of the total. No task ever holds
more than one range of ids, and the one single-task window reads as many rows as there are partitions.

Defined cases: a null or empty text has size 1 (its end byte); a null id sorts first; rows with equal ids keep an order
by checksum and size; an empty table gives no rows; columns other than doc_id and text are ignored. A document larger
than a part leaves the parts it spans empty, as no document is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, partitions, real_id, safe_id, stored


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, str], name: str) -> DataFrame:
    """df with, for each (new column: column) of sums, the total of that column over all rows before in the given order."""
    n = partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, name)  # fixes the parts: a recomputed range partitioning need not agree
    totals = ranged.groupBy("part").agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_offset") for k in sums))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{k}_local") for k, c in sums.items()))
    joined = local.join(F.broadcast(offsets), "part")  # one row per partition
    return joined.select(*df.columns, *((F.col(f"{k}_offset") + F.col(f"{k}_local")).alias(k) for k in sums))


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard (0 to shards-1), slot (gapless from 0 in each shard), grown_shard (null)."""
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    narrow = docs.select(
        safe_id().alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit(1).cast("long").alias("one")
    )
    placed = prefix_sums(narrow, ["doc_id", "text_crc32", "size"], {"before": "size", "place": "one"}, "shards")
    total = placed.agg(F.max(F.col("before") + F.col("size")).alias("total"))
    cut = placed.crossJoin(F.broadcast(total)).withColumn(  # one row
        "shard", F.least(F.lit(shards - 1), F.floor(F.col("before").cast("decimal(38,0)") * shards / F.col("total"))).cast("int")
    )
    firsts = cut.groupBy("shard").agg(F.min("place").alias("first"))  # at most ``shards`` rows
    return cut.join(F.broadcast(firsts), "shard").select(
        real_id(), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


__all__ = ["NULL_ID", "prefix_sums", "shard_by_bytes"]
