"""Sharding by longest processing time: groups of equal texts, by size, go to the least-loaded shard.

Groups are summed on all executors (copies of a hot text are pre-aggregated before the shuffle). Each of ``BUCKETS``
buckets of groups is laid, largest group first, into as many local bins as there are shards, through a heap that holds
nothing but the bins' loads. The bins (at most ``BUCKETS * n_shards``, whatever the input) are then laid on the shards in
the same way on the driver. Small inputs have a group a bin, so that the result is the plain schedule.

Defined cases: null texts form one group of size 1 each; equal sizes are ordered by the text's hashes; repeated rows count as
often as they occur and share a shard; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

BUCKETS = 1024
SLOT_CHUNKS = 256


def schedule(sizes: list[int], n: int) -> list[int]:
    """The shard of each item: items by falling size, each to the least-loaded shard."""
    heap = [(0, k) for k in range(n)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, k = heap[0]
        out[i] = k
        heapq.heapreplace(heap, (load + sizes[i], k))
    return out


def _local_bins(n: int):
    def run(batches):
        bucket, heap = None, []
        for batch in batches:
            keys, sizes = batch.column("bucket").to_pylist(), batch.column("size").to_pylist()
            bins = np.zeros(len(keys), np.int64)
            for i, (key, size) in enumerate(zip(keys, sizes, strict=True)):
                if key != bucket:
                    bucket, heap = key, [(0, k) for k in range(n)]
                load, k = heap[0]
                heapq.heapreplace(heap, (load + size, k))
                bins[i] = key * n + k
            yield pa.RecordBatch.from_arrays([batch.column("h1"), batch.column("h2"), batch.column("size"), pa.array(bins)], ["h1", "h2", "size", "bin"])

    return run


def shard(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (0, 1, ... within the shard) of every row of ``docs``."""
    spark = docs.sparkSession
    text = F.col("text")
    rows = durable(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64(text).alias("h1"),
            F.xxhash64(F.lit(1), text).alias("h2"),
            F.monotonically_increasing_id().alias("row"),  # rows of one id are dealt apart
        )
    )
    groups = rows.groupBy("h1", "h2").agg(F.sum("size").alias("size")).withColumn("bucket", F.pmod("h1", F.lit(BUCKETS)))
    ordered = groups.repartition("bucket").sortWithinPartitions("bucket", F.desc("size"), "h1", "h2")
    binned = durable(ordered.mapInArrow(_local_bins(n_shards), "h1 long, h2 long, size long, bin long"))
    bins = binned.groupBy("bin").agg(F.sum("size").alias("size")).orderBy("bin").collect()  # BUCKETS * n_shards rows at most
    placed = [(b["bin"], s) for b, s in zip(bins, schedule([b["size"] for b in bins], n_shards), strict=True)]
    shards = F.broadcast(spark.createDataFrame(placed, "bin long, shard int"))
    rows = rows.join(binned.join(shards, "bin").select("h1", "h2", "shard"), ["h1", "h2"]).drop("h1", "h2")
    # slots: an offset for each chunk of a shard, then the place within the chunk; no task holds a whole shard
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(SLOT_CHUNKS)))
    counts = rows.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "size", "text_crc32", "row")) - 1
    rows = rows.withColumn("place", place).join(F.broadcast(base), ["shard", "chunk"])
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("place")).alias("slot"))
