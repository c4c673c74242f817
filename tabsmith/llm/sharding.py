"""Sharding (operator 9): two-pass external shuffle.

Pass 1 scatters the records uniformly into buckets that fit in a task's memory, by a seeded hash of the
record. Pass 2 loads one bucket at a time, puts it in a canonical order and Fisher-Yates shuffles it with a
generator seeded by (seed, bucket), so a task that runs again gives the same rows. The buckets end to end are
one uniform shuffle of the table; it is cut into shards whose row counts differ by one at most.

Edge cases: null ids and texts take part (size 16, crc32 of no bytes); repeated rows are kept, each with a
slot of its own; an empty table gives no rows. Records that are equal in every column share a bucket. An input
column named like an output column (size, text_crc32, shard, slot) is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm.common import table_count, text_bytes, written

#: Bytes of text (and 16 a record) that a bucket holds; a task holds one bucket at a time.
BUCKET_BYTES = 16 << 20
_OWN = ("size", "text_crc32", "shard", "slot")


def measured(docs: DataFrame) -> DataFrame:
    """The records with ``size`` (UTF-8 bytes plus 16) and ``text_crc32`` (unsigned)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.drop(*_OWN).withColumn("size", text_bytes() + 16).withColumn("text_crc32", F.crc32(text))


def shard_positions(docs: DataFrame, shards: int = 40, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every record with ``shard`` (0 .. shards - 1) and ``slot``, its place in the shard."""
    docs = measured(docs)
    total = docs.agg(F.sum("size")).first()[0]
    buckets = table_count(total, bucket_bytes)
    names = [f for f in docs.schema.fields]
    key = F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size", "text")
    scattered = docs.withColumn("__bucket", F.pmod(key, F.lit(buckets)).cast("int"))
    # one row a bucket: 16 bytes for every bucket_bytes of input
    counts = {r["__bucket"]: r["count"] for r in scattered.groupBy("__bucket").count().collect()}
    n = sum(counts.values())
    starts = np.concatenate([[0], np.cumsum([counts.get(b, 0) for b in range(buckets)])]).astype(np.int64)
    offsets = docs.sparkSession.sparkContext.broadcast(starts)
    cut = np.array([-(-s * n // shards) for s in range(shards + 1)], np.int64)  # first position of each shard
    out = T.StructType([*names, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def shuffle(bucket: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(parts))
        own = bucket[0].as_py()
        table = table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("text_crc32", "ascending"), ("size", "ascending")]))
        order = np.random.Generator(np.random.PCG64([seed, own])).permutation(table.num_rows)  # Fisher-Yates
        at = offsets.value[own] + np.arange(table.num_rows)
        shard = np.searchsorted(cut, at, side="right") - 1
        table = table.drop_columns(["__bucket"]).take(pa.array(order))
        table = table.append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(at - cut[shard], pa.int64()))
        yield from table.to_batches()

    return scattered.groupBy("__bucket").applyInArrow(shuffle, out)


def write_shards(docs: DataFrame, shards: int = 40, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write the shuffled records, a folder for each shard, rows in slot order; returns the written table."""
    return written(shard_positions(docs, shards, seed, bucket_bytes).sortWithinPartitions("shard", "slot"), "shards", "shard")
