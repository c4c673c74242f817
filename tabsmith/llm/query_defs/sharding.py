from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.llm import query
from tabsmith.llm.common import read_table
from tabsmith.llm.sharding import write_shards


@query("op9_sharding")
def op9_sharding(spark, sf_dir):
    """All documents in 40 shards under the law ``rows``; the shards themselves are written with whole records."""
    table = write_shards(read_table(spark, sf_dir, "documents"), shards=40)
    return table.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
