"""Frames derived from the driver tables, with defects injected by arithmetic on
a key (the oracle SQL injects the very same defects)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.queries import T


def lineitem_defects(spark, d) -> DataFrame:
    """All of lineitem, plus: nulls in l_quantity (orderkey % 11 = 0) and l_tax
    (orderkey % 3 = 0), a second copy of every line of orders with
    orderkey % 13 = 0, a high-cardinality text column, a constant column and an
    identifier column."""
    li = T(spark, d, "lineitem")
    k = F.col("l_orderkey")
    line_id = ((k * 2000 + F.col("l_partkey")) * 100 + F.col("l_suppkey")) * 8 + F.col("l_linenumber")
    copies = F.explode(F.sequence(F.lit(1), F.when(k % 13 == 0, F.lit(2)).otherwise(F.lit(1))))
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(k % 11 == 0, F.lit(None)).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice", "l_discount",
        F.when(k % 3 == 0, F.lit(None)).otherwise(F.col("l_tax")).alias("l_tax"),
        "l_returnflag", "l_linestatus", "l_shipdate",
        F.concat(F.lit("R"), line_id.cast("string")).alias("ship_ref"),
        F.lit("web").alias("channel"),
        line_id.alias("line_id"),
        copies.alias("_copy"),
    ).drop("_copy")
