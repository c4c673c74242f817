"""Connected components by alternating large-star and small-star steps, on links between any sortable ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import written


def _least(links: DataFrame) -> DataFrame:
    """For each ``u`` the least of its neighbours ``v``, joined back to its links (partial minima shuffle first)."""
    return links.join(links.groupBy("u").agg(F.min("v").alias("m")), "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    out = _least(both).withColumn("m", F.least("u", "m"))
    return out.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    out = _least(down)
    hang = out.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hang.union(out.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (the least id that it reaches) for every id in ``links`` (u, v) but the roots themselves."""
    links = links.select("u", "v").where(F.col("u") != F.col("v")).distinct()
    before = None
    while True:
        links = written(_small_star(_large_star(links)).where(F.col("u") != F.col("v")).distinct(), "star")
        now = tuple(links.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
