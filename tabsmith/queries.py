"""Registered queries over the driver tables: name -> (spark, sf_dir) -> DataFrame.

Every query reads whole tables (defects, where a rule needs them, are injected by
arithmetic on a key, identically in the oracle SQL).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabsmith.session import read_table

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    def register(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn

    return register


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


# Query modules register themselves on import.
from tabsmith import query_defs  # noqa: E402,F401
