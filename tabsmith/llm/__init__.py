"""Operators of a training-data pipeline. Nothing outside this folder imports it.

``QUERIES`` and ``ORACLES`` are filled by the query modules; ``__spark_entry__``
adds them when the folder is there.
"""

from __future__ import annotations

import functools

from tabsmith.llm.common import ship_code

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name``, with its DuckDB twin if SQL has one."""

    def register(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            ship_code(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


from tabsmith.llm import query_defs  # noqa: E402,F401  (registers the queries)
