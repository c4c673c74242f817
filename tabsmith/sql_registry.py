"""Oracle SQL registry: query name -> DuckDB SQL string."""

from __future__ import annotations

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql
