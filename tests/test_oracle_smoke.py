"""A sample of registered queries against their DuckDB oracle at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tabsmith.session import TABLES

from .conftest import SMOKE

NAMES = [
    "profile_lineitem", "top_values_customer", "quality_issues_lineitem_defects", "histogram_lineitem_l_quantity",
    "drift_summary_orders", "classification_metrics_rule", "experiment_history_orders", "alert_merge_events",
]


def _norm(pdf):
    cols = sorted(pdf.columns)

    def n(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        if isinstance(v, float):
            return round(v, 6)
        return v.item() if hasattr(v, "item") else v

    return cols, sorted((tuple(n(x) for x in r) for r in pdf[cols].itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    got = _norm(E.queries()[name](spark, SMOKE).toPandas())
    want = _norm(con.execute(E.oracle_sql()[name]).df())
    assert got == want


def test_entry_runs(spark):
    assert E.entry(spark).count() > 0


def test_every_query_has_a_callable():
    qs, ors = E.queries(), E.oracle_sql()
    assert set(ors) <= set(qs)
