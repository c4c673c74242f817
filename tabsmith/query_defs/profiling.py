"""Profiling queries (A1-A4, A34, W5) and their oracles."""

from __future__ import annotations

from tabsmith import oracles as O
from tabsmith.operators import profile as P
from tabsmith.queries import T, query
from tabsmith.sql_registry import oracle


@query("profile_lineitem")
def profile_lineitem(spark, d):
    return P.profile(T(spark, d, "lineitem"))


oracle("profile_lineitem", O.profile_sql("lineitem"))


for _t in ("customer", "documents", "events", "part", "orders"):

    def _kinds(spark, d, _t=_t):
        return P.column_kinds(T(spark, d, _t))

    query(f"column_kinds_{_t}")(_kinds)
    oracle(f"column_kinds_{_t}", O.kinds_sql(_t))


@query("profile_events")
def profile_events(spark, d):
    return P.profile(T(spark, d, "events"))


oracle("profile_events", O.profile_sql("events"))


@query("profile_documents")
def profile_documents(spark, d):
    return P.profile(T(spark, d, "documents"))


oracle("profile_documents", O.profile_sql("documents"))


for _t in ("lineitem", "customer", "events", "orders"):

    def _top(spark, d, _t=_t):
        return P.top_values(T(spark, d, _t), k=5)

    query(f"top_values_{_t}")(_top)
    oracle(f"top_values_{_t}", O.top_values_sql(_t))


for _t in ("lineitem", "customer", "part", "orders"):

    def _sugg(spark, d, _t=_t):
        return P.target_suggestions(T(spark, d, _t))

    query(f"target_suggestions_{_t}")(_sugg)
    oracle(f"target_suggestions_{_t}", O.target_suggestions_sql(_t))
