"""Cleaning-chain queries (C1-C8, A35) and their oracles."""

from __future__ import annotations

from tabsmith import oracles as O
from tabsmith.operators import clean as C
from tabsmith.operators import profile as P
from tabsmith.queries import query
from tabsmith.query_defs.fixtures import lineitem_defects
from tabsmith.sql_registry import oracle

TARGET = "l_quantity"
# The constant and identifier columns of the defect frame (the steps query
# checks that the chain finds exactly these).
DROPPED = ["channel", "line_id"]


def _clean(spark, d):
    return C.clean_dataframe(lineitem_defects(spark, d), target=TARGET, order_by="line_id")


@query("cleaning_summary_lineitem_defects")
def cleaning_summary(spark, d):
    return _clean(spark, d).summary


oracle("cleaning_summary_lineitem_defects",
       O.cleaning_summary_sql(O.LINEITEM_DEFECTS_SQL, O.LINEITEM_DEFECTS_COLS, TARGET, DROPPED, "line_id"))


@query("cleaned_profile_lineitem_defects")
def cleaned_profile(spark, d):
    return P.profile(_clean(spark, d).cleaned)


oracle("cleaned_profile_lineitem_defects",
       O.cleaned_profile_sql(O.LINEITEM_DEFECTS_SQL, O.LINEITEM_DEFECTS_COLS, TARGET, DROPPED))
