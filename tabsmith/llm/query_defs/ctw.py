from __future__ import annotations

from tabsmith.llm import query
from tabsmith.llm.common import read_table, remainder
from tabsmith.llm.ctw import lm_scores


@query("op6_lm_scores")
def op6_lm_scores(spark, sf_dir):
    """log10 probability of every document; learns from nine folds of ten."""
    return lm_scores(read_table(spark, sf_dir, "documents"), remainder("doc_id", 10) == 0)
