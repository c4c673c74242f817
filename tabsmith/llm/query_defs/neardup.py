from __future__ import annotations

from tabsmith.llm import query
from tabsmith.llm.common import read_table
from tabsmith.llm.neardup import Rule, near_duplicates


@query("op7_near_duplicates")
def op7_near_duplicates(spark, sf_dir):
    """Components of documents whose sets of 3-word shingles are alike from 85 in 100."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"), Rule(words=3, num=85, den=100))
    return found.select("doc_id", "n_shingles", "component_id", "kept")
