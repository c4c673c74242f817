from __future__ import annotations

from tabsmith.llm import query
from tabsmith.llm.common import read_table
from tabsmith.llm.decontaminate import contaminated


@query("op10_decontamination")
def op10_decontamination(spark, sf_dir):
    """Documents that hold a copy, whole or edited, of a benchmark item."""
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
