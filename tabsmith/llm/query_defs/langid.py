from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.llm import query
from tabsmith.llm.common import read_table, remainder
from tabsmith.llm.langid import fit, identify


@query("op1_language_id")
def op1_language_id(spark, sf_dir):
    """Language of every document; learns from the folds 0, 1 and 3 of four."""
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", remainder("doc_id", 4) == 2)
    model = fit(docs.where(~F.col("held_out")))
    return identify(docs, model, ["doc_id", "held_out"])
