from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.llm import query
from tabsmith.llm.ann import nearest
from tabsmith.llm.common import read_table


@query("op2_nearest_neighbours")
def op2_nearest_neighbours(spark, sf_dir):
    """The 20 nearest of each embedding whose id 20 divides, among all others."""
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
