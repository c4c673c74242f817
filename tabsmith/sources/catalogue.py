"""Sample catalogue (S5/S6): per CSV file, rows, columns, numeric/categorical
counts and the suggested target, each from one profile job of that table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.operators.profile import column_summary, target_suggestions
from tabsmith.sources.io import read_csv


def sample_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    rows = []
    # Spark lists the folder, so any store that it reads will do; no content is read here
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path")
    for path in sorted(r["path"] for r in found.collect()):
        df = read_csv(spark, path)
        kinds = column_summary(df).groupBy().agg(
            F.first("rows").alias("rows"),
            F.count(F.when(F.col("kind") == "numeric", 1)).alias("numeric"),
            F.count(F.when(F.col("kind") == "categorical", 1)).alias("categorical"),
        ).first()
        top = target_suggestions(df, 1).first()
        rows.append((os.path.splitext(os.path.basename(path))[0], path, int(kinds["rows"] or 0), len(df.columns),
                     int(kinds["numeric"]), int(kinds["categorical"]), top["column_name"] if top else None))
    return spark.createDataFrame(rows, "sample_id string, path string, rows long, columns long, numeric_columns long, "
                                       "categorical_columns long, suggested_target string")
