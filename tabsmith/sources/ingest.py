"""Taking a table in (S4, S6, S16): saved once, profiled from the saved copy, registered by its content.

The input is read once, by the job that saves it as Parquet; the same job observes its rows (count, and two order-free
sums of row hashes), which is the table's content key. Profile, quality and catalogue row read the columnar copy. A table whose name and
content are registered already is not registered again; what was saved for it is an unregistered folder.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tabsmith.operators.profile import profile, target_suggestions
from tabsmith.operators.quality import QualityReport, quality_report
from tabsmith.sources.io import read_csv

DATASETS = "dataset_id string, name string, content string, path string, rows long, columns long, suggested_target string, problem_type string, created_at timestamp"


@dataclass
class Bundle:
    """What an upload returns: the registered row, the saved table, its profile and its quality report."""

    dataset_id: str
    record: dict
    data: DataFrame
    profile: DataFrame
    quality: QualityReport
    registered: bool


def datasets(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue; one row a dataset id, an empty frame before the first."""
    try:
        return spark.read.schema(DATASETS).parquet(f"{folder}/datasets")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], DATASETS)


def _observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    cells = [x for c in df.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    first, second = F.xxhash64(*cells), F.xxhash64(F.lit(1), *cells)
    seen = Observation()
    total = lambda h: F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string")
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), total(first).alias("a"), total(second).alias("b")), seen


def ingest(df: DataFrame, name: str, folder: str, order_by: str | None = None, now: datetime | None = None) -> Bundle:
    """Save, profile and register ``df`` under ``folder``, a path that all executors share."""
    spark = df.sparkSession
    dataset_id = uuid.uuid4().hex
    path = f"{folder}/data/{dataset_id}"
    watched, seen = _observed(df)
    watched.write.parquet(path)
    content = "-".join([str(seen.get["rows"]), seen.get["a"], seen.get["b"], ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields)])
    known = datasets(spark, folder).where((F.col("name") == name) & (F.col("content") == content)).orderBy("created_at", "dataset_id").first()
    saved = spark.read.schema(df.schema).parquet(known["path"] if known else path)
    if known:
        record = known.asDict()
    else:
        target = target_suggestions(saved, 1).first()
        row = (dataset_id, name, content, path, seen.get["rows"], len(df.columns), target["column_name"] if target else None, target["problem_type"] if target else None, now or datetime.now(timezone.utc))
        spark.createDataFrame([row], DATASETS).coalesce(1).write.mode("append").parquet(f"{folder}/datasets")
        record = dict(zip([f.split()[0] for f in DATASETS.split(", ")], row))
    return Bundle(record["dataset_id"], record, saved, profile(saved), quality_report(saved, order_by), not known)


def load_sample(spark: SparkSession, path: str, folder: str) -> Bundle:
    """A sample CSV read with full-data types, taken in under its file name."""
    return ingest(read_csv(spark, path), os.path.splitext(os.path.basename(path))[0], folder)
