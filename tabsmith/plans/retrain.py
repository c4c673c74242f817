"""Runs that follow from earlier ones: the accuracy booster (M25) and retraining from a drift report.

A run is a row: which dataset and run it comes from, its score, how it was made. A run counts as the latest only if the one that
it was compared with still is (``append_run``), so two boosters at once can't both claim to improve the same run.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.operators.clean import clean_dataframe
from tabsmith.plans.train import TrainingResult, train_models

# The difference that counts, and what is said of each outcome.
MARGIN = 0.001
SUMMARIES = {
    "improved": "Boosted run improved the latest saved score.",
    "needs_review": "Boosted run completed. Compare details before promoting this model.",
    "no_change": "Boosted run completed. Compare details before promoting this model.",
    "baseline_unavailable": "Boosted run completed. No previous comparable run was available.",
}
RUNS = "run_id string, parent_run_id string, dataset_id string, target_column string, problem_type string, mode string, model string, rank_score double, status string, delta double, source string, created_at timestamp"


class Conflict(ValueError):
    """Another run became the latest one meanwhile."""


def outcome(previous: float | None, score: float | None) -> tuple[str, float | None]:
    """The status of a run against the one before, and the difference."""
    if previous is None or score is None:
        return "baseline_unavailable", None
    delta = round(score - previous, 4)
    return ("improved" if delta > MARGIN else "needs_review" if delta < -MARGIN else "no_change"), delta


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(RUNS).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RUNS)


def latest_run(runs: DataFrame, dataset_id: str, target: str):
    """The newest run on this dataset and target, or None."""
    own = runs.where((F.col("dataset_id") == dataset_id) & (F.col("target_column") == target))
    return own.orderBy(F.desc("created_at"), F.desc("run_id")).first()


def append_run(spark: SparkSession, path: str, record: tuple) -> None:
    """Append a run if its parent still is the latest of its dataset and target."""
    fields = dict(zip([f.split()[0] for f in RUNS.split(", ")], record))
    now = latest_run(read_runs(spark, path), fields["dataset_id"], fields["target_column"])
    if (now["run_id"] if now else None) != fields["parent_run_id"]:
        raise Conflict(f"run {now['run_id'] if now else None} is the latest, not {fields['parent_run_id']}")
    spark.createDataFrame([record], RUNS).coalesce(1).write.mode("append").parquet(path)


@dataclass
class Rerun:
    training: TrainingResult
    status: str
    summary: str
    delta: float | None
    record: dict


def _recorded(spark: SparkSession, path: str, result: TrainingResult, dataset_id: str, target: str, mode: str, parent, source: str) -> Rerun:
    top = result.leaderboard.first()
    score = top["rank_score"] if top else None
    status, delta = outcome(parent["rank_score"] if parent else None, score)
    record = (uuid.uuid4().hex, parent["run_id"] if parent else None, dataset_id, target, result.problem_type, mode, result.best_name, score, status, delta, source, datetime.now(timezone.utc))
    append_run(spark, path, record)
    return Rerun(result, status, SUMMARIES[status], delta, dict(zip([f.split()[0] for f in RUNS.split(", ")], record)))


def accuracy_booster(df: DataFrame, target: str, dataset_id: str, runs_path: str, features: list[str] | None = None, problem_type: str = "auto", **training) -> Rerun:
    """Clean, train again on the features that are left, compare with the latest run of the dataset, and record it."""
    spark = df.sparkSession
    parent = latest_run(read_runs(spark, runs_path), dataset_id, target)
    cleaned = clean_dataframe(df, target)
    changed = [r["step_id"] for r in cleaned.steps.where("changed").orderBy("step_order").collect()]
    left = [c for c in cleaned.cleaned.columns if c != target]
    chosen = [c for c in (features or df.columns) if c in left] or left
    if not chosen:
        raise ValueError("no usable feature columns remain after cleaning")
    result = train_models(cleaned.cleaned, target, problem_type, chosen, **training)
    return _recorded(spark, runs_path, result, dataset_id, target, "accuracy_booster", parent, ",".join(changed))


def retrain_from_drift(comparison: DataFrame, source_features: list[str], target: str, dataset_id: str, drift_id: str, runs_path: str, problem_type: str = "auto", **training) -> Rerun:
    """Train on the drifted dataset, which must have the target, with the source model's features that it has (all, if none)."""
    if target not in comparison.columns:
        raise ValueError(f"the comparison dataset has no column {target!r}: retraining needs a labelled dataset")
    spark = comparison.sparkSession
    parent = latest_run(read_runs(spark, runs_path), dataset_id, target)
    reused = [c for c in source_features if c in comparison.columns and c != target]
    result = train_models(comparison, target, problem_type, reused or None, **training)
    return _recorded(spark, runs_path, result, dataset_id, target, "retrain_from_drift", parent, drift_id)
