"""Flat exports of registry frames: leaderboard (S10), explainability (S11), registry
lookup (S14) and listings (F9, A36). Each is a projection for all models at once; a
single model's file is a filter on ``model_id`` away from ``write.csv``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.operators.ranking import top_k_within
from tabsmith.sources.io import clamp_limit

# Metrics of an exported leaderboard row, and the default method of an explanation.
METRICS = ("accuracy", "balanced_accuracy", "f1_weighted", "r2", "mae", "rmse")
DEFAULT_METHOD = "permutation_importance"


def leaderboard_export(models: DataFrame) -> DataFrame:
    """S10. ``models``: model_id, best_model, quality_label, rank_score, primary_metric,
    holdout_metrics (map) and leaderboard, an array of structs (model_name, status,
    quality_label, rank_score, cv_available, cv_metric, cv_mean, cv_std, metrics,
    tuned_from, error). A model without leaderboard gets one row of its own numbers."""
    exploded = models.select("*", F.posexplode_outer("leaderboard").alias("at", "item"))
    own = F.col("item").isNull()

    def pick(field: str, fallback: Column | None = None) -> Column:
        other = F.lit(None) if fallback is None else fallback
        return F.when(own, other).otherwise(F.col("item")[field]).alias(field)

    metrics = F.when(own, F.col("holdout_metrics")).otherwise(F.col("item.metrics"))
    return exploded.select(
        (F.coalesce("at", F.lit(0)) + 1).cast("long").alias("rank"), "model_id", pick("model_name", F.col("best_model")), pick("status", F.lit("saved")),
        pick("quality_label", F.col("quality_label")), pick("rank_score", F.col("rank_score")), pick("cv_available"),
        pick("cv_metric", F.col("primary_metric")), pick("cv_mean"), pick("cv_std"), *[metrics[m].alias(m) for m in METRICS], pick("tuned_from"), pick("error"),
    )


def explainability_export(models: DataFrame) -> DataFrame:
    """S11. ``models``: model_id, best_model, target_column, method, summary, and the
    arrays of structs (feature, importance, impact, strength, share, interpretation)
    ``features`` and ``top_features``; the latter stands in for an empty former."""
    chosen = F.when(F.size(F.coalesce("features", F.array())) > 0, F.col("features")).otherwise(F.col("top_features"))
    fields = ("feature", "importance", "impact", "strength", "share", "interpretation")
    rows = models.select("*", F.posexplode(chosen).alias("at", "item"))
    return rows.select(
        (F.col("at") + 1).cast("long").alias("rank"), "model_id", "best_model", "target_column", *[F.col("item")[f].alias(f) for f in fields],
        F.coalesce(F.when(F.col("method") != "", F.col("method")), F.lit(DEFAULT_METHOD)).alias("method"), "summary",
    )


def record_by_id(registry: DataFrame, id_column: str, value) -> DataFrame:
    """The record with this id, or no row."""
    return registry.where(F.col(id_column) == F.lit(value)).limit(1)


def listing(registry: DataFrame, order_column: str, limit: int | None = None, default: int = 30, cap: int = 100) -> DataFrame:
    """the newest records, ``limit`` clamped to 1 .. ``cap``."""
    return registry.orderBy(F.desc(order_column)).limit(clamp_limit(limit, default, cap))


def drift_listing(reports: DataFrame, per_model: int = 1) -> DataFrame:
    """A36 for all models: total reports, the model's reports, and its newest one(s)."""
    counts = reports.groupBy("model_id").agg(F.count(F.lit(1)).cast("long").alias("filtered_reports"))
    total = reports.agg(F.count(F.lit(1)).cast("long").alias("total_reports"))
    newest = top_k_within(reports, ["model_id"], [F.desc("created_at"), F.desc("report_id")], per_model, "report_id")
    # one row on the right: the table's row count
    return newest.join(counts, "model_id").withColumn("_o", F.lit(1)).join(F.broadcast(total.withColumn("_o", F.lit(1))), "_o").select(
        "model_id", "total_reports", "filtered_reports", F.col("report_id").alias("latest_report"), F.col("status").alias("latest_status"),
    )


# Columns of the registry export and of the experiment export, in order.
REGISTRY_COLUMNS = (
    "model_id dataset_id target_column problem_type best_model quality_label primary_metric rank_score candidate_models trained_models failed_models "
    "raw_feature_count model_feature_count selected_feature_count excluded_feature_count dropped_feature_count engineered_feature_count recommended_threshold "
    "trust_score risk_level trust_decision trust_blockers trust_warnings champion_status production_status production_model_id first_recommendation prediction_api created_at"
).split()
EXPERIMENT_COLUMNS = (
    "experiment_id model_id dataset_id target_column problem_type best_model quality_label primary_metric rank_score previous_score score_delta is_latest is_best_for_group "
    "group_run_number candidate_models trained_models failed_models model_feature_count raw_feature_count first_recommendation prediction_api created_at"
).split()


def _flat(df: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` in order; those that a record doesn't have are null."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def registry_export(models: DataFrame, signals: DataFrame, promotions: DataFrame) -> DataFrame:
    """S8, a row a model: the record with trust columns, its champion status, its group's model in production, and the
    first of its ``next_actions`` (empty if none)."""
    keys = ["target_column", "problem_type", "primary_metric"]
    active = promotions.where(F.col("status") == "active").groupBy(*keys).agg(F.max("model_id").alias("production_model_id"))
    active = active.select(*[F.col(k).alias(f"_p_{k}") for k in keys], "production_model_id")
    rows = models.join(signals.select("model_id", F.col("status").alias("champion_status")), "model_id", "left")
    rows = rows.join(active, [rows[k].eqNullSafe(F.col(f"_p_{k}")) for k in keys], "left")
    in_use = F.when(F.col("production_model_id") == F.col("model_id"), "production").otherwise("not_production")
    said = F.coalesce(F.try_element_at("next_actions", F.lit(1)), F.lit("")) if "next_actions" in models.columns else F.lit("")
    return _flat(rows.withColumns({"production_status": in_use, "first_recommendation": said}), REGISTRY_COLUMNS)


def experiment_export(models: DataFrame, history: DataFrame) -> DataFrame:
    """S9, a row a run: the record with its place in the history of its group."""
    place = history.select("model_id", "previous_score", "score_delta", "is_latest", "is_best_for_group", "group_run_number")
    said = F.coalesce(F.try_element_at("next_actions", F.lit(1)), F.lit("")) if "next_actions" in models.columns else F.lit("")
    rows = models.join(place, "model_id").withColumns({"experiment_id": F.col("model_id"), "first_recommendation": said})
    return _flat(rows, EXPERIMENT_COLUMNS)
