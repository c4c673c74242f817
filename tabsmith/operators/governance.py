"""Model governance: trust (R1-R10), readiness (R11), monitoring (R12-R18), alerts
(R19), the whole run (R20) and the timeline (W9), with J1-J3 and E5.

Everything is a column expression over one row per model; audits and drift
reports are reduced to one row per model first (partial aggregates, so a model
with a third of all audits is no hot key) and joined on ``model_id``.

``models`` has: model_id, model_name, dataset_id, target_column, problem_type,
created_at, primary_metric, rank_score, ``metric_*`` and ``baseline_*`` for r2,
f1_weighted, balanced_accuracy and accuracy, has_class_metrics, leakage_features,
class_severity, recommended_threshold, model_features, raw_features,
dropped_features, trained_models, candidate_models, failed_models, has_cv,
drivers, has_artifact, has_api, next_actions (array). Null means "not saved".
``audits``: model_id, request_type, row_count, average_confidence,
low_confidence_rows, created_at. ``drifts``: model_id, report_id, status, score,
comparison_name, created_at. ``champions``: model_id, status, score_delta.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.scalar import bounded_score, status_from_score
from tabsmith.operators.ranking import top_k_within

C = F.col


def _classifier() -> Column:
    return C("problem_type") == "classification"


def _pick(*cases: tuple, default) -> Column:
    """The value of the first case whose condition holds; an unknown condition does not."""
    out = F
    for condition, value in cases:
        out = out.when(F.coalesce(condition, F.lit(False)), value)
    return out.otherwise(default)


def _verdict(status: str, points: int = 0) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(points).alias("points"))


# ------------------------------------------------------------------ trust
# Labels of the trust checks, in order.
TRUST_LABELS = (
    "Validation performance", "Baseline lift", "Leakage guard", "Class balance", "Prediction confidence", "Feature health",
    "Validation coverage", "Explainability",
)


def _first_metric(side: str) -> Column:
    """The first saved holdout metric of a classifier decides which one is compared."""
    names = ("f1_weighted", "balanced_accuracy", "accuracy")
    pairs = [(C(f"metric_{n}").isNotNull(), C(f"{side}_{n}")) for n in names]
    return F.when(C("problem_type") == "regression", C(f"{side}_r2")).otherwise(_pick(*pairs, default=F.lit(None).cast("double")))


def trust_checks() -> dict[str, Column]:
    """Label -> (status, points). Thresholds and points are fixed values."""
    regression = C("problem_type") == "regression"
    strong, usable = F.when(regression, 0.65).otherwise(0.85), F.when(regression, 0.35).otherwise(0.7)
    score, value, base = C("rank_score"), _first_metric("metric"), _first_metric("baseline")
    lift = value - base
    enough = F.when(regression, (value >= 0.35) & (lift >= 0.15)).otherwise(lift >= 0.12)
    some = F.when(regression, (value >= 0.15) & (lift > 0)).otherwise(lift >= 0.04)
    leaks, kept, raw = F.coalesce("leakage_features", F.lit(0)), C("model_features"), C("raw_features")
    failed_share = F.coalesce("failed_models", F.lit(0)) / F.greatest(C("candidate_models"), F.lit(1))
    return {
        "Validation performance": _pick(
            (score.isNull(), _verdict("risk", 18)), (score >= strong, _verdict("good")), (score >= usable, _verdict("warning", 8)),
            default=_verdict("risk", 22)),
        "Baseline lift": _pick(
            (lift.isNull(), _verdict("info", 4)), (enough, _verdict("good")), (some, _verdict("warning", 8)), default=_verdict("risk", 18)),
        "Leakage guard": _pick((leaks == 0, _verdict("good")), (leaks <= 2, _verdict("warning", 8)), default=_verdict("risk", 16)),
        "Class balance": _pick(
            (~_classifier(), _verdict("info")), (C("class_severity").isNull(), _verdict("info", 4)),
            (C("class_severity") == "balanced", _verdict("good")), (C("class_severity") == "mild", _verdict("warning", 4)),
            (C("class_severity") == "moderate", _verdict("warning", 9)), default=_verdict("risk", 15)),
        "Prediction confidence": _pick(
            (~_classifier(), _verdict("info")), (C("recommended_threshold").isNotNull(), _verdict("good")),
            (C("has_class_metrics"), _verdict("warning", 6)), default=_verdict("warning", 8)),
        "Feature health": _pick(
            (kept < 3, _verdict("risk", 12)), (C("dropped_features") >= 5, _verdict("warning", 6)),
            ((raw > 0) & (kept > 0) & (kept < raw * 0.5), _verdict("warning", 5)), default=_verdict("good")),
        "Validation coverage": _pick(
            ((C("candidate_models") > 0) & (failed_share >= 0.4), _verdict("risk", 12)),
            ((C("trained_models") >= 4) & C("has_cv"), _verdict("good")), (C("trained_models") >= 4, _verdict("warning", 5)),
            default=_verdict("warning", 8)),
        "Explainability": _pick((C("drivers") > 0, _verdict("good")), default=_verdict("warning", 6)),
    }


# The texts that users see.
TRUST_ACTIONS = {
    "Leakage guard": "Keep leakage columns excluded unless they are available before prediction time.",
    "Class balance": "Review minority-class recall and threshold settings before deployment.",
    "Baseline lift": "Add stronger predictor columns if baseline lift remains small.",
    "Validation performance": "Retrain after improving data quality or adding more labeled rows.",
    "Prediction confidence": "Use the what-if simulator and batch scoring to review low-confidence rows.",
    "Explainability": "Retrain or export explainability before stakeholder review.",
}
RISK_ACTIONS = {
    "high": "Do not promote this model until high-risk checks are fixed or accepted.",
    "medium": "Review warnings before using this model for business-critical predictions.",
    "low": "Model is ready for controlled testing with monitoring.",
}
TRUST_DECISIONS = {"low": "Ready for controlled testing", "medium": "Review before deployment", "high": "Do not deploy yet"}
READINESS_ACTIONS = {
    "artifact": "Retrain the model before deployment.",
    "api": "Retrain or restore the model API before deployment.",
    "audit": "Run at least one what-if or batch prediction before deployment.",
    "batch": "Run a CSV batch prediction before production handoff.",
    "explainability": "Retrain or export explainability before stakeholder review.",
    "report": "Train and save the model before report export.",
}
RECOMMENDATIONS = {
    "blocked": ("critical", "Fix deployment blockers first"),
    "drifted": ("critical", "Retrain or validate before production"),
    "unsure": ("review", "Review confidence before handoff"),
    "unchecked": ("review", "Run drift check next"),
    "stable": ("healthy", "Model is stable for controlled testing"),
    "rest": ("watch", "Monitor before full rollout"),
}
ALERT_TEXTS = {  # key: level, title, source
    "monitoring_critical": ("critical", "Production health is critical", "monitoring"),
    "monitoring_watch": ("warning", "Model needs monitoring review", "monitoring"),
    "drift_critical": ("critical", "High dataset drift detected", "drift"),
    "drift_review": ("warning", "Dataset drift needs review", "drift"),
    "readiness_blocked": ("critical", "Deployment readiness is blocked", "readiness"),
    "confidence_low": ("warning", "Prediction confidence is weak", "confidence"),
    "audit_coverage_low": ("warning", "Audit coverage is low", "audit"),
    "champion_available": ("info", "A stronger champion model exists", "champion"),
    "challenger_close": ("info", "Selected challenger is close to champion", "champion"),
}


def first_distinct(actions: Column, n: int = 6) -> Column:
    """E5: the first ``n`` distinct actions in their order, nulls and empty texts left out."""
    return F.slice(F.array_distinct(F.filter(actions, lambda a: F.coalesce(a, F.lit("")) != "")), 1, n)


def with_trust(models: DataFrame) -> DataFrame:
    """trust_checks (label, status, points), trust_score, risk_level, decision, blockers, warnings, actions."""
    checks = F.array(*[F.struct(F.lit(label).alias("label"), v["status"].alias("status"), v["points"].alias("points")) for label, v in trust_checks().items()])
    df = models.withColumn("trust_checks", checks)
    penalty = F.aggregate("trust_checks", F.lit(0), lambda acc, x: acc + x["points"])
    df = df.withColumn("trust_score", F.greatest(F.lit(0), F.least(F.lit(100), 100 - penalty)).cast("int"))
    df = df.withColumn("risk_level", F.when(C("trust_score") >= 80, "low").when(C("trust_score") >= 60, "medium").otherwise("high"))
    lookup = lambda texts, key: F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])[key]
    flagged = F.filter("trust_checks", lambda x: x["status"].isin("warning", "risk"))
    said = F.transform(flagged, lambda x: lookup(TRUST_ACTIONS, x["label"]))
    saved = F.coalesce("next_actions", F.array().cast("array<string>"))
    count = lambda status: F.size(F.filter("trust_checks", lambda x: x["status"] == status))
    return df.select(
        "*", lookup(TRUST_DECISIONS, C("risk_level")).alias("trust_decision"), count("risk").alias("trust_blockers"), count("warning").alias("trust_warnings"),
        first_distinct(F.concat(F.array(lookup(RISK_ACTIONS, C("risk_level"))), said, saved)).alias("trust_actions"),
    )


# ------------------------------------------------------------------ joins
def audit_facts(audits: DataFrame) -> DataFrame:
    """One row per model: audits, low-confidence rows, mean of the known averages (4 dp), any batch."""
    return audits.groupBy("model_id").agg(
        F.count(F.lit(1)).cast("long").alias("audits"), F.sum(F.coalesce("low_confidence_rows", F.lit(0))).cast("long").alias("low_rows"),
        F.round(F.avg("average_confidence"), 4).alias("average_confidence"), F.coalesce(F.bool_or(C("request_type") == "batch"), F.lit(False)).alias("has_batch"),
    )


def latest_drift(drifts: DataFrame) -> DataFrame:
    """The newest report of each model (ties: the larger report id)."""
    newest = F.max_by(F.struct("status", "score", "comparison_name", "created_at"), F.struct("created_at", "report_id"))
    return drifts.groupBy("model_id").agg(newest.alias("d")).select(
        "model_id", C("d.status").alias("drift_status"), C("d.score").alias("drift_report_score"), C("d.comparison_name").alias("drift_against"),
        C("d.created_at").alias("drift_at"), F.lit(True).alias("has_drift"),
    )


def model_datasets(models: DataFrame, datasets: DataFrame) -> DataFrame:
    """Models with their dataset's name and row count; models of unknown datasets stay."""
    return models.join(datasets.select("dataset_id", "dataset_name", "row_count"), "dataset_id", "left")


def with_facts(models: DataFrame, audits: DataFrame, drifts: DataFrame) -> DataFrame:
    df = models.join(audit_facts(audits), "model_id", "left").join(latest_drift(drifts), "model_id", "left")
    return df.fillna({"audits": 0, "low_rows": 0, "has_batch": False, "has_drift": False})


# ------------------------------------------------------------------ readiness
# Weight of each readiness check.
WEIGHTS = {"trust": 20, "artifact": 15, "api": 10, "audit": 10, "confidence": 10, "batch": 10, "explainability": 10, "report": 8, "drift": 7}


def readiness_checks() -> dict[str, Column]:
    """Key -> pass / warning / pending / blocked."""
    passes = lambda condition, otherwise: _pick((condition, F.lit("pass")), default=F.lit(otherwise))
    return {
        "trust": _pick((C("trust_score") >= 80, F.lit("pass")), (C("trust_score") >= 60, F.lit("warning")), default=F.lit("blocked")),
        "artifact": passes(C("has_artifact"), "blocked"),
        "api": passes(C("has_api"), "blocked"),
        "audit": passes(C("audits") > 0, "warning"),
        "confidence": passes(~_classifier() | ((C("average_confidence") >= 0.75) & (C("low_rows") == 0)), "warning"),
        "batch": passes(C("has_batch"), "warning"),
        "explainability": passes(C("drivers") > 0, "warning"),
        "report": passes(C("model_id").isNotNull(), "warning"),
        "drift": _pick((~C("has_drift"), F.lit("pending")), (C("drift_status") == "low", F.lit("pass")), (C("drift_status") == "medium", F.lit("warning")), default=F.lit("blocked")),
    }


def with_readiness(df: DataFrame) -> DataFrame:
    """R11 over :func:`with_trust` and :func:`with_facts` columns: score, status, counts and first actions."""
    df = df.withColumn("checks", F.array(*[F.struct(F.lit(k).alias("key"), v.alias("status"), F.lit(WEIGHTS[k]).alias("weight")) for k, v in readiness_checks().items()]))
    count = lambda *s: F.size(F.filter("checks", lambda x: x["status"].isin(*s)))
    share = lambda x: F.when(x["status"] == "pass", 1.0).when(x["status"] == "blocked", 0.0).otherwise(0.5)
    earned = F.aggregate("checks", F.lit(0.0), lambda acc, x: acc + x["weight"] * share(x))
    df = df.select("*", bounded_score(earned / sum(WEIGHTS.values()) * 100).alias("readiness_score"), count("blocked").alias("blockers"),
                   count("warning").alias("warnings"), count("pending").alias("pending"))
    ready = (C("readiness_score") >= 85) & (C("warnings") == 0) & (C("pending") <= 1)
    status = F.when(C("blockers") > 0, "blocked").when(ready, "ready").otherwise("review")
    texts = F.create_map(*[F.lit(x) for pair in READINESS_ACTIONS.items() for x in pair])
    open_checks = F.filter("checks", lambda x: x["status"] != "pass")
    say = lambda x: F.when(x["key"] == "trust", F.element_at("trust_actions", 1)).otherwise(texts[x["key"]])
    return df.withColumn("readiness_status", status).withColumn("readiness_actions", first_distinct(F.transform(open_checks, say)))


# ------------------------------------------------------------------ monitoring
def with_monitoring(df: DataFrame) -> DataFrame:
    """The five signals, their statuses, the weighted score, status and recommendation."""
    average = bounded_score(C("average_confidence") * 100)
    confidence = F.when(~_classifier(), 82).when(C("average_confidence").isNull(), 45).otherwise(F.greatest(F.lit(0), average - F.least(F.lit(30), C("low_rows") * 5)))
    df = df.select(
        "*", confidence.cast("int").alias("confidence_score"),
        F.when(C("has_drift"), bounded_score(F.coalesce("drift_report_score", F.lit(50)))).otherwise(50).alias("drift_score"),
        F.least(F.lit(100), C("audits") * 25 + F.when(C("has_batch"), 25).otherwise(0)).cast("int").alias("audit_score"),
    )
    parts = [("readiness_score", 0.34), ("trust_score", 0.22), ("drift_score", 0.2), ("confidence_score", 0.12), ("audit_score", 0.12)]
    total = reduce(lambda a, b: a + b, [C(name) * F.lit(weight) for name, weight in parts])
    bad_drift = F.coalesce(C("drift_status").isin("high", "blocked"), F.lit(False))
    blocked = C("readiness_status") == "blocked"
    unsure = _classifier() & ((C("confidence_score") < 65) | (C("low_rows") >= 3))
    df = df.select(
        "*", F.bround(total, 0).cast("int").alias("score"),
        status_from_score(C("readiness_score"), blocked).alias("readiness_card"),
        F.when(~C("has_drift"), "review").when(C("drift_status") == "low", "healthy").when(C("drift_status") == "medium", "watch").when(bad_drift, "critical").otherwise("review").alias("drift_card"),
        F.when(~_classifier(), "healthy").when(C("average_confidence").isNull(), "review").otherwise(status_from_score(C("confidence_score"))).alias("confidence_card"),
        status_from_score(F.when(C("audits") > 0, C("audit_score")).otherwise(45)).alias("audit_card"),
    )
    df = df.withColumn("status", status_from_score(C("score"), blocked | bad_drift))
    reason = F.when(blocked, "blocked").when(bad_drift, "drifted").when(unsure, "unsure").when(~C("has_drift"), "unchecked").when(C("score") >= 85, "stable").otherwise("rest")
    texts = lambda i: F.create_map(*[F.lit(x) for k, v in RECOMMENDATIONS.items() for x in (k, v[i])])[reason]
    retrain = F.when(reason == "drifted", True).when(reason == "unsure", C("confidence_score") < 55).otherwise(False)
    return df.select("*", texts(0).alias("recommendation_level"), texts(1).alias("recommendation_title"), retrain.alias("retrain_recommended"))


def snapshot_rows(monitored: DataFrame, created_at: Column) -> DataFrame:
    """One flat row per model, ready to be appended to the snapshots."""
    return monitored.select(
        F.concat_ws("-", C("model_id").cast("string"), created_at.cast("string")).alias("snapshot_id"), "model_id", "model_name", "target_column", "problem_type",
        "status", "score", "readiness_score", "trust_score", "drift_score", "confidence_score", "audit_score", "blockers",
        (C("warnings") + C("pending")).alias("warnings"), "recommendation_level", "recommendation_title", created_at.alias("created_at"),
    )


def alert_rows(monitored: DataFrame, champions: DataFrame) -> DataFrame:
    """The alerts that each model raises now, one row per key."""
    ranks = champions.select("model_id", C("status").alias("champion_status"), C("score_delta").alias("champion_delta"))
    df = monitored.join(ranks, "model_id", "left")
    behind = C("champion_status") == "challenger"
    raised = {
        "monitoring_critical": C("status") == "critical",
        "monitoring_watch": C("status").isin("review", "watch"),
        "drift_critical": C("drift_card") == "critical",
        "drift_review": C("drift_card").isin("review", "watch"),
        "readiness_blocked": (C("readiness_card") == "critical") | (C("blockers") > 0),
        "confidence_low": C("confidence_card").isin("critical", "review"),
        "audit_coverage_low": C("audit_card").isin("critical", "review"),
        "champion_available": behind,
        "challenger_close": behind & (C("champion_delta") >= -0.02),
    }
    fields = ("level", "title", "source")
    rows = [
        F.when(condition, F.struct(F.lit(key).alias("key"), *[F.lit(x).alias(f) for f, x in zip(fields, ALERT_TEXTS[key])]))
        for key, condition in raised.items()
    ]
    return df.select("model_id", F.explode(F.array_compact(F.array(*rows))).alias("a")).select("model_id", "a.*")


def monitoring_run(models: DataFrame, audits: DataFrame, drifts: DataFrame, champions: DataFrame, created_at: Column) -> dict[str, DataFrame]:
    """R20 for all models at once: the monitored frame, snapshot rows and alerts."""
    monitored = with_monitoring(with_readiness(with_facts(with_trust(models), audits, drifts)))
    return {"monitored": monitored, "snapshots": snapshot_rows(monitored, created_at), "alerts": alert_rows(monitored, champions)}


# ------------------------------------------------------------------ timeline
def timeline(monitored: DataFrame, audits: DataFrame) -> DataFrame:
    """W9 per model: blocker first, then model, drift and the 8 newest audits by time, newest first; 10 rows."""
    event = lambda df, kind, at, status, order: df.select("model_id", F.lit(kind).alias("kind"), at.alias("at"), status.alias("status"), F.lit(order).alias("kind_order"))
    newest = top_k_within(audits.withColumn("_c", F.xxhash64(*audits.columns)), ["model_id"], [F.desc("created_at"), F.desc("_c")], 8, "_c")
    # audits of models that are not there have no timeline
    newest = newest.join(monitored.select("model_id"), "model_id", "left_semi")
    drift_status = F.when(C("drift_status") == "low", "healthy").when(C("drift_status").isin("high", "blocked"), "critical").otherwise("warning")
    events = [
        event(monitored.where(C("readiness_status") == "blocked"), "readiness", F.lit(None).cast("timestamp"), F.lit("critical"), 0),
        event(monitored, "model", C("created_at").cast("timestamp"), F.lit("healthy"), 1),
        event(monitored.where("has_drift"), "drift", C("drift_at").cast("timestamp"), drift_status, 2),
        event(newest, "audit", C("created_at").cast("timestamp"), F.when(C("low_confidence_rows") > 0, "warning").otherwise("healthy"), 3),
    ]
    rows = reduce(DataFrame.unionByName, events)  # 11 a model at most
    per_model = rows.groupBy("model_id").agg(F.sort_array(F.collect_list(F.struct(
        (C("kind") != "readiness").alias("later"), (-F.coalesce(F.unix_micros("at"), F.lit(0))).alias("age"), "kind_order", "status", "kind", "at"))).alias("e"))
    picked = per_model.select("model_id", F.posexplode(F.slice("e", 1, 10)).alias("i", "x"))
    return picked.select("model_id", (C("i") + 1).cast("long").alias("position"), "x.kind", "x.status", "x.at")
