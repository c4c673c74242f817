"""Saved runs of the original registry as goldens, and the edges of the rules."""

import pytest
from pyspark.sql import functions as F

from tabsmith.operators import governance as G

COLUMNS = (
    "model_id string, model_name string, dataset_id string, target_column string, problem_type string, created_at timestamp, primary_metric string, rank_score double, "
    + ", ".join(f"{side}_{m} double" for side in ("metric", "baseline") for m in ("r2", "f1_weighted", "balanced_accuracy", "accuracy"))
    + ", has_class_metrics boolean, leakage_features int, class_severity string, recommended_threshold double, model_features int, raw_features int, dropped_features int,"
    " trained_models int, candidate_models int, failed_models int, has_cv boolean, drivers int, has_artifact boolean, has_api boolean, next_actions array<string>"
)
GOOD = dict(
    model_id="m", model_name="AdaBoost Classifier", target_column="churn", problem_type="classification", rank_score=0.9662, metric_f1_weighted=0.97,
    baseline_f1_weighted=0.6, class_severity="mild", recommended_threshold=0.5, model_features=13, raw_features=13, trained_models=10, candidate_models=17,
    has_cv=True, drivers=5, has_artifact=True, has_api=True, next_actions=["Keep monitoring", "Keep monitoring", ""],
)
AUDITS = "model_id string, request_type string, row_count int, average_confidence double, low_confidence_rows int, created_at timestamp"
DRIFTS = "model_id string, report_id string, status string, score double, comparison_name string, created_at timestamp"


@pytest.fixture
def run(spark):
    names = [c.strip().split(" ")[0] for c in COLUMNS.split(", ")]

    def make(models, audits=(), drifts=(), champions=()):
        df = spark.createDataFrame([tuple(m.get(n) for n in names) for m in models], COLUMNS)
        return G.monitoring_run(
            df, spark.createDataFrame(list(audits), AUDITS), spark.createDataFrame(list(drifts), DRIFTS),
            spark.createDataFrame(list(champions), "model_id string, status string, score_delta double"), F.lit("2026-06-24 11:16:41").cast("timestamp"),
        )

    return make


def test_saved_snapshot_and_alerts(run):
    out = run([GOOD])
    s = out["snapshots"].first()
    assert (s.status, s.score, s.readiness_score, s.trust_score, s.drift_score, s.confidence_score, s.audit_score) == ("review", 64, 82, 96, 50, 45, 0)
    assert (s.blockers, s.warnings, s.recommendation_level, s.recommendation_title) == (0, 4, "review", "Review confidence before handoff")
    assert sorted(r.key for r in out["alerts"].collect()) == ["audit_coverage_low", "confidence_low", "drift_review", "monitoring_watch"]
    actions = out["monitored"].first().trust_actions
    assert actions[0].startswith("Model is ready") and actions.count("Keep monitoring") == 1 and "" not in actions


def test_nothing_saved_is_high_risk(run):
    m = run([{"model_id": "x", "problem_type": "classification"}])["monitored"].first()
    assert m.risk_level == "high" and m.readiness_status == "blocked" and m.status == "critical" and m.recommendation_title == "Fix deployment blockers first"
    assert [c.points for c in m.trust_checks] == [18, 4, 0, 4, 8, 0, 8, 6]


def test_newest_drift_and_batch_audits(run):
    from datetime import datetime as T

    out = run(
        [GOOD], [("m", "batch", 3, 0.9, 0, T(2026, 1, 1)), ("m", "single", 1, None, None, T(2026, 1, 2)), ("other", "single", 1, 0.1, 9, T(2026, 1, 2))],
        [("m", "a", "blocked", 20.0, "old", T(2026, 1, 1)), ("m", "b", "low", 95.0, "new", T(2026, 1, 2))], [("m", "challenger", -0.01)],
    )
    m = out["monitored"].first()
    assert (m.drift_status, m.audit_score, m.confidence_score, m.readiness_status, m.readiness_score) == ("low", 75, 90, "ready", 100)
    assert sorted(r.key for r in out["alerts"].collect()) == ["challenger_close", "champion_available"]


def test_timeline_keeps_ten_newest(run, spark):
    from datetime import datetime as T

    audits = [("m", "single", 1, 0.9, i % 2, T(2026, 2, i + 1)) for i in range(12)]
    out = run([GOOD | {"has_artifact": False, "created_at": T(2026, 1, 1)}], audits, [("m", "a", "medium", 70.0, "x", T(2026, 3, 1))])
    rows = G.timeline(out["monitored"], spark.createDataFrame(audits, AUDITS)).orderBy("position").collect()
    assert [r.kind for r in rows] == ["readiness", "drift"] + ["audit"] * 8 and rows[2].at == T(2026, 2, 12)
