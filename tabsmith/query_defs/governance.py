"""Trust, readiness, monitoring and alert queries over registry frames derived from
customer (models), events (audits) and orders (drift reports), with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.operators import governance as G
from tabsmith.queries import T, query
from tabsmith.sources import exports as X
from tabsmith.sql_registry import oracle

# One model per customer; every attribute is arithmetic on its key, the same text in both engines.
_MODEL_SQL = {
    "model_id": "c_custkey",
    "model_name": "c_mktsegment",
    "dataset_id": "c_nationkey",
    "target_column": "c_name",
    "problem_type": "CASE WHEN c_custkey % 4 = 0 THEN 'regression' ELSE 'classification' END",
    "created_at": "TIMESTAMP '1998-06-01 00:00:00'",
    "primary_metric": "CAST(NULL AS STRING)",
    "rank_score": "CASE WHEN c_custkey % 17 <> 0 THEN ((c_custkey * 37) % 101) / CAST(100.0 AS DOUBLE) END",
    "metric_r2": "CASE WHEN c_custkey % 19 <> 0 THEN ((c_custkey * 41) % 100) / CAST(100.0 AS DOUBLE) END",
    "baseline_r2": "CASE WHEN c_custkey % 23 <> 0 THEN ((c_custkey * 7) % 50) / CAST(100.0 AS DOUBLE) END",
    "metric_f1_weighted": "CASE WHEN c_custkey % 5 <> 0 THEN ((c_custkey * 43) % 100) / CAST(100.0 AS DOUBLE) END",
    "baseline_f1_weighted": "((c_custkey * 11) % 90) / CAST(100.0 AS DOUBLE)",
    "metric_balanced_accuracy": "CASE WHEN c_custkey % 10 <> 0 THEN ((c_custkey * 13) % 100) / CAST(100.0 AS DOUBLE) END",
    "baseline_balanced_accuracy": "((c_custkey * 17) % 60) / CAST(100.0 AS DOUBLE)",
    "metric_accuracy": "CASE WHEN c_custkey % 20 <> 0 THEN ((c_custkey * 3) % 100) / CAST(100.0 AS DOUBLE) END",
    "baseline_accuracy": "((c_custkey * 19) % 70) / CAST(100.0 AS DOUBLE)",
    "has_class_metrics": "c_custkey % 3 = 0",
    "leakage_features": "CASE WHEN c_custkey % 13 <> 0 THEN (c_custkey * 5) % 6 % 4 END",
    "class_severity": "CASE c_custkey % 6 WHEN 0 THEN 'balanced' WHEN 1 THEN 'mild' WHEN 2 THEN 'moderate' WHEN 3 THEN 'severe' WHEN 4 THEN 'balanced' END",
    "recommended_threshold": "CASE WHEN c_custkey % 2 = 0 THEN CAST(0.5 AS DOUBLE) END",
    "model_features": "CASE WHEN c_custkey % 29 <> 0 THEN (c_custkey * 3) % 14 END",
    "raw_features": "(c_custkey * 3) % 14 + c_custkey % 12",
    "dropped_features": "c_custkey % 8",
    "trained_models": "c_custkey % 9",
    "candidate_models": "c_custkey % 9 + c_custkey % 5",
    "failed_models": "c_custkey % 5",
    "has_cv": "c_custkey % 7 <> 0",
    "drivers": "c_custkey % 4 * 3",
    "has_artifact": "c_custkey % 11 <> 0",
    "has_api": "c_custkey % 31 <> 0",
}
_AUDIT_SQL = {
    "model_id": "user_id",
    "request_type": "CASE WHEN event_type = 'purchase' THEN 'batch' ELSE 'single' END",
    "row_count": "event_id % 50 + 1",
    "average_confidence": "CASE WHEN event_id % 10 <> 0 THEN (55 + (event_id * 7) % 45) / CAST(100.0 AS DOUBLE) END",
    "low_confidence_rows": "CASE WHEN event_id % 40 = 0 THEN 1 ELSE 0 END",
    "created_at": "ts",
    "audit_id": "event_id",
}
_DRIFT_SQL = {
    "model_id": "o_custkey + CASE WHEN o_custkey % 3 = 1 THEN 1 ELSE 0 END",  # models of every third key have none
    "report_id": "o_orderkey",
    "status": "CASE o_orderkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN 'low' ELSE 'blocked' END",
    "score": "CAST((o_orderkey * 13) % 101 AS DOUBLE)",
    "comparison_name": "o_orderpriority",
    "created_at": "o_orderdate",
}
_CHAMPION_SQL = {
    "model_id": "c_custkey",
    "status": "CASE WHEN c_custkey % 3 = 0 THEN 'champion' ELSE 'challenger' END",
    "score_delta": "-((c_custkey * 7) % 10) / CAST(100.0 AS DOUBLE)",
}


def _derived(spark, d, table, columns):
    return T(spark, d, table).selectExpr(*[f"{sql} AS {name}" for name, sql in columns.items()])


def _select(columns: dict, table: str) -> str:
    body = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    return f"SELECT {body} FROM {table}".replace("AS STRING", "AS VARCHAR")


def frames(spark, d):
    models = _derived(spark, d, "customer", _MODEL_SQL).withColumn("next_actions", F.array(F.concat(F.lit("Check "), "model_name")))
    drifts = _derived(spark, d, "orders", _DRIFT_SQL)
    return models, _derived(spark, d, "events", _AUDIT_SQL), drifts, _derived(spark, d, "customer", _CHAMPION_SQL)


def run(spark, d):
    return G.monitoring_run(*frames(spark, d), F.lit("1998-09-01 00:00:00").cast("timestamp"))


@query("trust_scores_customer")
def trust_scores(spark, d):
    t = G.with_trust(frames(spark, d)[0])
    points = [F.element_at("trust_checks", i + 1)["points"].alias(f"points_{i}") for i in range(8)]
    return t.select("model_id", "trust_score", "risk_level", "trust_decision", "trust_blockers", "trust_warnings", *points, F.array_join("trust_actions", "|").alias("actions"))


@query("readiness_customer")
def readiness(spark, d):
    r = run(spark, d)["monitored"]
    states = [F.element_at("checks", i + 1)["status"].alias(f"check_{k}") for i, k in enumerate(G.WEIGHTS)]
    return r.select("model_id", "readiness_score", "readiness_status", "blockers", "warnings", "pending", *states)


@query("monitoring_snapshots_customer")
def snapshots(spark, d):
    return run(spark, d)["snapshots"].drop("created_at", "snapshot_id")


@query("monitoring_alerts_customer")
def alerts(spark, d):
    return run(spark, d)["alerts"]


@query("model_timeline_customer")
def timelines(spark, d):
    models, audits, *_ = frames(spark, d)
    return G.timeline(run(spark, d)["monitored"], audits).select("model_id", "position", "kind", "status")


# ---------------------------------------------------------------- SQL twins
_REG = "problem_type = 'regression'"
_VAL = f"CASE WHEN {_REG} THEN metric_r2 WHEN metric_f1_weighted IS NOT NULL THEN metric_f1_weighted WHEN metric_balanced_accuracy IS NOT NULL THEN metric_balanced_accuracy ELSE metric_accuracy END"
_BASE = f"CASE WHEN {_REG} THEN baseline_r2 WHEN metric_f1_weighted IS NOT NULL THEN baseline_f1_weighted WHEN metric_balanced_accuracy IS NOT NULL THEN baseline_balanced_accuracy WHEN metric_accuracy IS NOT NULL THEN baseline_accuracy END"
# points and statuses as one code: points * 10 + (0 good, 1 info, 2 warning, 3 risk)
_CODES = [
    f"CASE WHEN rank_score IS NULL THEN 183 WHEN rank_score >= (CASE WHEN {_REG} THEN 0.65 ELSE 0.85 END) THEN 0 WHEN rank_score >= (CASE WHEN {_REG} THEN 0.35 ELSE 0.7 END) THEN 82 ELSE 223 END",
    f"CASE WHEN v - b IS NULL THEN 41 WHEN {_REG} THEN CASE WHEN v >= 0.35 AND v - b >= CAST(0.15 AS DOUBLE) THEN 0 WHEN v >= 0.15 AND v - b > 0 THEN 82 ELSE 183 END "
    "WHEN v - b >= CAST(0.12 AS DOUBLE) THEN 0 WHEN v - b >= CAST(0.04 AS DOUBLE) THEN 82 ELSE 183 END",
    "CASE WHEN coalesce(leakage_features, 0) = 0 THEN 0 WHEN leakage_features <= 2 THEN 82 ELSE 163 END",
    "CASE WHEN problem_type <> 'classification' THEN 1 WHEN class_severity IS NULL THEN 41 WHEN class_severity = 'balanced' THEN 0 WHEN class_severity = 'mild' THEN 42 WHEN class_severity = 'moderate' THEN 92 ELSE 153 END",
    "CASE WHEN problem_type <> 'classification' THEN 1 WHEN recommended_threshold IS NOT NULL THEN 0 WHEN has_class_metrics THEN 62 ELSE 82 END",
    "CASE WHEN model_features < 3 THEN 123 WHEN dropped_features >= 5 THEN 62 WHEN raw_features > 0 AND model_features > 0 AND model_features < raw_features * 0.5 THEN 52 ELSE 0 END",
    "CASE WHEN candidate_models > 0 AND failed_models / CAST(candidate_models AS DOUBLE) >= 0.4 THEN 123 WHEN trained_models >= 4 AND has_cv THEN 0 WHEN trained_models >= 4 THEN 52 ELSE 82 END",
    "CASE WHEN drivers > 0 THEN 0 ELSE 62 END",
]
_SUM = " + ".join(f"k{i} // 10" for i in range(8))
_COUNT = lambda digit: " + ".join(f"(k{i} % 10 = {digit})::INT" for i in range(8))
_SAID = ", ".join(f"CASE WHEN k{i} % 10 >= 2 THEN '{G.TRUST_ACTIONS[label]}' END" for i, label in enumerate(G.TRUST_LABELS) if label in G.TRUST_ACTIONS)
_CASE = lambda texts, key: f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in texts.items()) + " END"

TRUST = f"""m AS ({_select(_MODEL_SQL, 'customer')}),
mv AS (SELECT *, {_VAL} AS v, {_BASE} AS b FROM m),
mk AS (SELECT *, {', '.join(f'{c} AS k{i}' for i, c in enumerate(_CODES))} FROM mv),
ms AS (SELECT *, greatest(0, least(100, 100 - ({_SUM})))::INT AS trust_score FROM mk),
trust AS (SELECT *, CASE WHEN trust_score >= 80 THEN 'low' WHEN trust_score >= 60 THEN 'medium' ELSE 'high' END AS risk_level FROM ms)"""

_ACTIONS = f"""array_to_string(list_slice((SELECT list(a ORDER BY i) FROM (SELECT a, min(i) AS i FROM (
  SELECT unnest(list_concat([{_CASE(G.RISK_ACTIONS, 'risk_level')}], [{_SAID}], ['Check ' || model_name])) AS a, generate_subscripts(list_concat([''], [{_SAID}], ['']), 1) AS i)
  WHERE a IS NOT NULL GROUP BY a)), 1, 6), '|')"""

oracle("trust_scores_customer", f"""WITH {TRUST}
SELECT model_id, trust_score, risk_level, {_CASE(G.TRUST_DECISIONS, 'risk_level')} AS trust_decision, ({_COUNT(3)}) AS trust_blockers, ({_COUNT(2)}) AS trust_warnings,
{', '.join(f'(k{i} // 10)::INT AS points_{i}' for i in range(8))}, {_ACTIONS} AS actions FROM trust""")

_PASS = lambda condition, other: f"CASE WHEN {condition} THEN 'pass' ELSE '{other}' END"
_CHECKS = {
    "trust": "CASE WHEN trust_score >= 80 THEN 'pass' WHEN trust_score >= 60 THEN 'warning' ELSE 'blocked' END",
    "artifact": _PASS("has_artifact", "blocked"), "api": _PASS("has_api", "blocked"), "audit": _PASS("audits > 0", "warning"),
    "confidence": _PASS("problem_type <> 'classification' OR (average_confidence >= 0.75 AND low_rows = 0)", "warning"),
    "batch": _PASS("has_batch", "warning"), "explainability": _PASS("drivers > 0", "warning"), "report": "'pass'",
    "drift": "CASE WHEN drift_status IS NULL THEN 'pending' WHEN drift_status = 'low' THEN 'pass' WHEN drift_status = 'medium' THEN 'warning' ELSE 'blocked' END",
}
_EARNED = " + ".join(f"{w} * CASE check_{k} WHEN 'pass' THEN 1.0::DOUBLE WHEN 'blocked' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END" for k, w in G.WEIGHTS.items())
_N = lambda status: " + ".join(f"(check_{k} = '{status}')::INT" for k in G.WEIGHTS)
_STATUS = lambda score, blocked="false": f"CASE WHEN {blocked} OR {score} < 55 THEN 'critical' WHEN {score} < 70 THEN 'review' WHEN {score} < 85 THEN 'watch' ELSE 'healthy' END"

MONITORED = f"""{TRUST},
a AS (SELECT model_id, count(*) AS audits, sum(low_confidence_rows) AS low_rows, round(avg(average_confidence), 4) AS average_confidence, bool_or(request_type = 'batch') AS has_batch
  FROM ({_select(_AUDIT_SQL, 'events')}) GROUP BY model_id),
dr AS (SELECT model_id, arg_max(status, (created_at, report_id)) AS drift_status, arg_max(score, (created_at, report_id)) AS drift_raw, max(created_at) AS drift_at
  FROM ({_select(_DRIFT_SQL, 'orders')}) GROUP BY model_id),
f AS (SELECT t.*, coalesce(a.audits, 0) AS audits, coalesce(a.low_rows, 0) AS low_rows, a.average_confidence, coalesce(a.has_batch, false) AS has_batch, dr.drift_status, dr.drift_raw, dr.drift_at
  FROM trust t LEFT JOIN a USING (model_id) LEFT JOIN dr USING (model_id)),
c AS (SELECT *, {', '.join(f'{sql} AS check_{k}' for k, sql in _CHECKS.items())} FROM f),
r AS (SELECT *, round_even(({_EARNED}) / 100 * 100, 0)::INT AS readiness_score, ({_N('blocked')}) AS blockers, ({_N('warning')}) AS warnings, ({_N('pending')}) AS pending FROM c),
rs AS (SELECT *, CASE WHEN blockers > 0 THEN 'blocked' WHEN readiness_score >= 85 AND warnings = 0 AND pending <= 1 THEN 'ready' ELSE 'review' END AS readiness_status,
  (CASE WHEN problem_type <> 'classification' THEN 82 WHEN average_confidence IS NULL THEN 45 ELSE greatest(0, round_even(average_confidence * 100, 0) - least(30, low_rows * 5)) END)::INT AS confidence_score,
  (CASE WHEN drift_status IS NULL THEN 50 ELSE round_even(drift_raw, 0) END)::INT AS drift_score,
  least(100, audits * 25 + CASE WHEN has_batch THEN 25 ELSE 0 END)::INT AS audit_score FROM r),
sc AS (SELECT *, round_even(readiness_score * 0.34::DOUBLE + trust_score * 0.22::DOUBLE + drift_score * 0.2::DOUBLE + confidence_score * 0.12::DOUBLE + audit_score * 0.12::DOUBLE, 0)::INT AS score,
  coalesce(drift_status IN ('high', 'blocked'), false) AS bad_drift,
  {_STATUS('readiness_score', "readiness_status = 'blocked'")} AS readiness_card,
  CASE WHEN drift_status IS NULL THEN 'review' WHEN drift_status = 'low' THEN 'healthy' WHEN drift_status = 'medium' THEN 'watch' ELSE 'critical' END AS drift_card,
  CASE WHEN problem_type <> 'classification' THEN 'healthy' WHEN average_confidence IS NULL THEN 'review' ELSE {_STATUS('confidence_score')} END AS confidence_card,
  {_STATUS('(CASE WHEN audits > 0 THEN audit_score ELSE 45 END)')} AS audit_card FROM rs),
mo AS (SELECT *, {_STATUS('score', "(readiness_status = 'blocked' OR bad_drift)")} AS status,
  CASE WHEN readiness_status = 'blocked' THEN 'blocked' WHEN bad_drift THEN 'drifted' WHEN problem_type = 'classification' AND (confidence_score < 65 OR low_rows >= 3) THEN 'unsure'
    WHEN drift_status IS NULL THEN 'unchecked' WHEN score >= 85 THEN 'stable' ELSE 'rest' END AS why FROM sc)"""

oracle("readiness_customer", f"""WITH {MONITORED}
SELECT model_id, readiness_score, readiness_status, blockers, warnings, pending, {', '.join(f'check_{k}' for k in G.WEIGHTS)} FROM mo""")

oracle("monitoring_snapshots_customer", f"""WITH {MONITORED}
SELECT model_id, model_name, target_column, problem_type, status, score, readiness_score, trust_score, drift_score, confidence_score, audit_score, blockers, warnings + pending AS warnings,
{_CASE({k: v[0] for k, v in G.RECOMMENDATIONS.items()}, 'why')} AS recommendation_level, {_CASE({k: v[1] for k, v in G.RECOMMENDATIONS.items()}, 'why')} AS recommendation_title FROM mo""")

_RAISED = {
    "monitoring_critical": "status = 'critical'", "monitoring_watch": "status IN ('review', 'watch')", "drift_critical": "drift_card = 'critical'",
    "drift_review": "drift_card IN ('review', 'watch')", "readiness_blocked": "readiness_card = 'critical' OR blockers > 0",
    "confidence_low": "confidence_card IN ('critical', 'review')", "audit_coverage_low": "audit_card IN ('critical', 'review')",
    "champion_available": "ch_status = 'challenger'", "challenger_close": "ch_status = 'challenger' AND ch_delta >= -0.02",
}
oracle("monitoring_alerts_customer", f"WITH {MONITORED}, ch AS (SELECT model_id, status AS ch_status, score_delta AS ch_delta FROM ({_select(_CHAMPION_SQL, 'customer')})), x AS (SELECT * FROM mo LEFT JOIN ch USING (model_id))\n"
       + "\nUNION ALL ".join(f"SELECT model_id, '{k}' AS key, '{G.ALERT_TEXTS[k][0]}' AS level, '{G.ALERT_TEXTS[k][1]}' AS title, '{G.ALERT_TEXTS[k][2]}' AS source FROM x WHERE {sql}" for k, sql in _RAISED.items()))

oracle("model_timeline_customer", f"""WITH {MONITORED},
au AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY created_at DESC, audit_id) AS n FROM ({_select(_AUDIT_SQL, 'events')})) WHERE n <= 8),
e AS (SELECT model_id, 'readiness' AS kind, NULL::TIMESTAMP AS happened, 'critical' AS status, 0 AS o FROM mo WHERE readiness_status = 'blocked'
  UNION ALL SELECT model_id, 'model', created_at, 'healthy', 1 FROM mo
  UNION ALL SELECT model_id, 'drift', drift_at, CASE WHEN drift_status = 'low' THEN 'healthy' WHEN bad_drift THEN 'critical' ELSE 'warning' END, 2 FROM mo WHERE drift_status IS NOT NULL
  UNION ALL SELECT model_id, 'audit', created_at, CASE WHEN low_confidence_rows > 0 THEN 'warning' ELSE 'healthy' END, 3 FROM au WHERE model_id IN (SELECT model_id FROM mo)),
p AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY kind <> 'readiness', happened DESC, o, status) AS position FROM e)
SELECT model_id, position, kind, status FROM p WHERE position <= 10""")


# ---------------------------------------------------------------- exports
@query("leaderboard_export_orders")
def leaderboard_export(spark, d):
    """A model per customer; its orders are the leaderboard, customers without orders get the fallback row."""
    orders = T(spark, d, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.struct(
            F.col("o_orderkey").alias("o"), F.col("o_orderpriority").alias("model_name"), F.col("o_orderstatus").alias("status"), F.lit("fair").alias("quality_label"),
            F.round(F.col("o_totalprice") / 1000, 2).alias("rank_score"), (F.col("o_orderkey") % 2 == 0).alias("cv_available"), F.lit("r2").alias("cv_metric"),
            F.lit(None).cast("double").alias("cv_mean"), F.lit(None).cast("double").alias("cv_std"),
            F.create_map(F.lit("r2"), (F.col("o_orderkey") % 100) / 100).alias("metrics"), F.lit(None).cast("string").alias("tuned_from"), F.lit(None).cast("string").alias("error"),
        ).alias("row"))
    boards = orders.groupBy("c_custkey").agg(
        F.array_sort(F.collect_list("row"), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)).alias("leaderboard"))
    models = T(spark, d, "customer").join(boards, "c_custkey", "left").select(
        F.col("c_custkey").alias("model_id"), F.col("c_name").alias("best_model"), F.lit("good").alias("quality_label"), F.col("c_acctbal").alias("rank_score"),
        F.lit("accuracy").alias("primary_metric"), F.create_map(F.lit("accuracy"), F.col("c_acctbal") / 10000).alias("holdout_metrics"), "leaderboard")
    return X.leaderboard_export(models).select("rank", "model_id", "model_name", "status", "quality_label", "rank_score", "cv_available", "cv_metric", "accuracy", "r2")


oracle("leaderboard_export_orders", """SELECT row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS rank, c_custkey AS model_id,
CASE WHEN o_orderkey IS NULL THEN c_name ELSE o_orderpriority END AS model_name, CASE WHEN o_orderkey IS NULL THEN 'saved' ELSE o_orderstatus END AS status,
CASE WHEN o_orderkey IS NULL THEN 'good' ELSE 'fair' END AS quality_label, CASE WHEN o_orderkey IS NULL THEN c_acctbal ELSE round(o_totalprice / 1000, 2) END AS rank_score,
o_orderkey % 2 = 0 AS cv_available, CASE WHEN o_orderkey IS NULL THEN 'accuracy' ELSE 'r2' END AS cv_metric,
CASE WHEN o_orderkey IS NULL THEN c_acctbal / 10000 END AS accuracy, (o_orderkey % 100) / 100.0::DOUBLE AS r2
FROM customer LEFT JOIN orders ON o_custkey = c_custkey""")


@query("drift_listing_orders")
def drift_listing(spark, d):
    """Every model's newest drift report."""
    return X.drift_listing(frames(spark, d)[2])


oracle("drift_listing_orders", f"""WITH r AS (SELECT * FROM ({_select(_DRIFT_SQL, 'orders')}) x)
SELECT model_id, (SELECT count(*) FROM r) AS total_reports, count(*) AS filtered_reports, arg_max(report_id, (created_at, report_id)) AS latest_report,
arg_max(status, (created_at, report_id)) AS latest_status FROM r GROUP BY model_id""")
