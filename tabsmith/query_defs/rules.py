"""Rule texts (M22-M24) for one model a customer, trial plans (M16) for leaderboards by market segment, with SQL twins."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tabsmith.operators import rules as R
from tabsmith.plans import tuning
from tabsmith.queries import T, query
from tabsmith.sql_registry import oracle

# One model per customer; every fact is arithmetic on its key, the same text in both engines.
_D = "CAST({} AS DOUBLE)".format
_FACTS = {
    "model_id": "c_custkey",
    "problem_type": "CASE WHEN c_custkey % 4 = 0 THEN 'regression' ELSE 'classification' END",
    "best_model": "CASE WHEN c_custkey % 37 <> 0 THEN c_mktsegment END",
    "n_rows": "c_custkey * 3 % 500",
    "rank_score": f"CASE WHEN c_custkey % 37 <> 0 THEN c_custkey * 37 % 101 / {_D(100)} END",
    "second_score": f"CASE WHEN c_custkey % 5 <> 0 THEN c_custkey * 37 % 101 / {_D(100)} - c_custkey % 7 / {_D(100)} END",
    "trained": "c_custkey % 9",
    "failed": "c_custkey % 5 % 3",
    "f1_weighted": f"CASE WHEN c_custkey % 41 <> 0 THEN c_custkey * 43 % 100 / {_D(100)} END",
    "accuracy": f"CASE WHEN c_custkey % 19 <> 0 THEN c_custkey * 3 % 100 / {_D(100)} END",
    "balanced_accuracy": f"c_custkey * 3 % 100 / {_D(100)} - c_custkey % 13 / {_D(100)}",
    "baseline_f1": f"CASE WHEN c_custkey % 43 <> 0 THEN c_custkey * 11 % 90 / {_D(100)} END",
    "r2": f"c_custkey * 41 % 100 / {_D(100)}",
    "rmse": f"c_custkey * 53 % 1000 / {_D(10)}",
    "baseline_r2": f"CASE WHEN c_custkey % 23 <> 0 THEN c_custkey * 7 % 50 / {_D(100)} END",
    "mape": f"CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 40 / {_D(100)} END",
    "error_rate": f"c_custkey * 29 % 60 / {_D(100)}",
    "residual_samples": "c_custkey % 6",
    "weakest_label": "c_mktsegment",
    "weakest_recall": f"CASE WHEN c_custkey % 8 <> 0 THEN c_custkey * 31 % 100 / {_D(100)} END",
    "confusion_actual": "CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END",
    "confusion_predicted": "CASE WHEN c_custkey % 7 <> 0 THEN c_name END",
    "top_label": "c_mktsegment",
    "top_share": f"(50 + c_custkey * 17 % 50) / {_D(100)}",
    "minority_label": "c_name",
    "minority_share": f"(1 + c_custkey * 13 % 49) / {_D(100)}",
    "severity": "CASE c_custkey % 6 WHEN 0 THEN 'balanced' WHEN 1 THEN 'mild' WHEN 2 THEN 'moderate' WHEN 3 THEN 'severe' WHEN 4 THEN 'balanced' END",
}
_LISTS = {"leakage": (2, ["copy", "shadow", "proxy", "late", "sum"]), "dropped": (3, ["id", "uuid", "const", "empty", "row"]), "dates": (5, ["opened", "closed", "paid", "sent"]), "generated": (5, ["opened_year"])}
_SIZE = "greatest(0, c_custkey * 7 % 9 - {})".format


def facts(spark, d):
    known = [F.expr(sql).alias(name) for name, sql in _FACTS.items()]
    lists = [F.slice(F.array(*map(F.lit, items)), F.lit(1), F.expr(_SIZE(less)).cast("int")).alias(name) for name, (less, items) in _LISTS.items()]
    return T(spark, d, "customer").select(*known, *lists)


_FACTS_SQL = "SELECT " + ", ".join([f"{sql} AS {name}" for name, sql in _FACTS.items()] + [f"[{', '.join(map(repr, items))}][1 : {_SIZE(less)}] AS {name}" for name, (less, items) in _LISTS.items()]) + " FROM customer"
_NUM = lambda x, n=4: f"regexp_replace(CAST(round({x}, {n}) AS DECIMAL(38, {n}))::VARCHAR, '(\\.\\d+?)0+$', '\\1')"
_SOME = lambda c: f"array_to_string({c}[1 : 3], ', ') || CASE WHEN len({c}) > 3 THEN '...' ELSE '' END"
_FIRST = lambda cases, n: f"array_to_string([x FOR x IN [{', '.join(f'CASE WHEN {c} THEN {t} END' for c, t in cases)}] IF x IS NOT NULL][1 : {n}], '|')"


@query("next_actions_customer")
def next_actions(spark, d):
    return R.next_actions(facts(spark, d)).select("model_id", F.array_join("next_actions", "|").alias("actions"))


_CL, _RG = "problem_type = 'classification'", "problem_type = 'regression'"
oracle("next_actions_customer", "SELECT model_id, " + _FIRST([
    (f"{_CL} AND error_rate > 0.2", "'Review the holdout mistakes first; more labeled rows or stronger predictors are needed.'"),
    (f"{_CL} AND weakest_recall < 0.75", "'Collect or balance more examples for class ''' || weakest_label || ''' to improve recall.'"),
    (f"{_CL} AND confusion_actual IS NOT NULL", "'Add features that separate actual ''' || confusion_actual || ''' from predicted ''' || confusion_predicted || '''.'"),
    (f"{_CL} AND top_share > 0.7", "'Try class balancing or threshold tuning because one class dominates the target.'"),
    (f"{_RG} AND r2 < 0.5", "'Add more business driver columns; the current features explain limited target variance.'"),
    (f"{_RG} AND mape > 0.2", "'Inspect high-error rows and outliers before trusting numeric forecasts.'"),
    (f"{_RG} AND residual_samples > 0", "'Use the residual outlier table to find rows where the model is over or under predicting.'"),
    ("len(leakage) > 0", "'Review auto-excluded leakage columns before trusting unusually high accuracy.'"),
    ("len(dropped) > 0", "'Keep identifier-like columns out of training unless they carry real behavioral signal.'"),
    ("len(generated) > 0", "'Date columns are now split into reusable year/month/day/elapsed features.'"),
    ("abs(rank_score - second_score) <= 0.02", "'Top models are very close; retrain after adding rows to confirm the winner.'"),
], 5) + f" AS actions FROM ({_FACTS_SQL}) f")


@query("quality_insights_customer")
def quality_insights(spark, d):
    return R.quality_insights(facts(spark, d)).select("model_id", F.array_join("insights", "|").alias("insights"))


_LIFT = "round(rank_score - (CASE WHEN problem_type = 'classification' THEN baseline_f1 ELSE baseline_r2 END), 4)"
oracle("quality_insights_customer", "SELECT model_id, " + _FIRST([
    (f"{_LIFT} > 0", f"'Best model improves ' || CASE WHEN {_CL} THEN 'f1_weighted' ELSE 'r2' END || ' by ' || {_NUM(_LIFT)} || ' over baseline.'"),
    (f"{_LIFT} <= 0", "'Best model is not beating the baseline yet; the target may need better predictors.'"),
    (f"{_CL} AND rank_score < 0.7", "'Classification quality is still low; add stronger features or more labeled rows.'"),
    (f"{_RG} AND rank_score < 0.5", "'Regression signal is weak; check target noise, outliers, and missing drivers.'"),
    (f"{_CL} AND top_share > 0.7", f"'Class balance warning: top class is ' || {_NUM('top_share * 100', 1)} || '% of rows.'"),
    (f"{_CL} AND severity <> 'balanced'", "'Auto accuracy improver trained balanced and oversampled candidates for ' || severity || ' class imbalance.'"),
    ("n_rows < 200", "'Dataset is small; cross-validation can move a lot with new rows.'"),
    ("len(leakage) > 0", f"'Auto-excluded possible data leakage feature(s): ' || {_SOME('leakage')} || '.'"),
    ("len(dropped) > 0", f"'Dropped non-useful feature(s): ' || {_SOME('dropped')} || '.'"),
    ("len(dates) > 0", f"'Engineered date features from: ' || {_SOME('dates')} || '.'"),
    ("failed > 0", "failed || ' candidate model(s) failed and were kept visible in the leaderboard.'"),
    ("trained > 0 AND best_model IS NOT NULL", "trained || ' model(s) trained successfully; top model is ' || best_model || '.'"),
], 5) + f" AS insights FROM ({_FACTS_SQL}) f")


@query("improvement_checks_customer")
def improvement_checks(spark, d):
    out = R.improvement_checks(facts(spark, d))
    rows = F.transform("improvement_checks", lambda c: F.concat_ws(":", c.label, c.status, c.detail))
    return out.select("model_id", "improvement_status", "improvement_summary", F.array_join(rows, "|").alias("checks"), F.array_join("improvement_actions", "|").alias("actions"))


_UP, _GAP = "round(f1_weighted - baseline_f1, 4)", "round(accuracy - balanced_accuracy, 4)"
_WEAK, _UNEVEN, _WIDE, _RECALL = f"{_CL} AND {_UP} <= 0.02", f"{_CL} AND severity <> 'balanced'", f"{_CL} AND {_GAP} > 0.08", f"{_CL} AND weakest_recall < 0.7"
_NEAR = f"{_RG} AND r2 <= baseline_r2 + 0.05"
_SHARES = f"'Top class ' || top_label || ' is ' || {_NUM('top_share * 100', 1)} || '%; minority class ' || minority_label || ' is ' || {_NUM('minority_share * 100', 1)} || '%.'"
_CHECKS = [
    (_WEAK, f"'Model signal:warning:Best weighted F1 is only ' || {_NUM(_UP)} || ' above baseline.'"),
    (f"{_CL} AND ({_UP} > 0.02 OR {_UP} IS NULL)", f"'Model signal:good:Best model beats baseline by ' || coalesce({_NUM(_UP)}, 'n/a') || ' weighted F1.'"),
    (f"{_CL} AND severity IS NOT NULL", f"'Class balance:' || CASE WHEN severity = 'balanced' THEN 'good' ELSE 'warning' END || ':' || {_SHARES}"),
    (_WIDE, f"'Accuracy gap:warning:Accuracy is ' || {_NUM('accuracy')} || ', but balanced accuracy is ' || {_NUM('balanced_accuracy')} || '.'"),
    (f"{_CL} AND {_GAP} <= 0.08", "'Accuracy gap:good:Raw accuracy and balanced accuracy are close.'"),
    (_RECALL, f"'Weakest class recall:warning:Class ' || weakest_label || ' recall is ' || {_NUM('weakest_recall')} || '.'"),
    (f"{_CL} AND len(leakage) > 0", "'Leakage guard:warning:Auto-excluded ' || len(leakage) || ' possible target-leaking feature(s).'"),
    (f"{_CL} AND len(dropped) > 0", "'Feature cleanup:good:Removed ' || len(dropped) || ' noisy/ID-like feature(s) before training.'"),
    (_NEAR, "'Model signal:warning:Best regression model is close to the simple baseline.'"),
    (f"{_RG} AND (r2 > baseline_r2 + 0.05 OR baseline_r2 IS NULL)", "'Model signal:good:Best model improves over the mean baseline.'"),
]
_TODO = [
    (_WEAK, "'Add stronger predictor columns or clean target noise; the model is close to majority-class guessing.'"),
    (_UNEVEN, "'Use the balanced/oversampled models near the top of the leaderboard when minority recall matters.'"),
    (_WIDE, "'Prefer balanced accuracy/F1 over raw accuracy because raw accuracy is inflated by common classes.'"),
    (_RECALL, "'Collect more rows or add separation features for class ''' || weakest_label || '''.'"),
    (f"{_CL} AND len(leakage) > 0", "'Keep leakage columns excluded unless they are genuinely available before prediction time.'"),
    (_NEAR, "'Add stronger numeric drivers, reduce target noise, or segment the dataset before retraining.'"),
]
oracle("improvement_checks_customer", f"""SELECT model_id,
  CASE WHEN best_model IS NULL THEN 'blocked' WHEN {_RG} THEN CASE WHEN r2 >= 0.6 THEN 'good' ELSE 'needs_attention' END
       WHEN f1_weighted >= 0.75 AND NOT coalesce({_WEAK}, FALSE) AND NOT coalesce({_UNEVEN}, FALSE) AND NOT coalesce({_WIDE}, FALSE) AND NOT coalesce({_RECALL}, FALSE) THEN 'good' ELSE 'needs_attention' END AS improvement_status,
  CASE WHEN best_model IS NULL THEN 'No trained model is available for improvement analysis.'
       WHEN {_CL} THEN 'Best classifier is ' || best_model || ' with weighted F1 ' || {_NUM('f1_weighted')} || ' and accuracy ' || {_NUM('accuracy')} || '.'
       ELSE 'Best regressor is ' || best_model || ' with R2 ' || {_NUM('r2')} || ' and RMSE ' || {_NUM('rmse')} || '.' END AS improvement_summary,
  CASE WHEN best_model IS NULL THEN '' ELSE {_FIRST(_CHECKS, 6)} END AS checks,
  CASE WHEN best_model IS NULL THEN 'Fix failed candidate errors, then train again.' ELSE {_FIRST(_TODO, 5)} END AS actions
FROM ({_FACTS_SQL}) f""")


# ---------------------------------------------------------------- trial plans
_KINDS = ["Logistic Regression", "Ridge Classifier", "Decision Tree Classifier", "Random Forest Classifier", "AdaBoost Classifier", "Histogram Gradient Boosting Classifier", "Gradient Boosting Classifier"]


@query("tuning_trials_orders")
def tuning_trials(spark, d):
    """The trials of the three best models of each customer's leaderboard: seven candidates, scored by what its orders are worth."""
    orders = T(spark, d, "orders").groupBy("o_custkey").agg(F.sum(F.floor("o_totalprice")).cast("long").alias("v"))
    score = (F.col("v") * (2 * F.col("position") + 3) % 997) / F.lit(1000.0)
    boards = orders.select("o_custkey", "v", F.posexplode(F.array(*map(F.lit, _KINDS))).alias("position", "model"))
    boards = boards.select("o_custkey", "position", "model", F.when((F.col("v") + F.col("position")) % 5 != 0, score).alias("rank_score"))
    return tuning.trial_plan(boards, "classification", ["o_custkey"]).drop("rank_score")


_GRID = {
    "Logistic Regression": [{"C": c} for c in (0.3, 1.0, 3.0)],
    "Decision Tree Classifier": [{"max_depth": a, "min_samples_leaf": b} for a in (None, 5, 10) for b in (1, 3, 5)][:8],
    "Random Forest Classifier": [{"max_depth": a, "min_samples_leaf": b, "n_estimators": c} for a in (None, 10) for b in (1, 3) for c in (180, 260)],
    "AdaBoost Classifier": [{"learning_rate": a, "n_estimators": b} for a in (0.05, 0.15, 0.35) for b in (70, 120, 170)][:8],
    "Histogram Gradient Boosting Classifier": [{"learning_rate": a, "max_iter": b} for a in (0.045, 0.08) for b in (120, 200)],
    "Gradient Boosting Classifier": [{"learning_rate": a, "max_depth": b, "n_estimators": c} for a in (0.035, 0.06) for b in (2, 3) for c in (120, 180)],
}
_GRID_SQL = ", ".join(f"('{m}', {i + 1}, '{json.dumps(t)}')" for m, trials in _GRID.items() for i, t in enumerate(trials))
oracle("tuning_trials_orders", f"""WITH o AS (SELECT o_custkey, CAST(sum(floor(o_totalprice)) AS BIGINT) AS v FROM orders GROUP BY 1),
k(position, model) AS (VALUES {', '.join(f"({i}, '{m}')" for i, m in enumerate(_KINDS))}),
b AS (SELECT o_custkey, position, model, (v * (2 * position + 3) % 997) / 1000.0 AS s FROM o, k WHERE (v + position) % 5 <> 0),
r AS (SELECT o_custkey, model, row_number() OVER (PARTITION BY o_custkey ORDER BY s DESC, position) AS place FROM b),
g(model, trial, parameters) AS (VALUES {_GRID_SQL})
SELECT o_custkey, CAST(place AS INT) AS place, r.model, trial, parameters, CASE WHEN trial IS NULL THEN '{tuning.NO_GRID}' END AS reason
FROM r LEFT JOIN g ON g.model = r.model WHERE place <= 3""")
