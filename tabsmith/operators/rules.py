"""Rule texts for all models at once: next actions (M23), quality insights (M24), improvement checks.

A rule is a condition over a frame of facts (one row a model) and a text with places for facts; a family of
rules is an ordered list of them and a limit. One projection evaluates a family for every row.

Facts: problem_type, n_rows, best_model, rank_score, second_score, trained, failed, f1_weighted, accuracy,
balanced_accuracy, baseline_f1, r2, rmse, baseline_r2, mape, error_rate, residual_samples, weakest_label, weakest_recall,
confusion_actual, confusion_predicted, top_label, top_share, minority_label, minority_share, severity, and the name
lists leakage, dropped, dates, generated. Unknown facts are null, and no rule that asks for them holds.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    key: str
    when: str
    text: str
    label: str = ""
    status: str = ""
    hint: str = ""


def number(value: Column, digits: int = 4) -> Column:
    """A rounded number as plain text, without needless zeros but with one decimal at least."""
    fixed = F.round(value, digits).cast(f"decimal(38,{digits})").cast("string")
    return F.regexp_replace(fixed, r"(\.\d+?)0+$", "$1")


def names(items: Column) -> Column:
    """The first three of a list; more show as dots."""
    return F.concat(F.array_join(F.slice(items, 1, 3), ", "), F.when(F.size(items) > 3, "...").otherwise(""))


def said(template: str) -> Column:
    """A text; ``{fact}`` is its value, ``{fact:2}`` a number with two digits, ``{fact%}`` per cent with one, ``{fact...}`` a list."""
    parts = []
    for i, part in enumerate(re.split(r"\{([^}]*)\}", template)):
        if i % 2 == 0:
            parts.append(F.lit(part))
        elif part.endswith("..."):
            parts.append(names(F.col(part[:-3])))
        elif part.endswith("%"):
            parts.append(number(F.col(part[:-1]) * 100, 1))
        elif ":" in part:
            parts.append(number(F.col(part.split(":")[0]), int(part.split(":")[1])))
        else:
            parts.append(F.col(part).cast("string"))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def texts(rules: list[Rule], limit: int) -> Column:
    """The texts of the first ``limit`` rules that hold."""
    return F.slice(F.array_compact(F.array(*[F.when(F.expr(r.when), said(r.text)) for r in rules])), 1, limit)


def checks(rules: list[Rule], limit: int, hints: bool = False) -> Column:
    """label, status and detail, with ``hints`` also what to do, of the first ``limit`` rules that hold."""

    def row(r: Rule) -> Column:
        return F.struct(F.lit(r.label).alias("label"), F.lit(r.status).alias("status"), said(r.text).alias("detail"), *([F.lit(r.hint).alias("hint")] if hints else []))

    rows = [F.when(F.expr(r.when), row(r)) for r in rules]
    return F.slice(F.array_compact(F.array(*rows)), 1, limit)


_CLASS, _REG = "problem_type = 'classification'", "problem_type = 'regression'"

# The rules' bounds, order and texts.
NEXT_ACTIONS = [
    Rule("mistakes", f"{_CLASS} AND error_rate > 0.2", "Review the holdout mistakes first; more labeled rows or stronger predictors are needed."),
    Rule("recall", f"{_CLASS} AND weakest_recall < 0.75", "Collect or balance more examples for class '{weakest_label}' to improve recall."),
    Rule("confusion", f"{_CLASS} AND confusion_actual IS NOT NULL", "Add features that separate actual '{confusion_actual}' from predicted '{confusion_predicted}'."),
    Rule("dominant", f"{_CLASS} AND top_share > 0.7", "Try class balancing or threshold tuning because one class dominates the target."),
    Rule("drivers", f"{_REG} AND r2 < 0.5", "Add more business driver columns; the current features explain limited target variance."),
    Rule("errors", f"{_REG} AND mape > 0.2", "Inspect high-error rows and outliers before trusting numeric forecasts."),
    Rule("outliers", f"{_REG} AND residual_samples > 0", "Use the residual outlier table to find rows where the model is over or under predicting."),
    Rule("leakage", "size(leakage) > 0", "Review auto-excluded leakage columns before trusting unusually high accuracy."),
    Rule("dropped", "size(dropped) > 0", "Keep identifier-like columns out of training unless they carry real behavioral signal."),
    Rule("dates", "size(generated) > 0", "Date columns are now split into reusable year/month/day/elapsed features."),
    Rule("close", "abs(rank_score - second_score) <= 0.02", "Top models are very close; retrain after adding rows to confirm the winner."),
]
INSIGHTS = [
    Rule("better", "lift > 0", "Best model improves {metric} by {lift:4} over baseline."),
    Rule("no_better", "lift <= 0", "Best model is not beating the baseline yet; the target may need better predictors."),
    Rule("weak_classes", f"{_CLASS} AND rank_score < 0.7", "Classification quality is still low; add stronger features or more labeled rows."),
    Rule("weak_signal", f"{_REG} AND rank_score < 0.5", "Regression signal is weak; check target noise, outliers, and missing drivers."),
    Rule("dominant", f"{_CLASS} AND top_share > 0.7", "Class balance warning: top class is {top_share%}% of rows."),
    Rule("imbalance", f"{_CLASS} AND severity <> 'balanced'", "Auto accuracy improver trained balanced and oversampled candidates for {severity} class imbalance."),
    Rule("small", "n_rows < 200", "Dataset is small; cross-validation can move a lot with new rows."),
    Rule("leakage", "size(leakage) > 0", "Auto-excluded possible data leakage feature(s): {leakage...}."),
    Rule("dropped", "size(dropped) > 0", "Dropped non-useful feature(s): {dropped...}."),
    Rule("dates", "size(dates) > 0", "Engineered date features from: {dates...}."),
    Rule("failed", "failed > 0", "{failed} candidate model(s) failed and were kept visible in the leaderboard."),
    Rule("winner", "trained > 0 AND best_model IS NOT NULL", "{trained} model(s) trained successfully; top model is {best_model}."),
]
CHECKS = [
    Rule("weak", f"{_CLASS} AND f1_lift <= 0.02", "Best weighted F1 is only {f1_lift:4} above baseline.", "Model signal", "warning"),
    Rule("strong", f"{_CLASS} AND coalesce(f1_lift > 0.02, true)", "Best model beats baseline by {f1_lift_text} weighted F1.", "Model signal", "good"),
    Rule("even", f"{_CLASS} AND severity = 'balanced'", "{balance_text}", "Class balance", "good"),
    Rule("uneven", f"{_CLASS} AND severity <> 'balanced'", "{balance_text}", "Class balance", "warning"),
    Rule("gap", f"{_CLASS} AND accuracy_gap > 0.08", "Accuracy is {accuracy:4}, but balanced accuracy is {balanced_accuracy:4}.", "Accuracy gap", "warning"),
    Rule("no_gap", f"{_CLASS} AND accuracy_gap <= 0.08", "Raw accuracy and balanced accuracy are close.", "Accuracy gap", "good"),
    Rule("recall", f"{_CLASS} AND weakest_recall < 0.7", "Class {weakest_label} recall is {weakest_recall:4}.", "Weakest class recall", "warning"),
    Rule("leakage", f"{_CLASS} AND size(leakage) > 0", "Auto-excluded {n_leakage} possible target-leaking feature(s).", "Leakage guard", "warning"),
    Rule("cleanup", f"{_CLASS} AND size(dropped) > 0", "Removed {n_dropped} noisy/ID-like feature(s) before training.", "Feature cleanup", "good"),
    Rule("near", f"{_REG} AND r2 <= baseline_r2 + 0.05", "Best regression model is close to the simple baseline.", "Model signal", "warning"),
    Rule("above", f"{_REG} AND coalesce(r2 > baseline_r2 + 0.05, true)", "Best model improves over the mean baseline.", "Model signal", "good"),
]
#: What to do about a check that holds.
CHECK_ACTIONS = [
    Rule("weak", f"{_CLASS} AND f1_lift <= 0.02", "Add stronger predictor columns or clean target noise; the model is close to majority-class guessing."),
    Rule("uneven", f"{_CLASS} AND severity <> 'balanced'", "Use the balanced/oversampled models near the top of the leaderboard when minority recall matters."),
    Rule("gap", f"{_CLASS} AND accuracy_gap > 0.08", "Prefer balanced accuracy/F1 over raw accuracy because raw accuracy is inflated by common classes."),
    Rule("recall", f"{_CLASS} AND weakest_recall < 0.7", "Collect more rows or add separation features for class '{weakest_label}'."),
    Rule("leakage", f"{_CLASS} AND size(leakage) > 0", "Keep leakage columns excluded unless they are genuinely available before prediction time."),
    Rule("near", f"{_REG} AND r2 <= baseline_r2 + 0.05", "Add stronger numeric drivers, reduce target noise, or segment the dataset before retraining."),
]
BLOCKED = ("No trained model is available for improvement analysis.", "Fix failed candidate errors, then train again.")
SUMMARY = {
    "classification": "Best classifier is {best_model} with weighted F1 {f1_weighted:4} and accuracy {accuracy:4}.",
    "regression": "Best regressor is {best_model} with R2 {r2:4} and RMSE {rmse:4}.",
}
BALANCE = "Top class {top_label} is {top_share%}%; minority class {minority_label} is {minority_share%}%."


def next_actions(facts: DataFrame) -> DataFrame:
    """Adds ``next_actions``, five at most."""
    return facts.withColumn("next_actions", texts(NEXT_ACTIONS, 5))


def quality_insights(facts: DataFrame) -> DataFrame:
    """Adds ``insights``, five at most."""
    classify = F.col("problem_type") == "classification"
    with_lift = facts.withColumns({
        "metric": F.when(classify, "f1_weighted").otherwise("r2"),
        "lift": F.round(F.col("rank_score") - F.when(classify, F.col("baseline_f1")).otherwise(F.col("baseline_r2")), 4),
    })
    return with_lift.withColumn("insights", texts(INSIGHTS, 5)).drop("metric", "lift")


def improvement_checks(facts: DataFrame) -> DataFrame:
    """Adds ``improvement_status``, ``improvement_summary``, ``improvement_checks`` (six at most) and ``improvement_actions``."""
    own = facts.withColumns({
        "f1_lift": F.round(F.col("f1_weighted") - F.col("baseline_f1"), 4),
        "accuracy_gap": F.round(F.col("accuracy") - F.col("balanced_accuracy"), 4),
        "n_leakage": F.size("leakage"), "n_dropped": F.size("dropped"), "balance_text": said(BALANCE),
    }).withColumn("f1_lift_text", F.coalesce(number(F.col("f1_lift")), F.lit("n/a")))
    trained = F.col("best_model").isNotNull()
    own = own.withColumns({
        "improvement_checks": F.when(trained, checks(CHECKS, 6)).otherwise(F.array()),
        "improvement_actions": F.when(trained, texts(CHECK_ACTIONS, 5)).otherwise(F.array(F.lit(BLOCKED[1]))),
        "improvement_summary": F.when(~trained, BLOCKED[0]).when(F.expr(_CLASS), said(SUMMARY["classification"])).otherwise(said(SUMMARY["regression"])),
    })
    alarms = F.exists("improvement_checks", lambda c: (c.status == "warning") & (c.label != "Leakage guard"))
    fine = F.when(F.expr(_CLASS), (F.col("f1_weighted") >= 0.75) & ~alarms).otherwise(F.col("r2") >= 0.6)
    status = F.when(~trained, "blocked").when(F.coalesce(fine, F.lit(False)), "good").otherwise("needs_attention")
    return own.withColumn("improvement_status", status).drop("f1_lift", "accuracy_gap", "n_leakage", "n_dropped", "balance_text", "f1_lift_text")
