from tabsmith.operators import modelops as MO
from tabsmith.operators import rules as R
from tabsmith.operators.drift import schema_check, schema_frame
from tabsmith.operators.freq import frequency_table, with_texts
from tabsmith.sources.io import retained
from pyspark.sql import functions as F

FACTS = ("model_id int, problem_type string, n_rows int, best_model string, rank_score double, second_score double, trained int, failed int, f1_weighted double, accuracy double, balanced_accuracy double, "
         "baseline_f1 double, r2 double, rmse double, baseline_r2 double, mape double, error_rate double, residual_samples int, weakest_label string, weakest_recall double, confusion_actual string, "
         "confusion_predicted string, top_label string, top_share double, minority_label string, minority_share double, severity string, leakage array<string>, dropped array<string>, dates array<string>, generated array<string>")  # fmt: skip


def test_rules_for_good_bad_and_unknown_models(spark):
    good = (1, "classification", 900, "A", 0.9, 0.5, 4, 0, 0.9, 0.91, 0.9, 0.5, None, None, None, None, 0.1, 0, "x", 0.9, None, None, "x", 0.5, "y", 0.5, "balanced", [], [], [], [])
    bad = (2, "classification", 50, "B", 0.6, 0.59, 4, 2, 0.6, 0.8, 0.6, 0.59, None, None, None, None, 0.4, 0, "x", 0.1, "x", "y", "y", 0.9, "x", 0.1, "severe", list("abcd"), ["i"], ["d"], ["d_year"])
    none = (3, "regression", None, None, *[None] * 23, [], [], [], [])
    df = spark.createDataFrame([good, bad, none], FACTS)
    acts = {r.model_id: r.next_actions for r in R.next_actions(df).collect()}
    assert acts[1] == [] and len(acts[2]) == 5 and acts[2][1] == "Collect or balance more examples for class 'x' to improve recall." and acts[3] == []
    said = {r.model_id: r.insights for r in R.quality_insights(df).collect()}
    assert said[1] == ["Best model improves f1_weighted by 0.4 over baseline.", "4 model(s) trained successfully; top model is A."]
    assert said[2][2] == "Class balance warning: top class is 90.0% of rows." and said[3] == []
    got = {r.model_id: r for r in R.improvement_checks(df).collect()}
    assert [got[i].improvement_status for i in (1, 2, 3)] == ["good", "needs_attention", "blocked"] and got[3].improvement_actions == [R.BLOCKED[1]]
    assert len(got[2].improvement_checks) == 6 and got[2].improvement_checks[0].detail == "Best weighted F1 is only 0.01 above baseline."
    assert [c.status for c in got[1].improvement_checks] == ["good"] * 3


def test_schema_frame(spark):
    ref, cmp = spark.createDataFrame([], "a int, b string, c double, y int"), spark.createDataFrame([], "c string, z int, a string, y int, w int")
    assert schema_check(ref, cmp, ["c", "a", "b"], "y") == {"common": ["c", "a"], "missing": ["b"], "extra": ["z", "w"], "numeric": ["c", "a"], "categorical": []}
    assert schema_check(ref, cmp, [], None)["extra"] == ["c", "z", "a", "y", "w"]
    assert schema_frame(ref, cmp, ["b"], "y").count() == 6


def test_promotion_with_null_keys_and_archived_rows(spark):
    keys = "target_column string, problem_type string, primary_metric string, model_id int"
    old = spark.createDataFrame([(None, None, "m", 1, "active"), (None, None, "m", 2, "archived"), ("t", None, "m", 3, "active")], f"{keys}, status string").withColumn("promoted_at", F.lit(None).cast("timestamp")).withColumn("replaced_at", F.lit(None).cast("timestamp"))
    got = {r.model_id: (r.status, r.replaced_at is not None) for r in MO.promote(old, spark.createDataFrame([(None, None, "m", 9)], keys), F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got == {1: ("replaced", True), 2: ("archived", False), 3: ("active", False), 9: ("active", False)}


def test_retention_settles_ties(spark):
    df = spark.createDataFrame([("m", i, "2024-01-01") for i in range(50)], "k string, id int, created_at string")
    assert sorted(r.id for r in retained(df.repartition(7), 3, key="k", id_col="id").collect()) == [47, 48, 49]
    once = sorted(r.id for r in retained(df.repartition(5), 3).collect())
    assert once == sorted(r.id for r in retained(df.repartition(2), 3).collect()) and len(once) == 3


def test_long_texts_travel_as_digests(spark):
    long = "x" * 100
    df = spark.createDataFrame([(long,), (long,), (long + "y",), ("short",), ("\u0001odd",), (None,)], "t string")
    freq = frequency_table(df)
    assert freq.agg(F.max(F.length("value"))).first()[0] < 80 and freq.count() == 4
    got = {r.value: r["count"] for r in with_texts(df, freq, ["t"]).collect()}
    assert got == {long: 2, long + "y": 1, "short": 1, "\u0001odd": 1}
