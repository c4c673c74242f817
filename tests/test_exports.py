from tabsmith.sources import exports as X

ITEM = "array<struct<model_name:string,status:string,quality_label:string,rank_score:double,cv_available:boolean,cv_metric:string,cv_mean:double,cv_std:double,metrics:map<string,double>,tuned_from:string,error:string>>"
FEATURE = "array<struct<feature:string,importance:double,impact:string,strength:string,share:double,interpretation:string>>"


def test_leaderboard_fallback_row(spark):
    item = ("A", "trained", "good", 0.9, True, "f1_weighted", 0.9, 0.01, {"accuracy": 0.8}, None, None)
    rows = [("m1", "A", "good", 0.9, "f1", {"accuracy": 0.7}, [item, item]), ("m2", "B", None, 0.5, "f1", {"accuracy": 0.6}, []), ("m3", "C", None, None, None, None, None)]
    df = spark.createDataFrame(rows, f"model_id string, best_model string, quality_label string, rank_score double, primary_metric string, holdout_metrics map<string,double>, leaderboard {ITEM}")
    got = [(r.model_id, r["rank"], r.model_name, r.status, r.accuracy) for r in X.leaderboard_export(df).orderBy("model_id", "rank").collect()]
    assert got == [("m1", 1, "A", "trained", 0.8), ("m1", 2, "A", "trained", 0.8), ("m2", 1, "B", "saved", 0.6), ("m3", 1, "C", "saved", None)]


def test_explainability_falls_back_to_top_features(spark):
    f = ("age", 0.2, "helpful", "High", 0.5, "x")
    rows = [("m1", "A", "y", "shap", "s", [f], [f, f]), ("m2", "A", "y", "", None, [], [f]), ("m3", "A", "y", None, None, None, None)]
    df = spark.createDataFrame(rows, f"model_id string, best_model string, target_column string, method string, summary string, features {FEATURE}, top_features {FEATURE}")
    assert [(r.model_id, r["rank"], r.method) for r in X.explainability_export(df).orderBy("model_id").collect()] == [("m1", 1, "shap"), ("m2", 1, "permutation_importance")]


def test_lookup_and_listing(spark):
    df = spark.createDataFrame([(i, f"2024-01-{i:02d}") for i in range(1, 8)], "id int, created_at string")
    assert X.record_by_id(df, "id", 3).count() == 1 and X.record_by_id(df, "id", 99).count() == 0
    assert [r.id for r in X.listing(df, "created_at", 2).collect()] == [7, 6] and X.listing(df, "created_at", -5).count() == 1
