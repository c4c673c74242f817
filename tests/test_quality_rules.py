"""Edge frames for the quality rules (id rule at 19/20 rows, constants, IQR = 0,
missing percent, health blockers)."""

from tabsmith.operators.quality import column_flags, outlier_columns, quality_report


def test_id_rule_needs_twenty_rows(spark):
    small = spark.createDataFrame([(i, i % 3) for i in range(19)], "customer_id long, v long")
    big = spark.createDataFrame([(i, i % 3) for i in range(20)], "customer_id long, v long")
    f19 = {r["column_name"]: r["is_id_like"] for r in column_flags(small).collect()}
    f20 = {r["column_name"]: r["is_id_like"] for r in column_flags(big).collect()}
    assert f19["customer_id"] is False and f20["customer_id"] is True


def test_paid_counts_as_id_name(spark):
    df = spark.createDataFrame([(i,) for i in range(25)], "paid long")
    assert column_flags(df).first()["is_id_like"] is True


def test_constant_and_iqr_zero(spark):
    rows = [(1.0, "x") for _ in range(30)] + [(2.0, "x")]
    df = spark.createDataFrame(rows, "v double, c string")
    flags = {r["column_name"]: r["is_constant"] for r in column_flags(df).collect()}
    assert flags == {"v": False, "c": True}
    assert outlier_columns(df).count() == 0  # fewer than 8 distinct values


def test_outliers_and_score(spark):
    rows = [(float(i),) for i in range(1, 41)] + [(1000.0,)]
    df = spark.createDataFrame(rows, "v double")
    o = outlier_columns(df).first()
    assert o["count"] == 1 and o["lower_bound"] == -19.0 and o["upper_bound"] == 61.0
    rep = quality_report(df)
    s = rep.summary.first()
    # one low outlier issue -> 100 - 4
    assert s["score"] == 96 and s["issue_count"] == 1
    h = rep.health.first()
    # a single column cannot hold a feature and a target: one blocker
    assert h["blocker_count"] == 1 and h["can_train"] is False


def test_missing_severity_and_blockers(spark):
    rows = [(None if i < 9 else float(i), "a") for i in range(20)]
    df = spark.createDataFrame(rows, "v double, c string")
    rep = quality_report(df)
    miss = [r for r in rep.issues.collect() if r["type"] == "missing"][0]
    assert miss["metric_count"] == 9 and miss["severity"] == "medium"  # 22.5% of cells
    h = rep.health.first()
    assert h["blocker_count"] >= 1 and h["can_train"] is False  # fewer than 30 rows
