import numpy as np
import pytest

from tabsmith.operators import quality as Q
from tabsmith.operators import quantiles as K
from tabsmith.operators.freq import distinct_counts, frequency_table, unique_counts


def test_brackets_sort_no_column(spark, monkeypatch):
    monkeypatch.setattr(K, "value_counts", None)  # before, every value was counted and ranked
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=5000), rng.integers(0, 3, 5000)
    df = spark.createDataFrame([(float(a), int(b) if b else None, float("nan") if i % 5 else 1.0) for i, (a, b) in enumerate(zip(x, y))], "x double, y int, z double")
    got = {(r.column_name, r.prob): r.value for r in K.exact_quantiles(df, ["x", "y", "z"], [0.0, 0.25, 0.5, 1.0]).collect()}
    for p in (0.0, 0.25, 0.5, 1.0):
        assert got["x", p] == pytest.approx(np.quantile(x, p), abs=1e-12) and got["y", p] == np.quantile(y[y > 0], p) and got["z", p] == 1.0


def test_distinct_counts_without_texts(spark):
    df = spark.createDataFrame([(1, 0.0, "a" * 60, True), (1, -0.0, "a" * 61, None), (2, float("nan"), "b", True), (None, 2.5, None, False)], "i long, d double, s string, b boolean")
    df = df.selectExpr("*", "date_add(DATE'2020-01-01', CAST(i AS INT)) AS day", "CAST(d AS DECIMAL(9, 2)) AS e")
    want = {r.column_name: r.unique_count for r in distinct_counts(frequency_table(df)).collect()}
    assert {r.column_name: r.unique_count for r in unique_counts(df).collect()} == want


def test_outliers_need_eight_values(spark):
    df = spark.createDataFrame([(float(i % 7), float(i % 9) if i else 900.0) for i in range(200)], "few double, many double")
    assert [(r.column_name, r["count"]) for r in Q.outlier_columns(df).collect()] == [("many", 1)]
