import random

import pytest
from pyspark.sql import functions as F

from tabsmith.operators import dashboard as D
from tabsmith.operators.clean import CleaningOptions
from tabsmith.operators.drift import drift_report, schema_check
from tabsmith.operators.evaluate import date_like_columns
from tabsmith.operators.profile import column_kinds, profile
from tabsmith.operators.quality import duplicate_rows
from tabsmith.plans.features import build_feature_plan
from tabsmith.session import nan_as_null
from tabsmith.sources.io import read_csv


def test_csv_types_hold_for_every_value(spark, tmp_path):
    lines = ["a,b,c,d,e,f"] + [f"{i},{i}.5,{'abc' if i == 1900 else i},True,{'NA' if i % 3 else i},x{i}" for i in range(2000)]
    path = tmp_path / "t.csv"
    path.write_text("\n".join(lines))
    df = read_csv(spark, str(path))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "boolean", "e": "bigint", "f": "string"}
    got = df.agg(F.count("c").alias("c"), F.count("e").alias("e"), F.sum("b").alias("b")).first()
    assert (got.c, got.e, got.b) == (2000, 667, sum(i + 0.5 for i in range(2000)))


def test_csv_without_values(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\nNA,\n,null\n")
    assert read_csv(spark, str(path)).collect() == [(None, None), (None, None)]


def test_nan_is_missing(spark):
    df = nan_as_null(spark.createDataFrame([(float(i) if i % 4 else float("nan"), i) for i in range(40)], "x double, k int"))
    row = profile(df).filter("column_name = 'x'").first()
    assert (row.missing, row.missing_percent, row["mean"]) == (10, 25.0, 20.0)
    report = drift_report(df.filter("x is not null"), df, ["x"])
    assert report.missing.first().comparison_missing_percent == 25.0


def test_iso_timestamps_are_dates(spark):
    df = spark.createDataFrame([(f"2024-01-{d:02d}T10:00:00", "word") for d in range(1, 20)], "t string, w string")
    assert {r.column_name: r.kind for r in column_kinds(df).collect()} == {"t": "date", "w": "categorical"}
    assert {r.column_name: r.is_date_like for r in date_like_columns(df).collect()} == {"t": True, "w": False}


def test_filters_without_kinds(spark):
    df = spark.createDataFrame([("ABCD-12", True, 1), ("2024-01", False, 2)], "code string, flag boolean, n int")
    count = lambda f: D.apply_filters(df, f)[0].count()
    assert count({"code": "ABCD-12"}) == 1 and count({"code": "2024-01"}) == 1
    assert count({"flag": "True"}) == 1 and count({"flag": "no such"}) == 0
    assert count({"n": "2", "code": None, "flag": "", "gone": "x"}) == 1
    assert D.apply_filters(df, {"n": 2, "gone": 1, "flag": "__all__"})[1] == {"n": 2}


def test_empty_dashboards(spark):
    df = spark.createDataFrame([], "x double, y double")
    assert D.histogram(df, "x").collect() == []
    assert {r.label: r.value for r in D.kpis(df, df, ["x"]).collect()}["Missing cells"] == 0.0


def test_histogram_of_few_values(spark):
    df = spark.createDataFrame([(float(i % 3),) for i in range(30)], "x double")
    assert [r["count"] for r in D.histogram(df, "x").orderBy("bin").collect()] == [10, 10, 10]


def test_schema_check(spark):
    a = spark.createDataFrame([], "k int, s string, gone string, y int")
    b = spark.createDataFrame([], "s int, k string, extra int, y int")
    found = schema_check(a, b, ["k", "s", "gone"], "y")
    assert found == {"common": ["k", "s"], "missing": ["gone"], "extra": ["extra"], "numeric": ["k", "s"], "categorical": []}


def test_duplicates_tell_nulls_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None), ("a", None), ("x" * 500, "y"), ("x" * 500, "y")], "p string, q string")
    assert tuple(duplicate_rows(df).first()) == (5, 2)


def test_feature_plan_roles(spark):
    label = random.Random(1).choices((0, 1), k=60)
    rows = [(i, "same", f"2024-01-{i % 5 + 1:02d}", label[i], str(label[i]), float(i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id int, fixed string, day string, goal int, copy string, z double")
    plan = build_feature_plan(df, "goal", ["row_id", "fixed", "day", "copy", "z"], "classification")
    assert {d["name"]: d["kind"] for d in plan.dropped_columns} == {"row_id": "id_like", "fixed": "constant"}
    assert plan.date_columns == ["day"] and plan.date_minimums["day"].startswith("2024-01-01")
    assert [x["column_name"] for x in plan.leakage_columns] == ["copy"]
    assert build_feature_plan(df, "goal", [], "classification").original_columns == []


def test_cleaning_options():
    assert CleaningOptions.of({"cap_outliers": 0, "unknown": True}) == CleaningOptions(cap_outliers=False)
    with pytest.raises(AttributeError):
        CleaningOptions().cap_outliers = False
