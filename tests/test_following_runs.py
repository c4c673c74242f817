import datetime
import random

import pytest
from pyspark.sql import functions as F

from tabsmith.plans import retrain as R
from tabsmith.sources import ingest as I
from tabsmith.sources import serving as S


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.random()) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, kind string, x double")
    return df.select("kind", "x", F.when(F.col("x") > 0.6, "yes").otherwise("no").alias("y"))


def test_outcomes():
    assert R.outcome(None, 0.5) == ("baseline_unavailable", None) and R.outcome(0.5, None)[0] == "baseline_unavailable"
    assert R.outcome(0.5, 0.6) == ("improved", 0.1) and R.outcome(0.6, 0.5) == ("needs_review", -0.1)
    assert R.outcome(0.5, 0.501)[0] == "no_change" and R.outcome(0.5, 0.4995)[0] == "no_change" and R.outcome(0.5, 0.5011)[0] == "improved"


def record(run, parent, score, at):
    return (run, parent, "d", "y", "classification", "t", "m", score, "s", None, "", datetime.datetime(2024, 1, at))


def test_only_the_latest_run_has_followers(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert R.latest_run(R.read_runs(spark, path), "d", "y") is None
    R.append_run(spark, path, record("a", None, 0.5, 1))
    R.append_run(spark, path, record("b", "a", 0.6, 2))
    with pytest.raises(R.Conflict):
        R.append_run(spark, path, record("c", "a", 0.7, 3))
    assert R.latest_run(R.read_runs(spark, path), "d", "y")["run_id"] == "b" and R.read_runs(spark, path).count() == 2


def test_booster_and_retrain_from_drift(spark, table, tmp_path):
    path, few = str(tmp_path / "runs"), {"specs": ["Logistic Regression"], "folds": 2}
    first = R.accuracy_booster(table.unionByName(table.limit(5)), "y", "d", path, **few)
    assert first.status == "baseline_unavailable" and "remove_duplicates" in first.record["source"] and first.record["parent_run_id"] is None
    noise = table.withColumn("y", F.when(F.rand(3) > 0.5, "yes").otherwise("no"))
    second = R.retrain_from_drift(noise, ["x", "gone"], "y", "d", "drift-1", path, **few)
    assert second.status == "needs_review" and second.record["parent_run_id"] == first.record["run_id"] and second.training.plan.original_columns == ["x"]
    with pytest.raises(ValueError, match="labelled"):
        R.retrain_from_drift(table.drop("y"), ["x"], "y", "d", "drift-1", path)


def test_ingest_reads_once_and_registers_once(spark, table, tmp_path):
    folder = str(tmp_path / "lake")
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    counted = table.mapInArrow(count, table.schema)
    one = I.ingest(counted, "people", folder)
    assert reads.value == 80 and one.registered and one.data.count() == 80
    assert {r["column_name"] for r in one.profile.collect()} == {"kind", "x", "y"} and one.quality.summary.first()["score"] <= 100
    again = I.ingest(table.repartition(3), "people", folder)
    assert not again.registered and again.dataset_id == one.dataset_id
    other = I.ingest(table.limit(79), "people", folder)
    assert other.registered and I.datasets(spark, folder).count() == 2
    assert I.datasets(spark, folder).where("name = 'people'").select("rows").distinct().count() == 2


def test_sample_file(spark, tmp_path):
    (tmp_path / "churn.csv").write_text("age,churn\n" + "".join(f"{20 + i % 9},{'yes' if i % 3 else 'no'}\n" for i in range(30)))
    got = I.load_sample(spark, str(tmp_path / "churn.csv"), str(tmp_path / "lake"))
    assert got.record["name"] == "churn" and got.record["rows"] == 30 and got.record["suggested_target"] == "churn"


def test_templates_fall_back(spark):
    df = spark.createDataFrame([(1, None, None, "a"), (2, None, None, "b"), (3, None, None, "b"), (4, 7.0, "z", "b")], "k int, x double, t string, c string")
    rows = {r.name: r for r in S.serving_template(df, ["c", "x", "t", "none"], ["k"]).collect()}
    assert [rows[n].example for n in ("c", "x", "t", "none")] == ["a", "7.0", "z", ""] and rows["none"].type == "unknown" and rows["c"].top_values == ["b", "a"]
    one = S.request_template(S.serving_template(df, ["c", "x"], ["k"]), 0.4).first()
    assert one.row == {"c": "a", "x": "7.0"} and one.threshold == 0.4
    empty = S.serving_template(df.limit(0), ["x", "c"], ["k"]).collect()
    assert [r.example for r in empty] == ["", ""]


def test_audit_of_a_batch(spark):
    rows = [(i, "v" * 200 if i == 0 else "w", "yes", 0.5 + i / 100, "low", i < 5) for i in range(40)]
    scored = spark.createDataFrame(rows, "id int, text string, prediction_label string, confidence double, confidence_band string, low_confidence boolean")
    got = S.prediction_audit(scored, ["text"], "id", "a1", {"model_id": "m", "target_column": "y"}).first()
    assert got.row_count == 40 and len(got.input_preview) == 5 and len(got.prediction_details) == 10 and len(got.predictions) == 25
    assert len(got.input_preview[0].text) == 120 and got.input_preview[0].text.endswith("...") and got.model_id == "m" and got.request_type == "batch"
