from pyspark.sql import functions as F

from tabsmith.sources import serving as S


def test_texts_that_no_preview_shows_do_not_move(spark):
    df = spark.range(0, 40).select((F.col("id") % 2).alias("audit_id"), F.floor(F.col("id") / 2).cast("int").alias("row"), F.lit("x" * 130).alias("text"), F.lit("p").alias("prediction"),
                                   F.lit(0.5).alias("confidence"), F.lit("low").alias("confidence_band"), F.lit(True).alias("low_confidence"))
    out = S.audit_previews(df, ["text"])
    got = out.orderBy("audit_id").collect()
    assert [len(r.input_preview) for r in got] == [5, 5] and all(len(x.text) == 120 for r in got for x in r.input_preview)
    assert [len(r.prediction_details) for r in got] == [10, 10] and [len(r.predictions) for r in got] == [20, 20]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "< 5) THEN" in plan.split("Project")[1]  # the cut is made in the rows' own projection, below the grouping
