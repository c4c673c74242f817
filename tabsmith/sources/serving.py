"""What a caller needs to use a model (M29) and what is kept of its calls.

Samples are the first rows in key order: a top-n per task, then of those; the whole table is never sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.scalar import truncate_text
from tabsmith.operators.freq import frequency_table, with_texts
from tabsmith.operators.profile import column_summary
from tabsmith.operators.ranking import top_k_within
from tabsmith.plans.train import confidence_summary
from tabsmith.session import cut_lineage, settled

# Values listed a feature, sample rows, and rows kept of a call.
TOP_VALUES, SAMPLE_ROWS = 8, 5
PREVIEW_ROWS, DETAIL_ROWS, PREDICTION_ROWS = 5, 10, 25


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def sample_rows(df: DataFrame, features: list[str], order_by: list[str], limit: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows in key order: ``_key`` and the features (absent ones are null)."""
    cells = [(_q(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in features]
    return settled(df.select(F.struct(*[_q(c) for c in order_by]).alias("_key"), *cells).orderBy("_key").limit(limit))


def serving_template(df: DataFrame, features: list[str], order_by: list[str]) -> DataFrame:
    """M29, one row a feature: kind, missing, unique, mean / min / max, the most frequent values and an example: the first
    value among the sample rows, else the mean of numbers (or 0), else the most frequent value, else an empty text."""
    known = [c for c in features if c in df.columns]
    freq = cut_lineage(frequency_table(df, known))
    summary = column_summary(df, known, freq)
    top = with_texts(df, top_k_within(freq, ["column_name"], [F.desc("count"), F.asc("value")], TOP_VALUES, "value", "rank").select("column_name", "rank", "value"), known)
    listed = top.groupBy("column_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda x: x.value).alias("top_values"))  # TOP_VALUES a column
    first = sample_rows(df, known, order_by)
    shown = first.agg(*[F.min_by(_q(c).cast("string"), F.when(_q(c).isNotNull(), F.col("_key"))).alias(c) for c in known])
    shown = shown.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), _q(c).alias("shown")) for c in known])))
    asked = df.sparkSession.createDataFrame([(i + 1, c) for i, c in enumerate(features)], "position int, column_name string")
    rows = asked.join(summary.drop("position"), "column_name", "left").join(listed, "column_name", "left").join(shown, "column_name", "left")
    number = F.col("kind") == "numeric"
    value = lambda c: F.when(number, F.round(c, 4))
    missing = F.col("rows") - F.col("non_null")
    fallback = F.when(number, F.coalesce(F.round("mean", 4).cast("string"), F.lit("0"))).otherwise(F.coalesce(F.try_element_at("top_values", F.lit(1)), F.lit("")))
    return rows.select(
        F.col("position").cast("long").alias("position"), F.col("column_name").alias("name"), F.coalesce("kind", F.lit("unknown")).alias("type"), missing.cast("long").alias("missing"),
        F.round(F.when(F.col("rows") > 0, missing / F.col("rows") * 100).otherwise(F.when(F.col("rows") == 0, 0.0)), 2).alias("missing_percent"), F.col("unique_count").alias("unique"),
        value("mean").alias("mean"), value("min_value").alias("min"), value("max_value").alias("max"),
        F.coalesce("top_values", F.array().cast("array<string>")).alias("top_values"), F.coalesce("shown", fallback).alias("example"),
    ).orderBy("position")


def request_template(fields: DataFrame, threshold: float | None = None) -> DataFrame:
    """One row: the default row (feature -> example) and the recommended threshold, if there is one."""
    pairs = F.sort_array(F.collect_list(F.struct("position", "name", "example")))
    one = fields.agg(pairs.alias("p"))
    return one.select(F.map_from_arrays(F.transform("p", lambda x: x["name"]), F.transform("p", lambda x: x["example"])).alias("row"), F.lit(threshold).cast("double").alias("threshold"))


def audit_previews(calls: DataFrame, inputs: list[str]) -> DataFrame:
    """X12 for all calls at once. ``calls``: audit_id, row (from 0), the input columns, prediction, confidence, confidence_band,
    low_confidence. The first rows' inputs (texts cut to 120 characters), details, and predictions: no group holds
    more than the rows that are kept."""
    row = F.col("row")
    kept = calls.where(row < max(PREVIEW_ROWS, DETAIL_ROWS, PREDICTION_ROWS))
    preview = F.struct(row.alias("row"), *[_q(c) for c in inputs])
    detail = F.struct(row.alias("row"), "prediction", "confidence", "confidence_band", "low_confidence")
    # texts leave the rows that no preview shows before the rows move, and the rest is one array a call
    kept = kept.select("audit_id", "row", *[F.when(row < PREVIEW_ROWS, truncate_text(_q(c))).alias(c) for c in inputs], "prediction", "confidence", "confidence_band", "low_confidence")
    first = lambda x, n: F.sort_array(F.collect_list(F.when(row < n, x)))
    return kept.groupBy("audit_id").agg(
        first(preview, PREVIEW_ROWS).alias("input_preview"), first(detail, DETAIL_ROWS).alias("prediction_details"),
        F.transform(first(F.struct(row.alias("row"), F.col("prediction").alias("p")), PREDICTION_ROWS), lambda x: x.p).alias("predictions"),
    )


def prediction_audit(scored: DataFrame, inputs: list[str], order_by: str, audit_id: str, model: dict, request_type: str = "batch") -> DataFrame:
    """M28 (one row): the model's facts, rows, confidence summary and previews of one scored batch."""
    first = scored.orderBy(order_by).limit(PREDICTION_ROWS)
    numbered = settled(first.select(*[_q(c) for c in inputs], F.col("prediction_label").alias("prediction"), "confidence", "confidence_band", "low_confidence"))
    rows = [(i, *r) for i, r in enumerate(numbered.collect())]  # PREDICTION_ROWS
    calls = scored.sparkSession.createDataFrame(rows, "row int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema.fields)).withColumn("audit_id", F.lit(audit_id))
    facts = confidence_summary(scored).select(F.struct("*").alias("confidence_summary"), F.col("rows").alias("row_count")).withColumn("audit_id", F.lit(audit_id))
    named = facts.select("*", F.lit(request_type).alias("request_type"), *[F.lit(v).alias(k) for k, v in model.items()])
    return named.join(F.broadcast(audit_previews(calls, inputs)), "audit_id", "left")  # one row
