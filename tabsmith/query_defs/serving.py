"""Serving template (M29), audit previews (X12), exports (S8, S9), completeness (A22) and candidate suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.operators import governance as G
from tabsmith.operators import modelops as MO
from tabsmith.operators.quality import completeness
from tabsmith.operators.ranking import row_number_within
from tabsmith.plans import train as TR
from tabsmith.queries import T, query
from tabsmith.query_defs import governance as GQ
from tabsmith.query_defs.evaluation import labeled_docs
from tabsmith.query_defs.modelops import MODELS_SQL, models_registry
from tabsmith.sources import exports as X
from tabsmith.sources import serving as S
from tabsmith.sql_registry import ORACLES, oracle

# ---------------------------------------------------------------- serving template
_FEATURES = ["l_returnflag", "l_quantity", "l_linestatus", "l_discount", "l_tax", "note", "l_ghost"]


def _lines(spark, d):
    """lineitem with a feature that is null in the first rows, long texts among its values."""
    li = T(spark, d, "lineitem")
    note = F.when(F.col("l_linenumber") > 3, F.concat(F.lit("a note that is longer than forty characters: "), F.col("l_linenumber")))
    return li.withColumn("note", note)


@query("serving_template_lineitem")
def serving_template(spark, d):
    rows = S.serving_template(_lines(spark, d), _FEATURES, ["l_orderkey", "l_linenumber"])
    return rows.withColumn("top_values", F.array_join("top_values", "|"))


def _template_sql() -> str:
    parts = []
    for i, c in enumerate(_FEATURES):
        if c == "l_ghost":
            parts.append(f"SELECT {i + 1} AS position, '{c}' AS name, 'unknown' AS type, NULL AS missing, NULL AS missing_percent, NULL AS \"unique\", NULL AS mean, NULL AS min, NULL AS max, '' AS top_values, '' AS example")
            continue
        number = c in ("l_quantity", "l_discount", "l_tax")
        value = f"round({{}}({c}), 4)" if number else "NULL"
        text = f"CASE WHEN {c} = floor({c}) AND abs({c}) < 1e7 THEN CAST(CAST({c} AS DECIMAL(20,1)) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END" if number else f"CAST({c} AS VARCHAR)"
        parts.append(f"""SELECT {i + 1} AS position, '{c}' AS name, '{'numeric' if number else 'categorical'}' AS type, count(*) - count({c}) AS missing,
  round((count(*) - count({c})) / count(*) * 100, 2) AS missing_percent, count(DISTINCT {c}) AS "unique", {value.format('avg')} AS mean, {value.format('min')} AS min, {value.format('max')} AS max,
  (SELECT string_agg(v, '|' ORDER BY n DESC, v) FROM (SELECT {text} AS v, count(*) AS n FROM l WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 8)) AS top_values,
  coalesce((SELECT {text} FROM f WHERE {c} IS NOT NULL ORDER BY l_orderkey, l_linenumber LIMIT 1), {f"CAST(round(avg({c}), 4) AS VARCHAR)" if number else f"(SELECT {text} AS v FROM l WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1)"}, '') AS example
FROM l""")
    return f"""WITH l AS (SELECT *, CASE WHEN l_linenumber > 3 THEN 'a note that is longer than forty characters: ' || l_linenumber END AS note FROM lineitem),
f AS (SELECT * FROM l ORDER BY l_orderkey, l_linenumber LIMIT 5)
SELECT CAST(position AS BIGINT) AS position, name, type, CAST(missing AS BIGINT) AS missing, CAST(missing_percent AS DOUBLE) AS missing_percent, CAST("unique" AS BIGINT) AS "unique",
  CAST(mean AS DOUBLE) AS mean, CAST(min AS DOUBLE) AS min, CAST(max AS DOUBLE) AS max, top_values, example FROM ({' UNION ALL '.join(parts)}) t"""


oracle("serving_template_lineitem", _template_sql())


# ---------------------------------------------------------------- audit previews
def _calls(spark, d):
    """One call per order: its lines are the rows, a rule the prediction."""
    li = T(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_linestatus")
    rows = row_number_within(li, ["l_orderkey"], [F.asc(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_linestatus")], out="n")
    sure = F.col("l_quantity") / 50
    return rows.select(
        F.col("l_orderkey").alias("audit_id"), (F.col("n") - 1).cast("int").alias("row"), "l_quantity", "l_linestatus", F.repeat(F.col("l_linestatus"), 130).alias("long_text"),
        F.when(F.col("l_quantity") > 25, "yes").otherwise("no").alias("prediction"), sure.alias("confidence"),
        F.when(sure >= 0.75, "high").when(sure >= 0.55, "medium").otherwise("low").alias("confidence_band"), (sure < 0.55).alias("low_confidence"),
    )


@query("audit_previews_lineitem")
def audit_previews(spark, d):
    out = S.audit_previews(_calls(spark, d), ["l_linestatus", "long_text"])
    texts = lambda c, f: F.array_join(F.transform(c, f), "|")
    return out.select(
        "audit_id", texts("input_preview", lambda x: F.concat_ws(":", x.row, x.l_linestatus, x.long_text)).alias("inputs"),
        texts("prediction_details", lambda x: F.concat_ws(":", x.row, x.prediction, x.confidence_band, x.low_confidence.cast("string"))).alias("details"), F.array_join("predictions", "|").alias("predictions"),
    )


oracle("audit_previews_lineitem", """WITH r AS (SELECT l_orderkey AS audit_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_linestatus) - 1 AS n, l_quantity / 50 AS s, l_quantity, l_linestatus, repeat(l_linestatus, 130) AS t FROM lineitem),
p AS (SELECT *, CASE WHEN l_quantity > 25 THEN 'yes' ELSE 'no' END AS prediction, CASE WHEN s >= 0.75 THEN 'high' WHEN s >= 0.55 THEN 'medium' ELSE 'low' END AS band,
  CASE WHEN length(t) > 120 THEN t[1 : 117] || '...' ELSE t END AS cut FROM r)
SELECT audit_id, string_agg(n || ':' || l_linestatus || ':' || cut, '|' ORDER BY n) FILTER (n < 5) AS inputs,
  string_agg(n || ':' || prediction || ':' || band || ':' || (s < 0.55)::VARCHAR, '|' ORDER BY n) FILTER (n < 10) AS details,
  string_agg(prediction, '|' ORDER BY n) FILTER (n < 25) AS predictions FROM p GROUP BY audit_id""")


# ---------------------------------------------------------------- exports
@query("registry_export_customer")
def registry_export(spark, d):
    models = GQ.frames(spark, d)[0].withColumn("target_column", F.col("model_name"))
    scored = models.where(F.col("rank_score").isNotNull())
    first = scored.groupBy(*MO.CHAMPION_KEYS).agg(F.min("model_id").alias("model_id")).withColumn("status", F.lit("active"))
    trusted = G.with_trust(models).withColumnRenamed("model_features", "model_feature_count").withColumn("best_model", F.col("model_name"))
    trusted = trusted.withColumn("next_actions", F.when(F.col("model_id") % 3 != 0, F.col("next_actions")).otherwise(F.array().cast("array<string>")))
    out = X.registry_export(trusted, MO.champion_signals(models, first), first)
    return out.select("model_id", "best_model", "target_column", "rank_score", "candidate_models", "model_feature_count", "trust_score", "risk_level", "trust_decision", "champion_status", "production_status",
                      "production_model_id", "first_recommendation", "quality_label")


oracle("registry_export_customer", f"""WITH m AS (SELECT *, model_name AS t FROM ({GQ._select(GQ._MODEL_SQL, 'customer')}) x),
g AS (SELECT t, problem_type, min(model_id) AS production_model_id, arg_max(model_id, (rank_score, model_id)) AS champion FROM m WHERE rank_score IS NOT NULL GROUP BY 1, 2)
SELECT m.model_id, m.model_name AS best_model, m.t AS target_column, rank_score, candidate_models, model_features AS model_feature_count, s.trust_score, s.risk_level, s.trust_decision,
  CASE WHEN rank_score IS NULL THEN 'unscored' WHEN m.model_id = production_model_id THEN 'production' WHEN m.model_id = champion THEN 'champion' ELSE 'challenger' END AS champion_status,
  CASE WHEN m.model_id = production_model_id THEN 'production' ELSE 'not_production' END AS production_status, production_model_id,
  CASE WHEN m.model_id % 3 <> 0 THEN 'Check ' || m.model_name ELSE '' END AS first_recommendation, CAST(NULL AS VARCHAR) AS quality_label
FROM m JOIN ({ORACLES['trust_scores_customer']}) s ON s.model_id = m.model_id LEFT JOIN g ON g.t = m.t AND g.problem_type = m.problem_type""")


@query("experiment_export_orders")
def experiment_export(spark, d):
    models = models_registry(spark, d).withColumn("best_model", F.concat(F.lit("m"), F.col("model_id") % 5)).withColumn("next_actions", F.when(F.col("model_id") % 2 == 0, F.array(F.lit("review"), F.lit("retrain"))))
    return X.experiment_export(models, MO.experiment_history(models))


_PLACE = "PARTITION BY dataset_id, target_column, problem_type, primary_metric ORDER BY created_at, model_id"
oracle("experiment_export_orders", f"""WITH m AS ({MODELS_SQL}), r AS (SELECT *, lag(rank_score) OVER ({_PLACE}) AS previous_score, row_number() OVER ({_PLACE}) AS run,
  row_number() OVER (PARTITION BY dataset_id, target_column, problem_type, primary_metric ORDER BY created_at DESC, model_id DESC) = 1 AS is_latest,
  row_number() OVER (PARTITION BY dataset_id, target_column, problem_type, primary_metric ORDER BY rank_score DESC NULLS LAST, created_at DESC, model_id DESC) = 1 AND rank_score IS NOT NULL AS is_best_for_group FROM m)
SELECT model_id AS experiment_id, model_id, dataset_id, target_column, problem_type, 'm' || model_id % 5 AS best_model, NULL AS quality_label, primary_metric, rank_score, previous_score,
  round(rank_score - previous_score, 4) AS score_delta, is_latest, is_best_for_group, CAST(run AS BIGINT) AS group_run_number, NULL AS candidate_models, NULL AS trained_models, NULL AS failed_models,
  NULL AS model_feature_count, NULL AS raw_feature_count, CASE WHEN model_id % 2 = 0 THEN 'review' ELSE '' END AS first_recommendation, NULL AS prediction_api, created_at FROM r""")


# ---------------------------------------------------------------- completeness, suggestions
@query("completeness_lineitem_notes")
def completeness_notes(spark, d):
    return completeness(_lines(spark, d).select("l_orderkey", "l_quantity", "note"))


oracle("completeness_lineitem_notes", """SELECT CAST(count(*) * 3 AS BIGINT) AS cells, CAST(count(*) FILTER (l_linenumber <= 3) AS BIGINT) AS missing_cells,
  round(100 - count(*) FILTER (l_linenumber <= 3) / (count(*) * 3) * 100, 2) AS completeness FROM lineitem""")


@query("candidate_suggestions_labeled_docs")
def candidate_suggestions(spark, d):
    """Each candidate beside what a run on the labelled documents would see."""
    specs, summary = TR.suggest_candidates(labeled_docs(spark, d), "quality", "classification")
    return specs.withColumn("_o", F.lit(1)).join(F.broadcast(summary.withColumn("_o", F.lit(1))), "_o").drop("_o")  # one row on the right
