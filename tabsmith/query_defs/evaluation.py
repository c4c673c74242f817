"""Target-analysis and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.operators import evaluate as E
from tabsmith.queries import T, query
from tabsmith.sql_registry import ORACLES, oracle


def labeled_docs(spark, d):
    """documents joined with labels, plus two leaky columns built from the target."""
    docs = T(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = T(spark, d, "labels")
    j = docs.join(lab, "doc_id")
    return j.select(
        "doc_id", "lang", "source", "n_chars", "toxic", "quality",
        F.when(F.col("quality") == 1, "yes").otherwise("no").alias("quality_copy"),
        (F.col("quality") * 3 + 1).alias("quality_shadow"),
    )


LABELED_SQL = """SELECT d.doc_id, d.lang, d.source, d.n_chars, l.toxic, l.quality,
  CASE WHEN l.quality = 1 THEN 'yes' ELSE 'no' END AS quality_copy, l.quality * 3 + 1 AS quality_shadow
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


def rule_predictions(spark, d):
    """A deterministic scorer over labeled_docs: probability from n_chars."""
    ld = labeled_docs(spark, d)
    p = (F.col("n_chars") % 1000) / 1000.0
    return ld.select(
        "doc_id", F.col("quality").cast("string").alias("actual"), p.alias("probability"),
        F.when(p >= 0.5, "1").otherwise("0").alias("predicted"),
    )


RULE_SQL = f"""SELECT doc_id, CAST(quality AS VARCHAR) AS actual, (n_chars % 1000) / 1000.0 AS probability,
  CASE WHEN (n_chars % 1000) / 1000.0 >= 0.5 THEN '1' ELSE '0' END AS predicted FROM ({LABELED_SQL}) x"""


@query("class_balance_labeled_docs")
def class_balance(spark, d):
    return E.class_balance(labeled_docs(spark, d), "quality")


oracle("class_balance_labeled_docs", f"""WITH c AS (SELECT CAST(quality AS VARCHAR) AS label, count(*) AS cnt FROM ({LABELED_SQL}) x
    WHERE quality IS NOT NULL GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY cnt DESC, label) AS k, count(*) OVER () AS nc, sum(cnt) OVER () AS tot FROM c),
m AS (SELECT (SELECT label FROM o WHERE k = 1) AS maj, (SELECT cnt FROM o WHERE k = 1) AS majc,
             (SELECT label FROM o WHERE k = nc) AS mino, (SELECT cnt FROM o WHERE k = nc) AS minc,
             (SELECT max(nc) FROM o) AS nc, (SELECT max(tot) FROM o) AS tot)
SELECT CASE WHEN majc / tot >= 0.85 OR majc / greatest(minc, 1) >= 8 THEN 'severe'
            WHEN majc / tot >= 0.7 OR majc / greatest(minc, 1) >= 4 THEN 'moderate'
            WHEN majc / tot >= 0.6 OR majc / greatest(minc, 1) >= 2 THEN 'mild' ELSE 'balanced' END AS severity,
  CAST(nc AS BIGINT) AS class_count, maj AS majority_class, mino AS minority_class,
  CAST(majc AS BIGINT) AS majority_count, CAST(minc AS BIGINT) AS minority_count,
  round(majc / tot, 4) AS majority_share, round(minc / tot, 4) AS minority_share,
  round(majc / greatest(minc, 1), 2) AS imbalance_ratio FROM m""")


@query("class_counts_labeled_docs")
def class_counts(spark, d):
    return E.class_counts(labeled_docs(spark, d), "toxic")


oracle("class_counts_labeled_docs", f"""SELECT CAST(toxic AS VARCHAR) AS label, CAST(count(*) AS BIGINT) AS count,
  round(count(*) / sum(count(*)) OVER (), 4) AS share FROM ({LABELED_SQL}) x WHERE toxic IS NOT NULL GROUP BY 1""")


@query("target_summary_lineitem_price")
def target_summary(spark, d):
    return E.target_summary(T(spark, d, "lineitem"), "l_extendedprice")


oracle("target_summary_lineitem_price", """SELECT round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median,
  round(min(l_extendedprice), 4) AS min, round(max(l_extendedprice), 4) AS max, round(stddev_pop(l_extendedprice), 4) AS std
FROM lineitem WHERE l_extendedprice IS NOT NULL""")


PURITY_FEATURES = ["lang", "source", "toxic", "quality_copy"]


@query("category_purity_labeled_docs")
def purity(spark, d):
    return E.category_purity(labeled_docs(spark, d), PURITY_FEATURES, "quality").select(
        "column_name", F.round("purity", 6).alias("purity")
    )


def _purity_sql(features):
    parts = [
        f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, CAST(quality AS VARCHAR) AS y FROM ({LABELED_SQL}) x "
        f"WHERE {c} IS NOT NULL AND quality IS NOT NULL"
        for c in features
    ]
    return f"""WITH l AS ({' UNION ALL '.join(parts)}),
p AS (SELECT column_name, value, y, count(*) AS n FROM l GROUP BY 1, 2, 3),
c AS (SELECT column_name, value, max(n) AS top, sum(n) AS tot FROM p GROUP BY 1, 2)
SELECT column_name, round(CASE WHEN count(*) < 2 THEN 0.0 ELSE sum(top) / sum(tot) END, 6) AS purity FROM c GROUP BY 1"""


oracle("category_purity_labeled_docs", _purity_sql(PURITY_FEATURES))


LEAK_FEATURES = ["lang", "source", "n_chars", "toxic", "quality_copy", "quality_shadow"]


@query("leakage_scan_labeled_docs")
def leakage(spark, d):
    return E.leakage_scan(labeled_docs(spark, d), LEAK_FEATURES, "quality", "classification")


def _leak_sql():
    parts = []
    for c in LEAK_FEATURES:
        name_hit = "TRUE" if ("quality" in c and c != "quality") else "FALSE"
        x = f"TRY_CAST({c} AS DOUBLE)"
        pair = f"{x} IS NOT NULL AND y IS NOT NULL"
        parts.append(f"""SELECT '{c}' AS column_name,
  count(*) FILTER (WHERE {c} IS NOT NULL AND quality IS NOT NULL) AS n,
  avg(CASE WHEN {c} IS NOT NULL AND quality IS NOT NULL THEN (CAST({c} AS VARCHAR) = CAST(quality AS VARCHAR))::DOUBLE END) AS m,
  count(*) FILTER (WHERE {pair}) AS pn,
  count(DISTINCT CASE WHEN {pair} THEN {x} END) AS pd,
  corr(CASE WHEN {pair} THEN {x} END, CASE WHEN {pair} THEN y END) AS r,
  count(DISTINCT {c}) / greatest(count({c}), 1) AS uratio, {name_hit} AS name_hit
FROM (SELECT *, CAST(code AS DOUBLE) AS y FROM ({LABELED_SQL}) b
      LEFT JOIN (SELECT l, row_number() OVER (ORDER BY l) - 1 AS code FROM (SELECT DISTINCT CAST(quality AS VARCHAR) AS l FROM ({LABELED_SQL}) q WHERE quality IS NOT NULL) e) enc
      ON CAST(b.quality AS VARCHAR) = enc.l) z""")
    return f"""WITH per AS ({' UNION ALL '.join(parts)}),
pur AS ({_purity_sql(LEAK_FEATURES)}),
j AS (SELECT per.*, pur.purity FROM per LEFT JOIN pur ON pur.column_name = per.column_name WHERE n >= 10),
f AS (SELECT *, m >= 0.98 AS exact,
        (pn >= 10 AND pd > 1 AND r IS NOT NULL AND NOT isnan(r) AND abs(r) >= 0.98) AS r_ok,
        (uratio < 0.9 AND coalesce(purity, 0.0) >= 0.98) AS pure FROM j)
SELECT column_name, CASE WHEN exact OR r_ok OR pure THEN 'high' ELSE 'medium' END AS severity,
  round(greatest(CASE WHEN exact THEN m ELSE 0.0 END, CASE WHEN name_hit THEN 0.9 ELSE 0.0 END,
                 CASE WHEN r_ok THEN abs(r) ELSE 0.0 END, CASE WHEN pure THEN purity ELSE 0.0 END), 4) AS score,
  concat_ws('; ', CASE WHEN exact THEN 'feature value almost exactly matches the target' END,
            CASE WHEN name_hit THEN 'column name contains the target name' END,
            CASE WHEN r_ok THEN 'correlation with target' END, CASE WHEN pure THEN 'category purity' END) AS reasons
FROM f WHERE exact OR name_hit OR r_ok OR pure"""


oracle("leakage_scan_labeled_docs", _leak_sql())


@query("date_like_orders")
def date_like(spark, d):
    o = T(spark, d, "orders").withColumn("o_day_text", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return E.date_like_columns(o)


oracle("date_like_orders", """SELECT column_name, is_date_like FROM (VALUES
  ('o_orderkey', FALSE), ('o_custkey', FALSE), ('o_orderstatus', FALSE), ('o_totalprice', FALSE), ('o_orderdate', TRUE),
  ('o_orderpriority', FALSE)) v(column_name, is_date_like)
UNION ALL
SELECT 'o_day_text', count(*) > 0 AND avg((try_strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d') IS NOT NULL)::DOUBLE) >= 0.7
  AND count(DISTINCT try_strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d')) >= 3 FROM orders""")


@query("stratified_split_labeled_docs")
def split(spark, d):
    ld = labeled_docs(spark, d)
    s = E.stratified_split(ld, "quality", F.struct((F.col("doc_id") * 7919) % 10007, F.col("doc_id")))
    return s.groupBy("is_test", F.col("quality").cast("string").alias("label")).agg(
        F.count(F.lit(1)).cast("long").alias("rows"), F.sum("n_chars").cast("long").alias("sum_chars")
    )


oracle("stratified_split_labeled_docs", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY (doc_id * 7919) % 10007, doc_id) AS rn,
   count(*) OVER (PARTITION BY quality) AS cn FROM ({LABELED_SQL}) x)
SELECT rn <= ceil(cn * 0.2) AS is_test, CAST(quality AS VARCHAR) AS label, CAST(count(*) AS BIGINT) AS rows,
  CAST(sum(n_chars) AS BIGINT) AS sum_chars FROM r GROUP BY 1, 2""")


@query("classification_metrics_rule")
def cls_metrics(spark, d):
    return E.classification_metrics(rule_predictions(spark, d))


def _report_sql(predictions: str = RULE_SQL):
    return f"""WITH p AS ({predictions}), cm AS (SELECT actual, predicted, count(*) AS n FROM p GROUP BY 1, 2),
lab AS (SELECT actual AS label FROM cm UNION SELECT predicted FROM cm),
r AS (SELECT label,
  coalesce((SELECT sum(n) FROM cm WHERE actual = label), 0) AS support,
  coalesce((SELECT sum(n) FROM cm WHERE predicted = label), 0) AS pred_n,
  coalesce((SELECT sum(n) FROM cm WHERE actual = label AND predicted = label), 0) AS tp FROM lab),
m AS (SELECT label, support, CASE WHEN pred_n > 0 THEN tp / pred_n ELSE 0.0 END AS precision,
          CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM r)
SELECT label, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
  CAST(support AS BIGINT) AS support FROM m"""


oracle("classification_metrics_rule", f"""WITH rep AS ({_report_sql()})
SELECT round(sum(recall * support) / sum(support), 4) AS accuracy, round(avg(CASE WHEN support > 0 THEN recall END), 4) AS balanced_accuracy,
  round(sum(precision * support) / sum(support), 4) AS precision_weighted, round(sum(recall * support) / sum(support), 4) AS recall_weighted,
  round(sum(f1 * support) / sum(support), 4) AS f1_weighted FROM rep""")


@query("class_report_rule")
def cls_report(spark, d):
    r = E.class_report(rule_predictions(spark, d))
    return r.select("label", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"),
                    F.round("f1", 6).alias("f1"), "support")


oracle("class_report_rule", f"SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM ({_report_sql()}) q")


@query("confusion_matrix_rule")
def confusion(spark, d):
    return E.confusion_counts(rule_predictions(spark, d))


oracle("confusion_matrix_rule", f"SELECT actual, predicted, CAST(count(*) AS BIGINT) AS count FROM ({RULE_SQL}) p GROUP BY 1, 2")


@query("threshold_curve_rule")
def thresholds(spark, d):
    return E.threshold_curve(rule_predictions(spark, d), positive="1")


oracle("threshold_curve_rule", f"""WITH t AS (SELECT actual = '1' AS pos, probability AS p, th FROM ({RULE_SQL}) q,
   (SELECT unnest([0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]::DOUBLE[]) AS th) ts),
g AS (SELECT th, count(*) AS n, count(*) FILTER (WHERE p >= th AND pos) AS tp, count(*) FILTER (WHERE p >= th AND NOT pos) AS fp,
  count(*) FILTER (WHERE p < th AND pos) AS fn, count(*) FILTER (WHERE p < th AND NOT pos) AS tn FROM t GROUP BY 1),
m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS rc FROM g)
SELECT th AS threshold, round((tp + tn) / n, 4) AS accuracy, round(pr, 4) AS precision, round(rc, 4) AS recall,
  round(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 4) AS f1,
  CAST(tp + fp AS BIGINT) AS predicted_positive, round((tp + fp) / n, 4) AS predicted_positive_rate FROM m""")


@query("regression_metrics_lineitem_rule")
def reg_metrics(spark, d):
    li = T(spark, d, "lineitem").select(F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 2000.0).alias("predicted"))
    return E.regression_metrics(li)


oracle("regression_metrics_lineitem_rule", """WITH b AS (SELECT l_extendedprice AS a, l_quantity * 2000.0 AS p, l_extendedprice - l_quantity * 2000.0 AS e
   FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL)
SELECT CAST(count(*) AS BIGINT) AS holdout_rows,
  round(CASE WHEN var_pop(a) > 0 THEN 1 - (sum(e * e) / count(*)) / var_pop(a) END, 4) AS r2,
  round(avg(abs(e)), 4) AS mae, round(sqrt(sum(e * e) / count(*)), 4) AS rmse,
  round(avg(CASE WHEN a <> 0 THEN abs(e) / abs(a) END), 4) AS mape, round(avg(e), 4) AS mean_error,
  round(median(e), 4) AS median_error, round(min(e), 4) AS largest_over_prediction, round(max(e), 4) AS largest_under_prediction FROM b""")


@query("top_residuals_lineitem_rule")
def top_resid(spark, d):
    li = T(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("k"), F.col("l_partkey"),
        F.col("l_extendedprice").alias("actual"), (F.col("l_quantity") * 2000.0).alias("predicted"),
    ).withColumn("row_key", F.struct("k", "l_partkey"))
    return E.top_residuals(li, "row_key").select("actual", "predicted", F.round("abs_error", 4).alias("abs_error"))


oracle("top_residuals_lineitem_rule", """SELECT l_extendedprice AS actual, l_quantity * 2000.0 AS predicted,
  round(abs(l_extendedprice - l_quantity * 2000.0), 4) AS abs_error FROM lineitem
ORDER BY abs(l_extendedprice - l_quantity * 2000.0) DESC, l_orderkey * 8 + l_linenumber, l_partkey LIMIT 20""")


@query("baseline_labeled_docs")
def baseline(spark, d):
    ld = labeled_docs(spark, d)
    s = E.stratified_split(ld, "quality", F.struct((F.col("doc_id") * 7919) % 10007, F.col("doc_id"))).cache()
    return E.baseline_classification(s.filter(~F.col("is_test")), s.filter(F.col("is_test")), "quality")


_SPLIT_SQL = f"""SELECT *, row_number() OVER (PARTITION BY quality ORDER BY (doc_id * 7919) % 10007, doc_id) <= ceil(count(*) OVER (PARTITION BY quality) * 0.2) AS is_test FROM ({LABELED_SQL}) x"""
_BASELINE_SQL = f"""SELECT CAST(quality AS VARCHAR) AS actual, (SELECT CAST(quality AS VARCHAR) FROM ({_SPLIT_SQL}) t WHERE NOT is_test GROUP BY quality ORDER BY count(*) DESC, CAST(quality AS VARCHAR) LIMIT 1) AS predicted
FROM ({_SPLIT_SQL}) s WHERE is_test"""
oracle("baseline_labeled_docs", f"""WITH rep AS ({_report_sql(_BASELINE_SQL)})
SELECT round(sum(recall * support) / sum(support), 4) AS accuracy, round(avg(CASE WHEN support > 0 THEN recall END), 4) AS balanced_accuracy,
  round(sum(f1 * support) / sum(support), 4) AS f1_weighted FROM rep""")


@query("baseline_regression_lineitem_price")
def baseline_regression(spark, d):
    """M8 for a number: the training mean predicted for every fifth order."""
    li = T(spark, d, "lineitem")
    test = F.col("l_orderkey") % 5 == 0
    return E.baseline_regression(li.filter(~test), li.filter(test), "l_extendedprice")


oracle("baseline_regression_lineitem_price", """WITH m AS (SELECT avg(l_extendedprice) AS p FROM lineitem WHERE l_orderkey % 5 <> 0),
e AS (SELECT l_extendedprice AS a, p, l_extendedprice - p AS e FROM lineitem, m WHERE l_orderkey % 5 = 0)
SELECT round(1 - (sum(e * e) / count(*)) / var_pop(a), 4) AS r2, round(avg(abs(e)), 4) AS mae, round(sqrt(avg(e * e)), 4) AS rmse FROM e""")


@query("best_threshold_rule")
def best_threshold(spark, d):
    return E.best_threshold(E.threshold_curve(rule_predictions(spark, d), positive="1"))


oracle("best_threshold_rule", f"""WITH c AS ({ORACLES["threshold_curve_rule"]})
SELECT arg_max(threshold, (f1, recall, -threshold)) AS recommended_threshold, max(f1) AS f1, arg_max(recall, (f1, recall, -threshold)) AS recall,
  0.5::DOUBLE AS default_threshold, max(f1) FILTER (WHERE threshold = 0.5) AS default_f1 FROM c""")


@query("diagnostics_rule")
def diagnostics(spark, d):
    return E.diagnostics(rule_predictions(spark, d))


oracle("diagnostics_rule", f"""WITH p AS ({RULE_SQL}), c AS (SELECT actual, predicted, count(*) AS n FROM p WHERE actual <> predicted GROUP BY 1, 2),
r AS (SELECT label, round(recall, 4) AS recall, round(f1, 4) AS f1 FROM ({_report_sql()}) q WHERE support > 0)
SELECT (SELECT count(*) FROM p) AS holdout_rows, coalesce((SELECT sum(n) FROM c), 0)::BIGINT AS errors, round((SELECT sum(n) FROM c) / (SELECT count(*) FROM p), 4) AS error_rate,
  (SELECT arg_min(actual, (-n, actual, predicted)) FROM c) AS confused_actual, (SELECT arg_min(predicted, (-n, actual, predicted)) FROM c) AS confused_predicted,
  (SELECT max(n) FROM c)::DOUBLE AS confused_count, (SELECT arg_min(label, (recall, f1, label)) FROM r) AS weakest_class,
  (SELECT min(recall) FROM r) AS weakest_recall, (SELECT arg_min(f1, (recall, f1, label)) FROM r) AS weakest_f1""")


@query("prediction_distribution_rule")
def prediction_distribution(spark, d):
    return E.prediction_distribution(rule_predictions(spark, d))


oracle("prediction_distribution_rule", f"SELECT predicted AS label, count(*) AS count FROM ({RULE_SQL}) p GROUP BY 1")


@query("mistake_samples_rule")
def mistake_samples(spark, d):
    return E.mistake_samples(rule_predictions(spark, d), ["doc_id"])


oracle("mistake_samples_rule", f"SELECT doc_id, actual, predicted FROM ({RULE_SQL}) p WHERE actual <> predicted ORDER BY doc_id LIMIT 20")


@query("nearest_threshold_rule")
def nearest_threshold(spark, d):
    return E.nearest_threshold(E.threshold_curve(rule_predictions(spark, d), positive="1"), 0.46)


oracle("nearest_threshold_rule", f"""SELECT * FROM ({ORACLES["threshold_curve_rule"]}) c ORDER BY abs(threshold - 0.46), threshold LIMIT 1""")


@query("confidence_summary_rule")
def confidence_summary(spark, d):
    """A33 over the rule's scores: the first rows of low confidence as text."""
    from tabsmith.plans.train import confidence_summary as summary

    p = F.col("probability")
    scored = rule_predictions(spark, d).withColumn("confidence", F.greatest(p, 1 - p))
    return summary(scored, "doc_id").withColumn("low_rows", F.array_join(F.col("low_rows").cast("array<string>"), ","))


oracle("confidence_summary_rule", f"""WITH p AS (SELECT doc_id, greatest(probability, 1 - probability)::DOUBLE AS c FROM ({RULE_SQL}) r),
s AS (SELECT count(*) AS rows, round(avg(c), 4) AS average_confidence, round(min(c), 4) AS minimum_confidence, count(*) FILTER (WHERE c >= 0.75) AS high,
  count(*) FILTER (WHERE c >= 0.55 AND c < 0.75) AS medium, count(*) FILTER (WHERE c < 0.55) AS low FROM p)
SELECT *, CASE WHEN low > 0 THEN 'Review low-confidence rows before using these predictions in production.' WHEN average_confidence < 0.75
  THEN 'Predictions are usable, but review medium-confidence rows for business-critical decisions.' ELSE 'Prediction confidence is strong for this batch.' END AS recommendation,
  (SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM p WHERE c < 0.55 ORDER BY doc_id LIMIT 25)) AS low_rows FROM s""")
