"""Drift queries (A26-A29, E1-E4, J5) and their oracles: orders split by date
(training period vs scoring period), events split by week."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.operators import drift as DR
from tabsmith.queries import T, query
from tabsmith.sql_registry import oracle

CUT = "1998-01-01"
FEATURES = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]


def _orders_sides(spark, d):
    o = T(spark, d, "orders")
    ref = o.filter(F.col("o_orderdate") < F.lit(CUT).cast("timestamp"))
    cmp_ = o.filter(F.col("o_orderdate") >= F.lit(CUT).cast("timestamp")).withColumn(
        "o_totalprice", F.when(F.col("o_orderkey") % 4 == 0, F.lit(None)).otherwise(F.col("o_totalprice") * 1.3)
    ).withColumn(
        "o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, F.lit("X")).otherwise(F.col("o_orderstatus"))
    )
    return ref, cmp_


REF_SQL = f"SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}'"
CMP_SQL = f"""SELECT o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice * 1.3 END AS o_totalprice,
  o_orderdate, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '{CUT}'"""


def _report(spark, d):
    ref, cmp_ = _orders_sides(spark, d)
    return DR.drift_report(ref, cmp_, FEATURES, target="o_orderpriority")


@query("drift_missing_orders")
def drift_missing(spark, d):
    return _report(spark, d).missing


def _miss_sql(cols, ref=REF_SQL, cmp=CMP_SQL):
    parts = [
        f"""SELECT '{c}' AS column_name, r.m AS rm, c.m AS cm FROM
  (SELECT avg(({c} IS NULL)::DOUBLE) AS m FROM ref) r, (SELECT avg(({c} IS NULL)::DOUBLE) AS m FROM cmp) c"""
        for c in cols
    ]
    return f"""WITH ref AS ({ref}), cmp AS ({cmp}), x AS ({' UNION ALL '.join(parts)})
SELECT column_name, round(rm * 100, 2) AS reference_missing_percent, round(cm * 100, 2) AS comparison_missing_percent,
  round(abs(cm - rm) * 100, 2) AS shift_points,
  CASE WHEN abs(cm - rm) >= 0.25 THEN 'high' WHEN abs(cm - rm) >= 0.1 THEN 'medium' ELSE 'low' END AS severity FROM x"""


oracle("drift_missing_orders", _miss_sql(FEATURES))


@query("drift_numeric_orders")
def drift_numeric(spark, d):
    return _report(spark, d).numeric


def _num_sql(columns, ref=REF_SQL, cmp=CMP_SQL):
    return f"""WITH ref AS ({ref}), cmp AS ({cmp}), x AS (
""" + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, r.mean AS rmean, c.mean AS cmean, r.std AS rstd, r.n AS rn, c.n AS cn FROM
  (SELECT avg(CAST({c} AS DOUBLE)) AS mean, stddev_pop(CAST({c} AS DOUBLE)) AS std, count({c}) AS n FROM ref) r,
  (SELECT avg(CAST({c} AS DOUBLE)) AS mean, count({c}) AS n FROM cmp) c"""
        for c in columns
    ) + """)
SELECT column_name, round(rmean, 4) AS reference_mean, round(cmean, 4) AS comparison_mean, round(rstd, 4) AS reference_std,
  round(abs(cmean - rmean) / greatest(coalesce(rstd, 0.0), abs(rmean) * 0.05, 1e-9), 2) AS mean_shift,
  CASE WHEN abs(cmean - rmean) / greatest(coalesce(rstd, 0.0), abs(rmean) * 0.05, 1e-9) >= 1.5 THEN 'high'
       WHEN abs(cmean - rmean) / greatest(coalesce(rstd, 0.0), abs(rmean) * 0.05, 1e-9) >= 0.75 THEN 'medium' ELSE 'low' END AS severity
FROM x WHERE rn > 0 AND cn > 0"""


NUM_SQL = _num_sql(["o_custkey", "o_totalprice"])
oracle("drift_numeric_orders", NUM_SQL)


@query("drift_category_orders")
def drift_category(spark, d):
    return _report(spark, d).categorical


def _cat_sql(columns, ref=REF_SQL, cmp=CMP_SQL):
    def counts(side, n):
        return " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS {n} FROM {side} WHERE {c} IS NOT NULL GROUP BY 2" for c in columns)

    return f"""WITH ref AS ({ref}), cmp AS ({cmp}), rf AS ({counts('ref', 'rc')}), cf AS ({counts('cmp', 'cc')}),
rs AS (SELECT column_name, value, rc, rc / sum(rc) OVER (PARTITION BY column_name) AS rs FROM rf),
cs AS (SELECT column_name, value, cc, cc / sum(cc) OVER (PARTITION BY column_name) AS cs FROM cf),
j AS (SELECT coalesce(rs.column_name, cs.column_name) AS column_name, rs.rs, cs.cs FROM rs FULL OUTER JOIN cs
      ON rs.column_name = cs.column_name AND rs.value = cs.value),
per AS (SELECT column_name, 0.5 * sum(abs(coalesce(rs, 0.0) - coalesce(cs, 0.0))) AS tv,
          coalesce(sum(CASE WHEN rs IS NULL THEN cs END), 0.0) AS unseen, count(rs) AS rv, count(cs) AS cv FROM j GROUP BY 1),
rt AS (SELECT column_name, value FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY rc DESC, value) AS k FROM rf) WHERE k = 1),
ct AS (SELECT column_name, value FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cc DESC, value) AS k FROM cf) WHERE k = 1)
SELECT per.column_name, round(tv, 3) AS distribution_shift, round(unseen * 100, 2) AS unseen_category_share,
  rt.value AS reference_top, ct.value AS comparison_top,
  CASE WHEN greatest(tv, unseen) >= 0.35 THEN 'high' WHEN greatest(tv, unseen) >= 0.18 THEN 'medium' ELSE 'low' END AS severity,
  unseen >= 0.08 AS unseen_warning
FROM per LEFT JOIN rt ON rt.column_name = per.column_name LEFT JOIN ct ON ct.column_name = per.column_name
WHERE rv > 0 AND cv > 0"""


CAT_SQL = _cat_sql(["o_orderstatus", "o_orderdate"])
oracle("drift_category_orders", CAT_SQL)


@query("drift_summary_orders")
def drift_summary(spark, d):
    return _report(spark, d).summary


def _summary_sql(cmp_sql, miss, num, cat=("o_orderstatus", "o_orderdate"), ref=REF_SQL, values=CMP_SQL, required=FEATURES, target="o_orderpriority"):
    """Columns are counted in the two sides' schemas; ``miss``, ``num`` and ``cat`` are the columns that both sides have."""
    return f"""WITH m AS ({_miss_sql(miss, ref, values)}), n AS ({_num_sql(num, ref, values)}), c AS ({_cat_sql(cat, ref, values)}),
rs AS (SELECT column_name FROM (DESCRIBE {ref})), cs AS (SELECT column_name FROM (DESCRIBE {cmp_sql})),
q AS (SELECT column_name FROM rs WHERE column_name IN ({', '.join(map(repr, required))})),
k AS (SELECT
  (SELECT count(*) FROM q) AS features, (SELECT count(*) FROM q SEMI JOIN cs USING (column_name)) AS compared, (SELECT count(*) FROM q ANTI JOIN cs USING (column_name)) AS gone,
  (SELECT count(*) FROM cs ANTI JOIN q USING (column_name) WHERE column_name <> '{target}') AS extra,
  (SELECT count(*) FROM m WHERE severity = 'high') AS miss_high, (SELECT count(*) FROM m WHERE severity = 'medium') AS miss_medium,
  (SELECT count(*) FROM n WHERE severity = 'high') AS num_high, (SELECT count(*) FROM n WHERE severity = 'medium') AS num_medium,
  (SELECT count(*) FROM c WHERE severity = 'high') AS cat_high, (SELECT count(*) FROM c WHERE severity = 'medium') AS cat_medium,
  (SELECT count(*) FROM c WHERE unseen_warning) AS unseen_warnings,
  (SELECT count(*) FROM ({ref}) r) AS reference_rows, (SELECT count(*) FROM ({cmp_sql}) r) AS comparison_rows),
s AS (SELECT *, comparison_rows < 20 OR (CASE WHEN reference_rows > 0 THEN comparison_rows / reference_rows ELSE 0 END) < 0.2 AS volume_warning FROM k),
t AS (SELECT *, greatest(0, least(100, 100 - (CASE WHEN gone > 0 THEN least(65, 25 + gone * 8) ELSE 0 END + least(10, extra * 2) + least(20, miss_high * 6 + miss_medium * 3)
   + least(25, num_high * 7 + num_medium * 3) + least(25, cat_high * 7 + cat_medium * 3) + (CASE WHEN volume_warning THEN 5 ELSE 0 END)))) AS score FROM s)
SELECT CASE WHEN gone > 0 OR compared = 0 THEN 'blocked' WHEN score >= 80 THEN 'low' WHEN score >= 60 THEN 'medium' ELSE 'high' END AS status, CAST(score AS BIGINT) AS score,
  CAST(features AS BIGINT) AS feature_count, CAST(compared AS BIGINT) AS compared_feature_count, CAST(gone AS BIGINT) AS missing_required_count,
  CAST(extra AS BIGINT) AS extra_column_count, CAST(reference_rows AS BIGINT) AS reference_rows, CAST(comparison_rows AS BIGINT) AS comparison_rows,
  CAST(miss_high AS BIGINT) AS miss_high, CAST(miss_medium AS BIGINT) AS miss_medium, CAST(num_high AS BIGINT) AS num_high,
  CAST(num_medium AS BIGINT) AS num_medium, CAST(cat_high AS BIGINT) AS cat_high, CAST(cat_medium AS BIGINT) AS cat_medium,
  CAST(unseen_warnings AS BIGINT) AS unseen_warnings, volume_warning FROM t"""


oracle("drift_summary_orders", _summary_sql(CMP_SQL, FEATURES, ["o_custkey", "o_totalprice"]))


def _blocked(spark, d):
    """The comparison has lost a required feature."""
    ref, cmp_ = _orders_sides(spark, d)
    return DR.drift_report(ref, cmp_.drop("o_totalprice"), FEATURES, target="o_orderpriority")


BLOCKED_SQL = _summary_sql(f"SELECT * EXCLUDE (o_totalprice) FROM ({CMP_SQL})", ["o_custkey", "o_orderstatus", "o_orderdate"], ["o_custkey"])


@query("drift_blocked_orders")
def drift_blocked(spark, d):
    return _blocked(spark, d).summary


oracle("drift_blocked_orders", BLOCKED_SQL)


@query("drift_advice_orders")
def drift_advice(spark, d):
    """The texts of two reports: one with all features, one that is blocked."""
    both = _report(spark, d).summary.unionByName(_blocked(spark, d).summary)
    out = DR.drift_advice(both, "the new orders")
    rows = F.transform("checks", lambda c: F.concat_ws(":", c.label, c.status, c.detail, c.hint))
    return out.select("status", "message", F.array_join(rows, "|").alias("checks"), F.array_join("actions", "|").alias("actions"))


def _check(label, bad, detail, hint, fine):
    return f"'{label}:' || CASE WHEN {bad} THEN 'warning' ELSE 'pass' END || ':' || {detail} || ':' || CASE WHEN {bad} THEN '{hint}' ELSE '{fine}' END"


_SHIFTS = lambda kind, text: f"{kind}_high || ' high and ' || {kind}_medium || ' medium {text} shift(s) detected.'"
_SHIFTED = lambda kind: f"{kind}_high + {kind}_medium > 0"
_ADVICE = [
    """CASE WHEN missing_required_count > 0 OR compared_feature_count = 0 THEN 'Schema compatibility:blocked:' || missing_required_count || ' required feature column(s) are missing from the comparison dataset.:Align the scoring dataset schema with the trained model features.'
      WHEN extra_column_count > 0 THEN 'Schema compatibility:warning:All model features are present; ' || extra_column_count || ' extra column(s) will be ignored.:Confirm extra columns are not newly required predictors.'
      ELSE 'Schema compatibility:pass:All required model feature columns are present.:Continue with distribution checks.' END""",
    _check("Row volume", "volume_warning", "'Compared ' || comparison_rows || ' row(s) against ' || reference_rows || ' training row(s).'", "Use at least 20 recent rows for a more reliable drift signal.", "Sample size is sufficient for a quick drift screen."),
    _check("Missing values", _SHIFTED("miss"), _SHIFTS("miss", "missing-rate"), "Inspect features with missing-rate changes before deployment.", "Missing-value patterns are stable."),
    _check("Numeric distribution", _SHIFTED("num"), _SHIFTS("num", "numeric mean"), "Retrain or recalibrate if numeric feature drift affects key predictors.", "Numeric feature averages are stable."),
    _check("Category distribution", _SHIFTED("cat"), _SHIFTS("cat", "category"), "Validate category-heavy features against recent outcomes.", "Categorical feature mix is stable."),
    _check("Unseen categories", "unseen_warnings > 0", "unseen_warnings || ' feature(s) contain notable unseen category share.'", "Review unseen values and update preprocessing if needed.", "No notable unseen-category pressure detected."),
]
_TODO = [
    ("missing_required_count > 0", "Add the missing model feature columns before scoring or retrain with the new schema."),
    ("num_high > 0 OR cat_high > 0", "Review the top drifted features and validate accuracy on recent data."),
    ("num_medium > 0 OR cat_medium > 0 OR miss_high > 0 OR miss_medium > 0", "Check whether the comparison dataset represents a new customer or time segment."),
    ("volume_warning", "Run the drift check again with a larger comparison sample."),
]
oracle("drift_advice_orders", f"""WITH s AS (({_summary_sql(CMP_SQL, FEATURES, ["o_custkey", "o_totalprice"])}) UNION ALL ({BLOCKED_SQL})),
a AS (SELECT *, concat_ws('|', {', '.join(f"CASE WHEN {c} THEN '{t}' END" for c, t in _TODO)}) AS todo FROM s)
SELECT status, CASE status WHEN 'low' THEN 'Low drift: the new orders is close to the training data.' WHEN 'medium' THEN 'Medium drift: review feature changes before using the new orders in production.'
    WHEN 'high' THEN 'High drift: retraining or fresh validation is recommended before using the new orders.' ELSE 'Drift check is blocked because required model feature columns are missing.' END AS message,
  {" || '|' || ".join(_ADVICE)} AS checks, CASE WHEN todo = '' THEN 'Keep this comparison as the baseline for recurring drift monitoring.' ELSE todo END AS actions FROM a""")


@query("drift_summary_events_by_week")
def drift_events(spark, d):
    e = T(spark, d, "events")
    ref = e.filter(F.col("ts") < F.lit("2024-01-08").cast("timestamp"))
    cmp_ = e.filter(F.col("ts") >= F.lit("2024-01-08").cast("timestamp"))
    return DR.drift_report(ref, cmp_, ["user_id", "event_type", "value", "props"]).summary


_WEEK1, _WEEK2 = ("SELECT * FROM events WHERE ts " + c for c in ("< TIMESTAMP '2024-01-08'", ">= TIMESTAMP '2024-01-08'"))
oracle("drift_summary_events_by_week", _summary_sql(_WEEK2, ["user_id", "event_type", "value", "props"], ["user_id", "value"], ["event_type", "props"], _WEEK1, _WEEK2, ["user_id", "event_type", "value", "props"], ""))
