"""Quality-scan queries (A5-A15) and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith import oracles as O
from tabsmith.operators import quality as Q
from tabsmith.queries import T, query
from tabsmith.query_defs.fixtures import lineitem_defects
from tabsmith.sql_registry import oracle

DEFECT_CTES = O.quality_ctes(O.LINEITEM_DEFECTS_SQL, O.LINEITEM_DEFECTS_COLS, "line_id")


@query("quality_issues_lineitem_defects")
def quality_issues(spark, d):
    return Q.quality_report(lineitem_defects(spark, d), order_by="line_id").issues


oracle("quality_issues_lineitem_defects", DEFECT_CTES + O.ISSUES_SELECT)


@query("quality_summary_lineitem_defects")
def quality_summary(spark, d):
    return Q.quality_report(lineitem_defects(spark, d), order_by="line_id").summary


oracle("quality_summary_lineitem_defects", DEFECT_CTES + O.SUMMARY_SELECT)


@query("dataset_health_lineitem_defects")
def dataset_health(spark, d):
    return Q.quality_report(lineitem_defects(spark, d), order_by="line_id").health


oracle("dataset_health_lineitem_defects", DEFECT_CTES + O.HEALTH_SELECT)


@query("health_checks_lineitem_defects")
def health_checks(spark, d):
    out = Q.health_checks(Q.quality_report(lineitem_defects(spark, d), order_by="line_id"))
    rows = F.transform("checks", lambda c: F.concat_ws(":", c.label, c.score, c.status, c.detail))
    return out.select("score", "status", F.array_join(rows, "|").alias("checks"), F.array_join("blockers", "|").alias("blockers"), F.array_join("warnings", "|").alias("warnings"))


_N2 = lambda c: f"regexp_replace(CAST(round({c}, 2) AS DECIMAL(38, 2))::VARCHAR, '(\\.\\d+?)0+$', '\\1')"
_GRADE = lambda c, good, fair: f"{c} || ':' || CASE WHEN {c} >= {good} THEN 'good' WHEN {c} >= {fair} THEN 'warning' ELSE 'risk' END || ':'"
_KIND = "CASE type WHEN 'duplicates' THEN 1 WHEN 'missing' THEN 2 WHEN 'constant' THEN 3 WHEN 'id_like' THEN 4 WHEN 'high_cardinality' THEN 5 ELSE 6 END"
oracle("health_checks_lineitem_defects", DEFECT_CTES + f"""SELECT h.score, h.status,
  'Completeness:' || {_GRADE('completeness_score', 85, 65)} || {_N2('missing_percent')} || '% missing cells.|Duplicates:' || {_GRADE('duplication_score', 90, 70)} || {_N2('duplicate_percent')} || '% duplicate rows.|Structure:'
   || {_GRADE('structure_score', 85, 65)} || rows || ' rows and ' || column_count || ' columns.|Model signal:' || {_GRADE('signal_score', 85, 65)} || high_card_count || ' high-cardinality and ' || outlier_columns || ' outlier column group(s).' AS checks,
  concat_ws('|', CASE WHEN rows < 30 THEN '{Q.FEW_ROWS}' END, CASE WHEN column_count < 2 THEN '{Q.FEW_COLUMNS}' END, (SELECT string_agg(title, '|' ORDER BY {_KIND}) FROM ({O.ISSUES_SELECT}) i WHERE severity = 'high')) AS blockers,
  coalesce((SELECT string_agg(title, '|' ORDER BY {_KIND}) FROM ({O.ISSUES_SELECT}) i WHERE severity = 'medium'), '') AS warnings
FROM ({O.HEALTH_SELECT}) h, (SELECT rows, column_count, missing_percent, duplicate_percent, high_card_count, outlier_columns FROM qfull) q""")


@query("outliers_lineitem_defects")
def outliers(spark, d):
    return Q.outlier_columns(lineitem_defects(spark, d))


oracle("outliers_lineitem_defects", DEFECT_CTES + "SELECT * FROM o")


@query("duplicate_rows_lineitem_defects")
def duplicates(spark, d):
    return Q.duplicate_rows(lineitem_defects(spark, d))


oracle("duplicate_rows_lineitem_defects", DEFECT_CTES + "SELECT CAST(rows AS BIGINT) AS rows, CAST(duplicate_rows AS BIGINT) AS duplicate_rows FROM dup")


@query("column_flags_lineitem_defects")
def column_flags(spark, d):
    f = Q.column_flags(lineitem_defects(spark, d), order_by="line_id")
    return f.select(
        F.col("position").cast("long").alias("position"), "column_name", "missing", "unique_count",
        F.round("unique_ratio", 6).alias("unique_ratio"), "is_constant", "is_id_like", "is_high_cardinality",
    )


oracle(
    "column_flags_lineitem_defects",
    DEFECT_CTES + """SELECT CAST(position AS BIGINT) AS position, column_name, CAST(missing AS BIGINT) AS missing,
  CAST(unique_count AS BIGINT) AS unique_count, round(unique_ratio, 6) AS unique_ratio,
  is_constant, is_id_like, is_high_cardinality FROM f""",
)


@query("quality_summary_documents")
def quality_documents(spark, d):
    return Q.quality_report(T(spark, d, "documents"), order_by="doc_id").summary


oracle("quality_summary_documents", O.quality_ctes("SELECT * FROM documents", O.SCHEMAS["documents"], "doc_id") + O.SUMMARY_SELECT)


@query("quality_issues_customer")
def quality_customer(spark, d):
    return Q.quality_report(T(spark, d, "customer"), order_by="c_custkey").issues


oracle("quality_issues_customer", O.quality_ctes("SELECT * FROM customer", O.SCHEMAS["customer"], "c_custkey") + O.ISSUES_SELECT)
