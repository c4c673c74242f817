"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each builder returns plain ANSI-ish SQL over the pre-registered views. They are
written independently of the Spark code: the same rules, re-stated in SQL.
"""

from __future__ import annotations

# Schemas of the driver tables used by the queries,
# (column, storage) where storage is numeric / temporal / string.
SCHEMAS: dict[str, list[tuple[str, str]]] = {
    "lineitem": [
        ("l_orderkey", "numeric"), ("l_partkey", "numeric"), ("l_suppkey", "numeric"),
        ("l_linenumber", "numeric"), ("l_quantity", "numeric"), ("l_extendedprice", "numeric"),
        ("l_discount", "numeric"), ("l_tax", "numeric"), ("l_returnflag", "string"),
        ("l_linestatus", "string"), ("l_shipdate", "temporal"),
    ],
    "orders": [
        ("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "string"),
        ("o_totalprice", "numeric"), ("o_orderdate", "temporal"), ("o_orderpriority", "string"),
    ],
    "customer": [
        ("c_custkey", "numeric"), ("c_name", "string"), ("c_nationkey", "numeric"),
        ("c_acctbal", "numeric"), ("c_mktsegment", "string"),
    ],
    "part": [
        ("p_partkey", "numeric"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
        ("p_size", "numeric"), ("p_retailprice", "numeric"),
    ],
    "events": [
        ("event_id", "numeric"), ("ts", "temporal"), ("user_id", "numeric"), ("event_type", "string"),
        ("value", "numeric"), ("props", "string"),
    ],
    "documents": [
        ("doc_id", "numeric"), ("text", "string"), ("lang", "string"), ("source", "string"),
        ("n_chars", "numeric"),
    ],
    "supplier": [
        ("s_suppkey", "numeric"), ("s_name", "string"), ("s_nationkey", "numeric"), ("s_acctbal", "numeric"),
    ],
}

# The lenient date formats, strptime spelling.
DATE_FORMATS_SQL = ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y/%m/%d", "%m/%d/%Y")


def date_ok(x: str) -> str:
    return "(" + " OR ".join(f"try_strptime(CAST({x} AS VARCHAR), '{f}') IS NOT NULL" for f in DATE_FORMATS_SQL) + ")"


def text_of(x: str, storage: str) -> str:
    """Canonical text of a value, as the Spark FREQ pass produces it."""
    if storage == "string":
        return x
    if storage == "double":
        return f"CASE WHEN {x} = 0 THEN '0.0' ELSE CAST({x} AS VARCHAR) END"
    return f"CAST({x} AS VARCHAR)"


def column_summary_sql(source: str, cols: list[tuple[str, str]]) -> str:
    """One row per column: position, column_name, storage, rows, non_null, unique_count,
    mean/min/max, avg_length, date_share, kind."""
    parts = []
    for pos, (c, storage) in enumerate(cols):
        num = storage == "numeric"
        txt = storage == "string"
        parts.append(
            f"""SELECT {pos} AS position, '{c}' AS column_name, '{storage}' AS storage,
  count(*) AS rows, count({c}) AS non_null, count(DISTINCT {c}) AS unique_count,
  {f'avg(CAST({c} AS DOUBLE))' if num else 'NULL::DOUBLE'} AS mean,
  {f'min(CAST({c} AS DOUBLE))' if num else 'NULL::DOUBLE'} AS min_value,
  {f'max(CAST({c} AS DOUBLE))' if num else 'NULL::DOUBLE'} AS max_value,
  {f'avg(length({c}))' if txt else 'NULL::DOUBLE'} AS avg_length,
  {f'avg(CASE WHEN {c} IS NULL THEN NULL WHEN {date_ok(c)} THEN 1 ELSE 0 END)' if txt else ('1.0' if storage == 'temporal' else 'NULL::DOUBLE')} AS date_share
FROM {source}"""
        )
    body = "\nUNION ALL\n".join(parts)
    return f"""SELECT *, CASE WHEN non_null = 0 THEN 'empty'
  WHEN storage = 'numeric' THEN 'numeric'
  WHEN storage = 'temporal' THEN 'date'
  WHEN date_share > 0.8 THEN 'date'
  WHEN unique_count / non_null < 0.3 AND unique_count <= 50 THEN 'categorical'
  WHEN avg_length > 35 THEN 'text'
  ELSE 'categorical' END AS kind
FROM ({body}) s"""


def profile_sql(table: str, source: str | None = None, cols: list[tuple[str, str]] | None = None) -> str:
    src = source or table
    cs = cols or SCHEMAS[table]
    return f"""SELECT CAST(position AS BIGINT) AS position, column_name, kind,
  CAST(rows - non_null AS BIGINT) AS missing,
  round(CASE WHEN rows > 0 THEN (rows - non_null) / rows * 100 ELSE 0.0 END, 2) AS missing_percent,
  CAST(unique_count AS BIGINT) AS unique_count,
  CASE WHEN kind = 'numeric' THEN round(mean, 4) END AS mean,
  CASE WHEN kind = 'numeric' THEN round(min_value, 4) END AS min_value,
  CASE WHEN kind = 'numeric' THEN round(max_value, 4) END AS max_value
FROM ({column_summary_sql(src, cs)}) k"""


# ---------------------------------------------------------------- fixtures
LINEITEM_DEFECTS_SQL = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
  l_extendedprice, l_discount,
  CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_tax END AS l_tax,
  l_returnflag, l_linestatus, l_shipdate,
  'R' || CAST(((l_orderkey * 2000 + l_partkey) * 100 + l_suppkey) * 8 + l_linenumber AS VARCHAR) AS ship_ref,
  'web' AS channel,
  ((l_orderkey * 2000 + l_partkey) * 100 + l_suppkey) * 8 + l_linenumber AS line_id
FROM (SELECT *, unnest(generate_series(1, CASE WHEN l_orderkey % 13 = 0 THEN 2 ELSE 1 END)) AS copy_no FROM lineitem) x"""

LINEITEM_DEFECTS_COLS = SCHEMAS["lineitem"] + [("ship_ref", "string"), ("channel", "string"), ("line_id", "numeric")]


def _is_id_name(c: str) -> bool:
    n = c.lower().replace("-", "_").replace(" ", "_")
    return n == "id" or n.endswith("_id") or n.endswith("id")


def quality_ctes(source_sql: str, cols: list[tuple[str, str]], order_by: str, target: str | None = None) -> str:
    """CTEs d (data), s (column summary), f (flags), o (outliers), ov (one-row overview),
    iss (issues), full (overview + issue counts + score)."""
    pdt_parts = []
    for pos, (c, storage) in enumerate(cols):
        if storage == "temporal":
            pdt_parts.append(f"SELECT '{c}' AS column_name, TRUE AS pdt")
        elif storage == "string":
            pdt_parts.append(
                f"""SELECT '{c}' AS column_name,
  (SELECT count({c}) FROM d) >= 8 AND coalesce((SELECT avg(CASE WHEN {date_ok('v')} THEN 1.0 ELSE 0.0 END)
     FROM (SELECT {c} AS v FROM d WHERE {c} IS NOT NULL ORDER BY {order_by}, {c} LIMIT 60) t), 0) >= 0.8 AS pdt"""
            )
    pdt_sql = "\nUNION ALL\n".join(pdt_parts) if pdt_parts else "SELECT NULL::VARCHAR AS column_name, NULL::BOOLEAN AS pdt WHERE FALSE"
    out_parts = []
    for pos, (c, storage) in enumerate(cols):
        if storage != "numeric":
            continue
        x = f"CAST({c} AS DOUBLE)"
        out_parts.append(
            f"""SELECT {pos} AS position, '{c}' AS column_name, q.n, q.distinct_n, q.q1, q.q3,
  (SELECT count(*) FROM d WHERE {x} < q.q1 - 1.5 * (q.q3 - q.q1) OR {x} > q.q3 + 1.5 * (q.q3 - q.q1)) AS cnt
FROM (SELECT count({x}) AS n, count(DISTINCT {x}) AS distinct_n,
             quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM d) q"""
        )
    out_sql = "\nUNION ALL\n".join(out_parts)
    id_names = [c for c, _ in cols if _is_id_name(c)]
    id_list = ", ".join(f"'{c}'" for c in id_names)
    id_expr = (f"(column_name IN ({id_list}) AND rows >= 20 AND unique_count / greatest(non_null, 1) >= 0.9)"
               if id_names else "FALSE")
    tgt = f"'{target}'" if target else "NULL"
    ncols = len(cols)
    return f"""WITH d AS ({source_sql}),
s AS ({column_summary_sql('d', cols)}),
p AS ({pdt_sql}),
f AS (
  SELECT s.*, rows - non_null AS missing, unique_count / greatest(non_null, 1) AS unique_ratio,
    coalesce(column_name = {tgt}, FALSE) AS is_target,
    unique_count <= 1 AS is_constant,
    {id_expr} AS is_id_like,
    storage <> 'numeric' AND NOT coalesce((SELECT pdt FROM p WHERE p.column_name = s.column_name), FALSE)
      AND unique_count > 50 AND unique_count / greatest(non_null, 1) >= 0.6 AS is_high_cardinality
  FROM s),
oq AS ({out_sql}),
o AS (
  SELECT CAST(position AS BIGINT) AS position, column_name, CAST(cnt AS BIGINT) AS count,
    round(cnt / greatest(n, 1) * 100, 2) AS percent,
    round(q1 - 1.5 * (q3 - q1), 4) AS lower_bound, round(q3 + 1.5 * (q3 - q1), 4) AS upper_bound
  FROM oq WHERE distinct_n >= 8 AND q3 - q1 <> 0 AND cnt > 0),
dup AS (SELECT count(*) AS rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d) u) AS duplicate_rows FROM d),
pc AS (
  SELECT coalesce(sum(missing), 0) AS missing_cells,
    count(*) FILTER (WHERE is_constant) AS constant_count,
    count(*) FILTER (WHERE is_id_like) AS id_count,
    count(*) FILTER (WHERE is_high_cardinality AND NOT is_id_like) AS high_card_count,
    coalesce(array_to_string(list(column_name ORDER BY position) FILTER (WHERE is_constant)[1:8], ','), '') AS constant_columns,
    coalesce(array_to_string(list(column_name ORDER BY position) FILTER (WHERE is_id_like)[1:8], ','), '') AS id_columns,
    coalesce(array_to_string(list(column_name ORDER BY missing DESC, position) FILTER (WHERE missing > 0)[1:5], ','), '') AS missing_columns,
    coalesce(array_to_string(list(column_name ORDER BY position) FILTER (WHERE is_high_cardinality AND NOT is_id_like)[1:8], ','), '') AS high_card_columns
  FROM f),
oa AS (
  SELECT count(*) AS outlier_columns, coalesce(sum(count), 0) AS outlier_values,
    coalesce(max(percent), 0.0) AS outlier_max_percent,
    coalesce(array_to_string(list(column_name ORDER BY count DESC, position)[1:5], ','), '') AS outlier_column_names
  FROM o),
ov AS (
  SELECT dup.*, pc.*, oa.*, {ncols} AS column_count,
    duplicate_rows / greatest(rows, 1) * 100 AS duplicate_percent,
    missing_cells / greatest(rows * {ncols}, 1) * 100 AS missing_percent
  FROM dup, pc, oa),
iss AS (
  SELECT 'duplicates' AS type, {sev_sql('duplicate_percent')} AS severity, 'Duplicate rows detected' AS title,
    CAST(duplicate_rows AS BIGINT) AS metric_count, round(duplicate_percent, 2) AS metric_percent, '' AS columns FROM ov WHERE duplicate_rows > 0
  UNION ALL
  SELECT 'missing', {sev_sql('missing_percent')}, 'Missing values found', CAST(missing_cells AS BIGINT), round(missing_percent, 2), missing_columns FROM ov WHERE missing_cells > 0
  UNION ALL
  SELECT 'constant', 'medium', 'Constant columns', CAST(constant_count AS BIGINT), NULL::DOUBLE, constant_columns FROM ov WHERE constant_count > 0
  UNION ALL
  SELECT 'id_like', 'medium', 'ID-like columns', CAST(id_count AS BIGINT), NULL::DOUBLE, id_columns FROM ov WHERE id_count > 0
  UNION ALL
  SELECT 'high_cardinality', 'medium', 'High-cardinality categorical columns', CAST(high_card_count AS BIGINT), NULL::DOUBLE, high_card_columns FROM ov WHERE high_card_count > 0
  UNION ALL
  SELECT 'outliers', {sev_sql('outlier_max_percent')}, 'Numeric outliers', CAST(outlier_values AS BIGINT), NULL::DOUBLE, outlier_column_names FROM ov WHERE outlier_columns > 0),
ic AS (
  SELECT count(*) AS issue_count, count(*) FILTER (WHERE severity = 'high') AS high_issues,
    count(*) FILTER (WHERE severity = 'medium') AS medium_issues, count(*) FILTER (WHERE severity = 'low') AS low_issues FROM iss),
qfull AS (
  SELECT ov.*, ic.*,
    CASE WHEN rows = 0 OR column_count = 0 THEN 0
         ELSE greatest(0, least(100, 100 - (high_issues * 16 + medium_issues * 9 + low_issues * 4))) END AS score
  FROM ov, ic)
"""


def sev_sql(x: str) -> str:
    return f"CASE WHEN {x} >= 30 THEN 'high' WHEN {x} >= 10 THEN 'medium' ELSE 'low' END"


def grade_sql(x: str) -> str:
    return f"CASE WHEN {x} >= 90 THEN 'excellent' WHEN {x} >= 75 THEN 'good' WHEN {x} >= 55 THEN 'needs review' ELSE 'high risk' END"


def bounded_sql(x: str) -> str:
    return f"greatest(0, least(100, CAST(round_even(CAST({x} AS DOUBLE), 0) AS BIGINT)))"


ISSUES_SELECT = """SELECT type, severity, title, metric_count, metric_percent, columns,
  CAST(CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS BIGINT) AS severity_rank FROM iss"""

SUMMARY_SELECT = f"""SELECT CAST(score AS BIGINT) AS score, {grade_sql('score')} AS grade, CAST(issue_count AS BIGINT) AS issue_count,
  CAST(duplicate_rows AS BIGINT) AS duplicate_rows, CAST(missing_cells AS BIGINT) AS missing_cells,
  CAST(outlier_columns AS BIGINT) AS outlier_columns FROM qfull"""

HEALTH_SELECT = f"""SELECT hs AS score, {grade_sql('hs')} AS grade,
  CASE WHEN hs >= 85 THEN 'low' WHEN hs >= 65 THEN 'moderate' ELSE 'high' END AS risk_level,
  CASE WHEN blocker_count > 0 THEN 'Fix blockers before training' WHEN hs >= 85 THEN 'Ready for training'
       WHEN hs >= 65 THEN 'Train with caution' ELSE 'Clean before training' END AS status,
  blocker_count = 0 AS can_train, blocker_count, warning_count,
  completeness_score, duplication_score, structure_score, signal_score
FROM (
  SELECT *, CAST({bounded_sql('score * 0.35 + completeness_score * 0.20 + duplication_score * 0.15 + structure_score * 0.15 + signal_score * 0.15')} AS BIGINT) AS hs
  FROM (
    SELECT *,
      CAST({bounded_sql('100 - least(70.0, missing_percent * 2.0)')} AS BIGINT) AS completeness_score,
      CAST({bounded_sql('100 - least(70.0, duplicate_percent * 2.5)')} AS BIGINT) AS duplication_score,
      CAST({bounded_sql("100 - ((CASE WHEN rows < 30 THEN 35 WHEN rows < 100 THEN 18 ELSE 0 END) + (CASE WHEN column_count < 2 THEN 50 ELSE 0 END) + least(30, constant_count * 8) + least(24, id_count * 6))")} AS BIGINT) AS structure_score,
      CAST({bounded_sql("100 - (least(35, outlier_columns * 7) + least(32, high_card_count * 8) + (CASE WHEN column_count < 3 THEN 18 ELSE 0 END))")} AS BIGINT) AS signal_score,
      CAST((CASE WHEN rows < 30 THEN 1 ELSE 0 END) + (CASE WHEN column_count < 2 THEN 1 ELSE 0 END) + high_issues AS BIGINT) AS blocker_count,
      CAST(least(medium_issues, 6) AS BIGINT) AS warning_count
    FROM qfull) a) b"""


# ---------------------------------------------------------------- profiling
def kinds_sql(table: str) -> str:
    return f"""SELECT CAST(position AS BIGINT) AS position, column_name, kind, CAST(non_null AS BIGINT) AS non_null,
  CAST(unique_count AS BIGINT) AS unique_count FROM ({column_summary_sql(table, SCHEMAS[table])}) k"""


def top_values_sql(table: str, k: int = 5, cols: list[tuple[str, str]] | None = None, source: str | None = None) -> str:
    cs = cols or SCHEMAS[table]
    src = source or table
    parts = [
        f"SELECT {pos} AS position, '{c}' AS column_name, {text_of(c, st)} AS value, count(*) AS cnt FROM {src} WHERE {c} IS NOT NULL GROUP BY 3"
        for pos, (c, st) in enumerate(cs)
    ]
    return f"""WITH s AS ({column_summary_sql(src, cs)}),
fq AS ({' UNION ALL '.join(parts)}),
r AS (SELECT fq.*, row_number() OVER (PARTITION BY fq.column_name ORDER BY cnt DESC, value) AS rk
      FROM fq JOIN s ON fq.column_name = s.column_name WHERE s.kind IN ('date', 'categorical', 'text', 'empty'))
SELECT CAST(position AS BIGINT) AS position, column_name, CAST(rk AS BIGINT) AS rank, value, CAST(cnt AS BIGINT) AS count
FROM r WHERE rk <= {k}"""


# Target-name hints in the order they are tried (hint, problem, reason).
TARGET_HINTS_SQL = (
    ("churn", "classification", "Customer churn outcome"),
    ("default", "classification", "Loan or payment default outcome"),
    ("defaulted", "classification", "Loan or payment default outcome"),
    ("fraud", "classification", "Fraud detection outcome"),
    ("converted", "classification", "Conversion outcome"),
    ("conversion", "classification", "Conversion outcome"),
    ("risk", "classification", "Risk class or flag"),
    ("approved", "classification", "Approval outcome"),
    ("sales", "regression", "Sales or demand forecast"),
    ("revenue", "regression", "Revenue forecast"),
    ("price", "regression", "Price prediction"),
    ("spend", "regression", "Spend prediction"),
    ("amount", "regression", "Amount prediction"),
    ("score", "regression", "Score prediction"),
    ("demand", "regression", "Demand forecast"),
)


def target_suggestions_sql(table: str, source: str | None = None, cols: list[tuple[str, str]] | None = None) -> str:
    cs = cols or SCHEMAS[table]
    src = source or table
    hint = "CASE " + " ".join(f"WHEN strpos(lower(column_name), '{h}') > 0 THEN '{h}'" for h, _, _ in TARGET_HINTS_SQL) + " END"
    hp = "CASE hint " + " ".join(f"WHEN '{h}' THEN '{p}'" for h, p, _ in TARGET_HINTS_SQL) + " END"
    hr = "CASE hint " + " ".join(f"WHEN '{h}' THEN '{r}'" for h, _, r in TARGET_HINTS_SQL) + " END"
    return f"""WITH s AS (SELECT *, {hint} AS hint FROM ({column_summary_sql(src, cs)}) k),
t AS (SELECT *, CASE WHEN hint IS NOT NULL THEN {hp}
                     WHEN kind = 'numeric' AND unique_count > 15 THEN 'regression' ELSE 'classification' END AS problem_type,
             CASE WHEN hint IS NOT NULL THEN {hr} ELSE 'Modelable column with enough labeled rows' END AS reason
      FROM s WHERE kind NOT IN ('empty', 'date', 'text') AND non_null >= 10 AND unique_count >= 2)
SELECT CAST(position AS BIGINT) AS position, column_name, problem_type, reason,
  CAST(40 + (CASE WHEN hint IS NOT NULL THEN 45 ELSE 0 END)
     - (CASE WHEN lower(column_name) IN ('id', 'customer_id', 'applicant_id', 'store_id') OR lower(column_name) LIKE '%\\_id' ESCAPE '\\' THEN 35 ELSE 0 END)
     - (CASE WHEN kind = 'numeric' AND unique_count = non_null THEN 8 ELSE 0 END)
     + (CASE WHEN problem_type = 'classification' AND unique_count BETWEEN 2 AND 12 THEN 10 ELSE 0 END)
     + (CASE WHEN problem_type = 'regression' AND unique_count > 15 THEN 10 ELSE 0 END) AS BIGINT) AS score
FROM t ORDER BY score DESC, position LIMIT 5"""


# ---------------------------------------------------------------- cleaning
def cleaning_chain_sql(source_sql: str, cols: list[tuple[str, str]], target: str, drop: list[str]) -> tuple[str, list]:
    """A WITH-chain c0..c7 with every stage of the cleaning chain materialised once.
    ``drop`` is the constant + id column list (the steps are checked by the summary)."""
    keep = [(c, st) for c, st in cols if c not in drop]
    fills, fsel = [], []
    for c, st in keep:
        if c == target:
            fsel.append(c)
            continue
        if st == "numeric":
            fills.append(f"(SELECT coalesce(median(CAST({c} AS DOUBLE)), 0) FROM c4) AS f_{c}")
        else:
            dflt = "NULL" if st == "temporal" else "'Unknown'"
            fills.append(
                f"coalesce((SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM c4 WHERE {c} IS NOT NULL "
                f"GROUP BY 1 ORDER BY n DESC, CAST(v AS VARCHAR) LIMIT 1) mm), {dflt}) AS f_{c}"
            )
        fsel.append(f"coalesce({c}, fills.f_{c}) AS {c}")
    bparts, caps, bw = [], [], []
    for c, st in keep:
        if st == "numeric" and c != target:
            x = f"CAST({c} AS DOUBLE)"
            bparts.append(
                f"""SELECT '{c}' AS column_name, q.distinct_n, round(q.q1 - 1.5 * (q.q3 - q.q1), 4) AS lo,
  round(q.q3 + 1.5 * (q.q3 - q.q1), 4) AS hi, q.q3 - q.q1 AS iqr,
  (SELECT count(*) FROM c5 WHERE {x} < q.q1 - 1.5 * (q.q3 - q.q1) OR {x} > q.q3 + 1.5 * (q.q3 - q.q1)) AS cnt
FROM (SELECT count(DISTINCT {x}) AS distinct_n, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM c5) q"""
            )
            bw.append(f"coalesce(bool_or(column_name = '{c}' AND ok), FALSE) AS ok_{c}, max(lo) FILTER (WHERE column_name = '{c}') AS lo_{c}, max(hi) FILTER (WHERE column_name = '{c}') AS hi_{c}")
            caps.append(f"CASE WHEN bw.ok_{c} THEN least(greatest({x}, bw.lo_{c}), bw.hi_{c}) ELSE {x} END AS {c}")
        else:
            caps.append(c)
    hcs, tops, rsel, rcount = [], [], [], []
    for c, st in keep:
        if st == "string" and c != target:
            hcs.append(
                f"""(count(DISTINCT {c}) > 50 AND count(DISTINCT {c}) / greatest(count({c}), 1) >= 0.6
   AND NOT (count({c}) >= 8 AND coalesce((SELECT avg(CASE WHEN {date_ok('v')} THEN 1.0 ELSE 0.0 END)
        FROM (SELECT {c} AS v FROM c6 WHERE {c} IS NOT NULL ORDER BY {c} LIMIT 60) t), 0) >= 0.8)) AS hc_{c}"""
            )
            tops.append(f"top_{c} AS MATERIALIZED (SELECT {c} AS v, count(*) AS n FROM c6 WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 25)")
            rare = f"hc.hc_{c} AND {c} IS NOT NULL AND {c} NOT IN (SELECT v FROM top_{c})"
            rsel.append(f"CASE WHEN {rare} THEN '__rare__' ELSE {c} END AS {c}")
            rcount.append(f"count(*) FILTER (WHERE {rare})")
        else:
            rsel.append(c)
    ctes = [
        f"c0 AS MATERIALIZED ({source_sql})",
        "c1 AS MATERIALIZED (SELECT DISTINCT * FROM c0)",
        f"c2 AS MATERIALIZED (SELECT * FROM c1 WHERE {target} IS NOT NULL)",
        f"c4 AS MATERIALIZED (SELECT {', '.join(c for c, _ in keep)} FROM c2)",
        f"fills AS MATERIALIZED (SELECT {', '.join(fills) or '1 AS none'})",
        f"c5 AS MATERIALIZED (SELECT {', '.join(fsel)} FROM c4, fills)",
        "b AS MATERIALIZED (SELECT *, distinct_n >= 8 AND iqr <> 0 AND cnt > 0 AS ok FROM ("
        + (" UNION ALL ".join(bparts) or "SELECT NULL AS column_name, 0 AS distinct_n, 0.0 AS lo, 0.0 AS hi, 0.0 AS iqr, 0 AS cnt") + ") bb)",
        f"bw AS MATERIALIZED (SELECT {', '.join(bw) or '1 AS none'} FROM b)",
        f"c6 AS MATERIALIZED (SELECT {', '.join(caps)} FROM c5, bw)",
        f"hc AS MATERIALIZED (SELECT {', '.join(hcs) or '1 AS none'} FROM c6)",
        *tops,
        f"c7 AS MATERIALIZED (SELECT {', '.join(rsel)} FROM c6, hc)",
        f"rc AS MATERIALIZED (SELECT {' + '.join(rcount) or '0'} AS rare FROM c6, hc)",
    ]
    return "WITH " + ",\n".join(ctes) + "\n", keep


def cleaning_summary_sql(source_sql: str, cols, target: str, drop: list[str], order_by: str) -> str:
    chain, keep = cleaning_chain_sql(source_sql, cols, target, drop)
    before = quality_ctes("SELECT * FROM c0", cols, order_by) + SUMMARY_SELECT
    after = quality_ctes("SELECT * FROM c7", keep, keep[0][0]) + SUMMARY_SELECT
    miss = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c, _ in keep if c != target)
    return chain + f"""SELECT
  CAST((SELECT count(*) FROM c0) AS BIGINT) AS before_rows,
  CAST((SELECT count(*) FROM c7) AS BIGINT) AS after_rows,
  CAST({len(cols)} AS BIGINT) AS before_columns, CAST({len(keep)} AS BIGINT) AS after_columns,
  (SELECT score FROM ({before}) x) AS before_score, (SELECT score FROM ({after}) x) AS after_score,
  (SELECT issue_count FROM ({before}) x) AS before_issue_count, (SELECT issue_count FROM ({after}) x) AS after_issue_count,
  CAST((SELECT count(*) FROM c0) - (SELECT count(*) FROM c2) AS BIGINT) AS rows_removed,
  CAST({len(drop)} AS BIGINT) AS columns_removed,
  CAST((SELECT {miss or '0'} FROM c4) AS BIGINT) AS values_imputed,
  CAST((SELECT coalesce(sum(cnt), 0) FROM b WHERE ok) AS BIGINT) AS values_capped,
  CAST((SELECT rare FROM rc) AS BIGINT) AS rare_values_grouped"""


def cleaned_profile_sql(source_sql: str, cols, target: str, drop: list[str]) -> str:
    chain, keep = cleaning_chain_sql(source_sql, cols, target, drop)
    return chain + profile_sql("c7", source="c7", cols=keep)


def spark_round(expr: str, digits: int) -> str:
    """Half-up rounding of a double's shortest decimal form (what Spark's
    ``round`` does), spelled for DuckDB, whose ``round`` works on the binary value."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 12)), {digits}) AS DOUBLE)"
