"""Dashboard queries (A16-A20, F1-F4, T4, T5) and their oracles."""

from __future__ import annotations

from tabsmith.operators import dashboard as D
from tabsmith.queries import T, query
from tabsmith.sql_registry import oracle

ORDER_FILTER = {"o_orderpriority": "2-HIGH", "o_orderdate": "1998-03", "unknown_column": "x", "o_orderstatus": "__all__"}
ORDER_FILTER_SQL = "o_orderpriority = '2-HIGH' AND o_orderdate >= TIMESTAMP '1998-03-01' AND o_orderdate < TIMESTAMP '1998-04-01'"


@query("dashboard_kpis_orders_filtered")
def kpis_orders(spark, d):
    src = T(spark, d, "orders")
    kinds = {"o_orderdate": "date"}
    active, _ = D.apply_filters(src, ORDER_FILTER, kinds)
    return D.kpis(active, src, ["o_orderkey", "o_custkey"])


oracle("dashboard_kpis_orders_filtered", f"""WITH a AS (SELECT * FROM orders WHERE {ORDER_FILTER_SQL})
SELECT CAST(p AS BIGINT) AS position, label, CAST(v AS DOUBLE) AS value FROM (
  SELECT 0 AS p, 'Active rows' AS label, (SELECT count(*) FROM a) AS v UNION ALL
  SELECT 1, 'Total rows', (SELECT count(*) FROM orders) UNION ALL
  SELECT 2, 'Total columns', 6 UNION ALL
  SELECT 3, 'Missing cells', (SELECT sum((o_orderkey IS NULL)::INT + (o_custkey IS NULL)::INT + (o_orderstatus IS NULL)::INT
      + (o_totalprice IS NULL)::INT + (o_orderdate IS NULL)::INT + (o_orderpriority IS NULL)::INT) FROM a) UNION ALL
  SELECT 4, 'Average o_orderkey', (SELECT round(avg(o_orderkey), 2) FROM a) UNION ALL
  SELECT 5, 'Average o_custkey', (SELECT round(avg(o_custkey), 2) FROM a)) k""")


@query("dashboard_categories_orders")
def categories_orders(spark, d):
    return D.category_charts(T(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


oracle("dashboard_categories_orders", """WITH f AS (
  SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value, count(*) AS cnt FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rk FROM f)
SELECT 'bar' AS chart, column_name, CAST(rk AS BIGINT) AS rank, value, CAST(cnt AS BIGINT) AS count FROM r WHERE rk <= 8
UNION ALL
SELECT 'pie', column_name, CAST(rk AS BIGINT), value, CAST(cnt AS BIGINT) FROM r WHERE rk <= 6""")


def _hist_sql(table: str, col: str, bins: int = 8) -> str:
    return f"""WITH v AS (SELECT CAST({col} AS DOUBLE) AS x FROM {table} WHERE {col} IS NOT NULL AND NOT isnan(CAST({col} AS DOUBLE))),
st AS (SELECT min(x) AS lo, max(x) AS hi, count(DISTINCT x) AS nd, least({bins}, count(DISTINCT x)) AS nb,
              (max(x) - min(x)) / least({bins}, count(DISTINCT x)) AS w FROM v),
c AS (SELECT CASE WHEN w = 0 THEN 1 ELSE least(nb, greatest(1, CAST(ceil((x - lo) / w) AS BIGINT))) END AS bin, count(*) AS cnt
      FROM v, st GROUP BY 1),
b AS (SELECT unnest(generate_series(1, (SELECT nb FROM st))) AS bin)
SELECT CAST(b.bin AS BIGINT) AS bin, lo + (b.bin - 1) * w AS lower, lo + b.bin * w AS upper,
  CAST(coalesce(cnt, 0) AS BIGINT) AS count
FROM b CROSS JOIN st LEFT JOIN c ON c.bin = b.bin"""


for _t, _c in (("orders", "o_totalprice"), ("lineitem", "l_quantity"), ("lineitem", "l_extendedprice"), ("events", "value")):

    def _hist(spark, d, _t=_t, _c=_c):
        return D.histogram(T(spark, d, _t), _c)

    query(f"histogram_{_t}_{_c}")(_hist)
    oracle(f"histogram_{_t}_{_c}", _hist_sql(_t, _c))


LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]


@query("correlation_lineitem")
def corr_lineitem(spark, d):
    return D.correlation_matrix(T(spark, d, "lineitem"), LI_NUM)


def _corr_sql(table: str, cols: list[str]) -> str:
    parts = []
    for a in cols:
        for b in cols:
            r = f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"
            parts.append(
                f"SELECT '{a}' AS row_column, '{b}' AS col_column, "
                f"coalesce(CASE WHEN isnan({r}) THEN 0.0 ELSE round({r}, 3) END, 0.0) AS value FROM {table}"
            )
    return " UNION ALL ".join(parts)


oracle("correlation_lineitem", _corr_sql("lineitem", LI_NUM))


@query("available_filters_orders")
def filters_orders(spark, d):
    src = T(spark, d, "orders")
    kinds = [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "categorical"),
             ("o_totalprice", "numeric"), ("o_orderdate", "date"), ("o_orderpriority", "categorical")]
    return D.available_filters(src, kinds)


oracle("available_filters_orders", """WITH f AS (
  SELECT 'o_orderstatus' AS column_name, 'categorical' AS type, o_orderstatus AS value, count(*) AS cnt FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 3
  UNION ALL SELECT 'o_orderdate', 'date', strftime(o_orderdate, '%Y-%m'), count(*) FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 3
  UNION ALL SELECT 'o_orderpriority', 'categorical', o_orderpriority, count(*) FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 3),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY cnt DESC, value) AS rk FROM f)
SELECT column_name, type, CAST(rk AS BIGINT) AS rank, value, CAST(cnt AS BIGINT) AS count FROM r WHERE rk <= 12""")


LI_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


@query("scatter_lineitem")
def scatter_lineitem(spark, d):
    return D.scatter_points(T(spark, d, "lineitem"), "l_quantity", "l_extendedprice", LI_KEY)


oracle("scatter_lineitem", """SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem
WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber LIMIT 120""")


@query("trend_orders")
def trend_orders(spark, d):
    return D.trend_line(T(spark, d, "orders"), "o_orderdate", "o_totalprice", ["o_orderkey"])


oracle("trend_orders", """SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(o_totalprice AS DOUBLE) AS value FROM orders
WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL ORDER BY o_orderdate, o_orderkey LIMIT 200""")


@query("preview_customer")
def preview_customer(spark, d):
    return D.preview(T(spark, d, "customer"), ["c_custkey"], 20)


oracle("preview_customer", "SELECT * FROM customer ORDER BY c_custkey LIMIT 20")
