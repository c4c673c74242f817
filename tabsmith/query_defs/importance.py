"""Permutation importance of deterministic scorers, so that SQL can check it, and of a trained model."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.operators.importance import HELPFUL, HIGH, MEDIUM, TOP, WEAK, explanation, permutation_importance
from tabsmith.plans import train as TR
from tabsmith.queries import T, query
from tabsmith.query_defs.evaluation import labeled_docs
from tabsmith.sql_registry import oracle

KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
FEATURES = ["l_quantity", "l_discount", "l_tax"]
#: Thirteen features, of which twelve are kept: each has its weight, the last two the weight 0.
WIDE = [*FEATURES, *[f"x{i}" for i in range(1, 11)]]
WEIGHTS = [2.0, -30.0, 5.0, *[float(9 - i) for i in range(1, 9)], 0.0, 0.0]


def _order():
    """A shuffle that both engines can do: an arithmetic order of the row numbers."""
    return [(F.col("_idx") * 7919 + F.col("repeat") * 104729) % 10007, F.col("_idx")]


def _sql(pred: str, score: str, features: list[str], base: str = "lineitem") -> str:
    """``pred``: the prediction with each feature as {feature}; ``score``: the metric over (a, p)."""
    numbered = f"SELECT *, row_number() OVER (ORDER BY {', '.join(KEY)}) AS idx FROM {base}"
    parts = []
    for r in range(1, 6):
        donors = f"SELECT *, row_number() OVER (ORDER BY (idx * 7919 + {r * 104729}) % 10007, idx) AS pos FROM b"
        cells = [f"SELECT {r} AS r, {i} AS i, '{f}' AS feature, {score} AS score FROM (SELECT {{actual}} AS a, {pred.format(**{x: f'{chr(100) if x == f else chr(111)}.{x}' for x in features})} AS p FROM b o JOIN d{r} d ON o.idx = d.pos)" for i, f in enumerate(["", *features])]
        parts.append((f"d{r} AS ({donors})", " UNION ALL ".join(cells)))
    return f"""WITH b AS ({numbered}), {', '.join(d for d, _ in parts)}, s AS ({' UNION ALL '.join(c for _, c in parts)}),
d AS (SELECT s.feature, s.i, round(avg(w.score - s.score), 4) AS importance FROM s JOIN s w ON w.r = s.r AND w.feature = '' WHERE s.feature <> '' GROUP BY 1, 2),
k AS (SELECT *, abs(importance) AS size FROM d ORDER BY abs(importance) DESC, i LIMIT {TOP})
SELECT feature, importance, CASE WHEN size >= {HIGH} THEN 'High' WHEN size >= {MEDIUM} THEN 'Medium' ELSE 'Low' END AS strength,
CASE WHEN importance >= 0 THEN '{HELPFUL[0]}' ELSE '{WEAK[0]}' END AS impact, CASE WHEN importance >= 0 THEN '{HELPFUL[1]}' ELSE '{WEAK[1]}' END AS impact_key,
round(size / CASE WHEN sum(size) OVER () > 0 THEN sum(size) OVER () ELSE 1 END, 4) AS share,
CASE WHEN importance >= 0 THEN '{HELPFUL[2]}' ELSE '{WEAK[2]}' END AS interpretation FROM k"""


_R2 = "1 - sum((a - p) * (a - p)) / (var_pop(a) * count(*))"


@query("permutation_importance_rule")
def importance_regression(spark, d):
    li = T(spark, d, "lineitem").withColumn("y", F.col("l_quantity") * 2 - F.col("l_discount") * 30 + F.col("l_linenumber"))
    return permutation_importance(li, lambda c: c["l_quantity"] * 2 - c["l_discount"] * 30 + c["l_tax"] * 5, "y", FEATURES, KEY, "regression", order=_order())


oracle("permutation_importance_rule", _sql("({l_quantity} * 2 - {l_discount} * 30 + {l_tax} * 5)", _R2, FEATURES).replace("{actual}", "o.l_quantity * 2 - o.l_discount * 30 + o.l_linenumber"))


def _wide(spark, d):
    """Ten more features, arithmetic on the keys; the target has no part in the ninth and tenth."""
    li = T(spark, d, "lineitem").select(*KEY, *FEATURES)
    li = li.select("*", *[((F.col("l_orderkey") * (2 * i + 1) + F.col("l_linenumber") * i) % 17 / 16).alias(f"x{i}") for i in range(1, 11)])
    return li.withColumn("y", sum((F.col(f) * w for f, w in zip(WIDE, WEIGHTS)), F.lit(0.0)) + F.col("l_linenumber") % 3)


@query("permutation_importance_wide")
def importance_wide(spark, d):
    """Thirteen features: shares are of the twelve kept, and a drop of exactly 0 counts as helpful."""
    return permutation_importance(_wide(spark, d), lambda c: sum((c[f] * w for f, w in zip(WIDE, WEIGHTS)), F.lit(0.0)), "y", WIDE, KEY, "regression", order=_order())


_WIDE_SQL = "(SELECT *, " + ", ".join(f"((l_orderkey * {2 * i + 1} + l_linenumber * {i}) % 17) / 16.0::DOUBLE AS x{i}" for i in range(1, 11)) + " FROM lineitem)"
_WIDE_SUM = lambda side: " + ".join(f"{side.format(f)} * {w}::DOUBLE" for f, w in zip(WIDE, WEIGHTS))
oracle("permutation_importance_wide", _sql(_WIDE_SUM("{{{}}}"), _R2, WIDE, _WIDE_SQL).replace("{actual}", _WIDE_SUM("o.{}") + " + o.l_linenumber % 3"))


@query("permutation_importance_class_rule")
def importance_classification(spark, d):
    li = T(spark, d, "lineitem").withColumn("y", (F.col("l_quantity") + F.col("l_linenumber") > 28).cast("int"))
    scorer = lambda c: (c["l_quantity"] + c["l_discount"] * 20 > 26).cast("int")
    return permutation_importance(li, scorer, "y", FEATURES, KEY, "classification", order=_order())


_F1 = ("(count(*) FILTER (WHERE a = 1) * 2.0 * count(*) FILTER (WHERE a = 1 AND p = 1) / (count(*) FILTER (WHERE a = 1) + count(*) FILTER (WHERE p = 1))"
       " + count(*) FILTER (WHERE a = 0) * 2.0 * count(*) FILTER (WHERE a = 0 AND p = 0) / (count(*) FILTER (WHERE a = 0) + count(*) FILTER (WHERE p = 0))) / count(*)")
oracle("permutation_importance_class_rule", _sql("({l_quantity} + {l_discount} * 20 > 26)::INT", _F1, FEATURES).replace("{actual}", "(o.l_quantity + o.l_linenumber > 28)::INT"))


@query("explained_model_labeled_docs")
def explained_model(spark, d):
    """M20 and M21 of a trained model: the winner of a leaderboard, its importances on the holdout and their explanation."""
    ld = labeled_docs(spark, d).select("lang", "source", "n_chars", "toxic", "quality")
    result = TR.train_models(ld, "quality", "classification", specs=["Logistic Regression", "Ridge Classifier"], folds=2)
    found = result.importances()
    return explanation(found, result.best_name, "f1_weighted", len(result.plan.dropped_columns), len(result.plan.leakage_columns), ("All classes", "class review"))
