"""Dashboard aggregates (A16-A22), filters (F1-F3), preview (F4), scatter (T4)
and trend (T5). Each chart is one small aggregate over the (filtered) frame."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.scalar import is_temporal_type, lenient_timestamp, month_key
from tabsmith.operators.freq import frequency_table, with_texts
from tabsmith.operators.profile import column_summary
from tabsmith.operators.ranking import top_k_within


def _q(c: str):
    return F.col(f"`{c}`")


# ------------------------------------------------------------------ filters
_MONTH = re.compile(r"\d{4}-(0[1-9]|1[0-2])")


def _condition(df: DataFrame, column: str, value: str, kind: str | None):
    """The test of one filter: a month range on a date column, else equality with the value's text."""
    dt = df.schema[column].dataType
    is_month = _MONTH.fullmatch(value) and (kind == "date" or (kind is None and is_temporal_type(dt)))
    if is_month:
        start = F.try_to_timestamp(F.lit(f"{value}-01"), F.lit("yyyy-MM-dd"))
        ts = lenient_timestamp(_q(column), dt)
        return (ts >= start) & (ts < F.add_months(start, 1).cast("timestamp"))
    if isinstance(dt, T.StringType):
        return _q(column) == F.lit(value)
    if isinstance(dt, T.BooleanType):
        return _q(column) == F.lit(value.lower()).try_cast("boolean")
    # cast the literal to the column type so the comparison can be pushed down
    return (_q(column) == F.lit(value).try_cast(dt)) & (_q(column).cast("string") == F.lit(value))


def apply_filters(df: DataFrame, filters: dict | None, kinds: dict[str, str] | None = None) -> tuple[DataFrame, dict]:
    """Conjunction of ``column == value`` (compared as text) or, for a
    ``YYYY-MM`` value on a date column, a month range. Without ``kinds`` the
    column's type says whether it is a date. Unknown columns, nulls, "" and
    "__all__" set no filter. The month test is a half-open timestamp range so it
    reaches the Parquet scan as a pushed filter."""
    texts = {name: "" if filters[name] is None else str(filters[name]) for name in (filters or ())}
    active = {name: filters[name] for name in texts if texts[name] not in ("", "__all__") and name in df.columns}
    for name in active:
        df = df.filter(_condition(df, name, texts[name], (kinds or {}).get(name)))
    return df, active


# ------------------------------------------------------------------ KPIs
def kpis(df: DataFrame, source: DataFrame | None = None, numeric: list[str] | None = None) -> DataFrame:
    """Active rows, total rows, columns, missing cells, mean of the first two
    numeric columns (2 dp). ``(position, label, value)``."""
    source = source if source is not None else df
    if numeric is None:
        kinds = column_summary(df).select("position", "column_name", "kind").collect()
        numeric = [r["column_name"] for r in sorted(kinds, key=lambda r: r["position"]) if r["kind"] == "numeric"]
    aggs = [
        F.count(F.lit(1)).cast("double").alias("k0"),
        reduce(lambda a, b: a + b, [F.sum(_q(c).isNull().cast("long")) for c in df.columns], F.lit(0)).cast("double").alias("k3"),
    ] + [F.round(F.avg(_q(c).cast("double")), 2).alias(f"k{4 + i}") for i, c in enumerate(numeric[:2])]
    a = df.agg(*aggs)
    total = source.agg(F.count(F.lit(1)).cast("double").alias("k1"))
    a = a.withColumn("_o", F.lit(1)).join(F.broadcast(total.withColumn("_o", F.lit(1))), "_o")
    labels = ["Active rows", "Total rows", "Total columns", "Missing cells"] + [f"Average {c}" for c in numeric[:2]]
    vals = [F.col("k0"), F.col("k1"), F.lit(float(len(df.columns))), F.coalesce("k3", F.lit(0.0))] + [F.col(f"k{4 + i}") for i in range(len(numeric[:2]))]
    return a.select(
        F.inline(
            F.array(*[F.struct(F.lit(i).cast("long").alias("position"), F.lit(lbl).alias("label"), v.cast("double").alias("value"))
                      for i, (lbl, v) in enumerate(zip(labels, vals))])
        )
    )


# ------------------------------------------------------------------ category charts
def category_charts(df: DataFrame, categorical: list[str]) -> DataFrame:
    """bar = top 8 of the first 3 categorical columns, pie = top 6 of the first 2.
    ``(chart, column_name, rank, value, count)``."""
    cols = list(dict.fromkeys(categorical[:3]))
    if not cols:
        return df.sparkSession.createDataFrame([], "chart string, column_name string, rank long, value string, count long")
    freq = frequency_table(df, cols)
    top = with_texts(df, top_k_within(freq, ["column_name"], [F.desc("count"), F.asc("value")], 8, "value"), cols)
    bars = top.select(F.lit("bar").alias("chart"), "column_name", F.col("rank").cast("long").alias("rank"), "value", "count")
    pies = top.filter(F.col("column_name").isin(*categorical[:2]) & (F.col("rank") <= 6)).select(
        F.lit("pie").alias("chart"), "column_name", F.col("rank").cast("long").alias("rank"), "value", "count"
    )
    return bars.unionByName(pies)


# ------------------------------------------------------------------ histogram
def histogram(df: DataFrame, column: str, bins: int = 8) -> DataFrame:
    """``min(bins, distinct)`` equal-width, right-closed bins over [min, max];
    empty bins kept. ``(bin, lower, upper, count)``."""
    x = _q(column).cast("double")
    vals = df.select(x.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    # min(bins, distinct) is all that counts: bins distinct values are enough to know it
    few = vals.distinct().limit(bins).agg(F.count("x").alias("nd"))
    st = vals.agg(F.min("x").alias("lo"), F.max("x").alias("hi")).withColumn("_o", F.lit(1)).join(F.broadcast(few.withColumn("_o", F.lit(1))), "_o").drop("_o")
    st = st.withColumn("nb", F.least(F.lit(bins), F.col("nd"))).withColumn("w", (F.col("hi") - F.col("lo")) / F.col("nb"))
    # st is a single row: broadcasting it is size-bounded.
    idx = F.when(F.col("w") == 0, F.lit(1)).otherwise(
        F.least(F.col("nb"), F.greatest(F.lit(1), F.ceil((F.col("x") - F.col("lo")) / F.col("w"))))
    )
    counts = (
        vals.withColumn("_o", F.lit(1))
        .join(F.broadcast(st.withColumn("_o", F.lit(1))), "_o")
        .groupBy(idx.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    all_bins = st.filter(F.col("nb") > 0).select("lo", "w", F.explode(F.sequence(F.lit(1), F.col("nb").cast("int"))).alias("bin"))
    return all_bins.join(counts, "bin", "left").select(
        F.col("bin").cast("long").alias("bin"),
        (F.col("lo") + (F.col("bin") - 1) * F.col("w")).alias("lower"),
        (F.col("lo") + F.col("bin") * F.col("w")).alias("upper"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"),
    )


# ------------------------------------------------------------------ correlation
def correlation_matrix(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Pearson over pair-complete rows, 3 dp, undefined -> 0, first 5 numeric
    columns; ``(row_column, col_column, value)``.

    Rows are grouped by which columns are null (32 groups at most). A group has each column's mean and variance and each
    pair's covariance once; a pair's moments are merged from the groups that have both."""
    cols = numeric[:5]
    n = len(cols)
    x = [_q(c).cast("double") for c in cols]
    mask = sum((F.when(c.isNull(), 0).otherwise(1 << i) for i, c in enumerate(x)), F.lit(0))
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    moments = [F.avg(c).alias(f"m{i}") for i, c in enumerate(x)] + [(F.var_pop(x[i]) if i == j else F.covar_pop(x[i], x[j])).alias(f"c{i}_{j}") for i, j in pairs]
    groups = df.groupBy(mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"), *moments).collect()
    rows = []
    for i, j in pairs:
        own = [r for r in groups if r["mask"] >> i & 1 and r["mask"] >> j & 1]
        total = sum(r["n"] for r in own)

        def merged(a: int, b: int) -> float:
            mean_a, mean_b = (sum(r["n"] * r[f"m{k}"] for r in own) / total for k in (a, b))
            return sum(r["n"] * (r[f"c{a}_{b}"] + (r[f"m{a}"] - mean_a) * (r[f"m{b}"] - mean_b)) for r in own) / total

        spread = (merged(i, i) * merged(j, j)) ** 0.5 if total else 0.0
        value = merged(i, j) / spread if spread > 0 else 0.0
        rows += [(cols[i], cols[j], value)] + ([(cols[j], cols[i], value)] if i != j else [])
    out = df.sparkSession.createDataFrame(rows, "row_column string, col_column string, value double")
    return out.withColumn("value", F.when(F.isnan("value"), 0.0).otherwise(F.round("value", 3)))


# ------------------------------------------------------------------ filter options
def available_filters(df: DataFrame, kinds: list[tuple[str, str]], per_column: int = 12, max_columns: int = 8) -> DataFrame:
    """Categorical -> top 12 values; date -> top 12 months; first 8 columns.
    ``kinds`` is ``[(column, kind)]`` in schema order."""
    chosen = [(c, k) for c, k in kinds if k in ("categorical", "date")][:max_columns]
    if not chosen:
        return df.sparkSession.createDataFrame([], "column_name string, type string, rank long, value string, count long")
    structs = []
    for c, k in chosen:
        v = month_key(lenient_timestamp(_q(c), df.schema[c].dataType)) if k == "date" else _q(c).cast("string")
        structs.append(F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("type"), v.alias("value")))
    longf = df.select(F.explode(F.array(*structs)).alias("s")).select("s.*").filter(F.col("value").isNotNull())
    freq = longf.groupBy("column_name", "type", "value").agg(F.count(F.lit(1)).alias("count"))
    top = top_k_within(freq, ["column_name"], [F.desc("count"), F.asc("value")], per_column, "value")
    return top.select("column_name", "type", F.col("rank").cast("long").alias("rank"), "value", F.col("count").cast("long").alias("count"))


# ------------------------------------------------------------------ preview, scatter, trend
def preview(df: DataFrame, order_by: list[str], limit: int = 20) -> DataFrame:
    """the first ``limit`` rows in key order (the feature is the limit)."""
    return df.orderBy(*[_q(c) for c in order_by]).limit(max(1, int(limit)))


def preview_with_total(df: DataFrame, order_by: list[str], limit: int = 20) -> DataFrame:
    """the preview, with ``total_rows``, the number of rows that the filters left."""
    total = df.agg(F.count(F.lit(1)).cast("long").alias("total_rows")).withColumn("_o", F.lit(1))
    return preview(df, order_by, limit).withColumn("_o", F.lit(1)).join(F.broadcast(total), "_o").drop("_o")  # one row on the right


def scatter_points(df: DataFrame, x: str, y: str, order_by: list[str], limit: int = 120) -> DataFrame:
    """T4: first ``limit`` complete (x, y) pairs in key order."""
    pts = df.select(*[_q(c) for c in order_by if c not in (x, y)], _q(x), _q(y)).na.drop(subset=[x, y])
    return pts.orderBy(*[_q(c) for c in order_by]).limit(limit).select(_q(x).cast("double").alias("x"), _q(y).cast("double").alias("y"))


def trend_line(df: DataFrame, date_col: str, value_col: str, tiebreak: list[str], limit: int = 200) -> DataFrame:
    """T5: parse the date, sort, first ``limit`` points; ``(day, value)``."""
    ts = lenient_timestamp(_q(date_col), df.schema[date_col].dataType)
    pts = df.select(ts.alias("_ts"), _q(value_col).cast("double").alias("value"), *[_q(c) for c in tiebreak]).na.drop(
        subset=["_ts", "value"]
    )
    top = pts.orderBy("_ts", *[_q(c) for c in tiebreak]).limit(limit)
    return top.select(F.date_format("_ts", "yyyy-MM-dd").alias("day"), "value")


def dashboard_columns(df: DataFrame) -> dict[str, list[str]]:
    """Column lists by kind, in schema order (a schema-sized plan)."""
    rows = sorted(column_summary(df).select("position", "column_name", "kind").collect(), key=lambda r: r["position"])
    out: dict[str, list[str]] = {"numeric": [], "categorical": [], "date": [], "text": [], "empty": []}
    for r in rows:
        out[r["kind"]].append(r["column_name"])
    return out


def suggest_dashboard(df: DataFrame, source: DataFrame | None = None, filters: dict | None = None) -> dict[str, DataFrame]:
    """Every dashboard piece as a DataFrame over the filtered, cached frame."""
    source = source if source is not None else df
    cols = dashboard_columns(source)
    kinds = {c: k for k, cs in cols.items() for c in cs}
    active_df, active = apply_filters(source, filters, kinds)
    active_df = active_df.cache()
    num, cat, dates = cols["numeric"], cols["categorical"], cols["date"]
    out = {
        "kpis": kpis(active_df, source, num),
        "categories": category_charts(active_df, cat),
        "available_filters": available_filters(source, [(c, kinds[c]) for c in source.columns]),
    }
    for c in num[:3]:
        out[f"histogram:{c}"] = histogram(active_df, c)
    if len(num) >= 2:
        out["correlation"] = correlation_matrix(active_df, num)
    return out
