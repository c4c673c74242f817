"""Exact quantiles (linear interpolation) without a per-group value buffer.

Spark's ``percentile`` keeps a value->count map of the whole group in one task;
for a column with billions of distinct values that map does not fit. Here the
values are pre-counted (partial aggregation), ranked with the skew-safe running
sum, and only the (at most two) rows holding the wanted ranks survive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.operators.ranking import running_sum


def numeric_long(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column_name, v)`` for non-null, non-NaN values cast to double."""
    structs = [
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns
    ]
    longf = df.select(F.explode(F.array(*structs)).alias("s")).select("s.column_name", "s.v")
    return longf.filter(F.col("v").isNotNull() & ~F.isnan("v"))


def value_counts(longf: DataFrame) -> DataFrame:
    return longf.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("cnt"))


#: Rank error of the sketch that brackets a quantile, as a share of the rows: 1 / ACCURACY.
ACCURACY = 2000


def exact_quantiles(df: DataFrame, columns: list[str], probs: list[float], counts: DataFrame | None = None) -> DataFrame:
    """``(column_name, prob, n, value)``; same result as pandas/numpy ``linear``.

    A sketch brackets each wanted rank by two values; one more scan counts the rows below the bracket and gathers the value
    counts in it, about 4 / ``ACCURACY`` of the rows, or a few values that many rows share. No column is sorted. The rank is
    looked up among those; where a bracket should miss it, that column's values are all counted and ranked.
    ``counts``: (column_name, v, cnt), where the values are counted already.
    """
    if counts is not None:
        return _ranked_quantiles(counts, probs)
    number = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    spread = sorted({min(max(p + d, 0.0), 1.0) for p in probs for d in (-2 / ACCURACY, 2 / ACCURACY)})
    at = {p: (spread.index(max(p - 2 / ACCURACY, 0.0)), spread.index(min(p + 2 / ACCURACY, 1.0))) for p in probs}
    asked = [x for i, c in enumerate(columns) for x in (F.percentile_approx(number(c), spread, ACCURACY).alias(f"q{i}"), F.count(number(c)).alias(f"n{i}"), F.min(number(c)).alias(f"a{i}"), F.max(number(c)).alias(f"z{i}"))]
    found = df.agg(*asked).first()
    known = [(i, c) for i, c in enumerate(columns) if found[f"n{i}"]]
    brackets = [(i, c, p, found[f"a{i}"] if p - 2 / ACCURACY <= 0 else found[f"q{i}"][at[p][0]], found[f"z{i}"] if p + 2 / ACCURACY >= 1 else found[f"q{i}"][at[p][1]]) for i, c in known for p in probs]
    schema = "column_name string, prob double, n long, value double"
    if not brackets:
        return df.sparkSession.createDataFrame([], schema)
    sums = df.agg(*[x for k, (_, c, _, lo, hi) in enumerate(brackets) for x in (F.count_if(number(c) < lo).alias(f"b{k}"), F.count_if(number(c) == lo).alias(f"e{k}"))]).first()
    below = {f"b{k}": sums[f"b{k}"] for k in range(len(brackets))}
    open_ = [(k, c, lo, hi) for k, (_, c, _, lo, hi) in enumerate(brackets) if lo < hi]  # others hold one value, counted above
    inside = lambda c, lo, hi: (number(c) >= lo) & (number(c) <= hi)
    near = df.sparkSession.createDataFrame([(k, float(lo), sums[f"e{k}"]) for k, (_, _, _, lo, hi) in enumerate(brackets) if not lo < hi], "k int, v double, cnt long")
    if open_:
        rows = df.where(reduce(Column.__or__, [inside(*x) for _, *x in open_]))
        cells = F.array(*[F.struct(F.lit(k).alias("k"), F.when(inside(c, lo, hi), number(c)).alias("v")) for k, c, lo, hi in open_])
        near = near.unionAll(rows.select(F.inline(cells)).where("v IS NOT NULL").groupBy("k", "v").agg(F.count(F.lit(1)).alias("cnt")))
    wanted = [(k, float(below[f"b{k}"]), (found[f"n{i}"] - 1) * float(p)) for k, (i, _, p, _, _) in enumerate(brackets)]
    ranks = df.sparkSession.createDataFrame(wanted, "k int, below double, h double")
    cum = running_sum(near, ["k"], [F.asc("v")], "cnt", out="cum", few_groups=True).join(F.broadcast(ranks), "k")  # a row a bracket
    end = F.col("below") + F.col("cum")
    holds = lambda h: (h >= end - F.col("cnt")) & (h < end)
    low, high = F.floor("h"), F.ceil("h")
    picked = cum.where(holds(low) | holds(high)).groupBy("k").agg(F.max(F.when(holds(low), F.col("v"))).alias("lo"), F.max(F.when(holds(high), F.col("v"))).alias("hi")).collect()
    got = {r["k"]: r for r in picked}
    rows, missed = [], set()
    for k, (i, c, p, _, _) in enumerate(brackets):
        h, r = wanted[k][2], got.get(k)
        if r is None or r["lo"] is None or r["hi"] is None:
            missed.add(c)
        else:
            rows.append((c, float(p), found[f"n{i}"], r["lo"] + (h - int(h)) * (r["hi"] - r["lo"])))
    out = df.sparkSession.createDataFrame([x for x in rows if x[0] not in missed], schema)
    return out.unionByName(_ranked_quantiles(value_counts(numeric_long(df, sorted(missed))), probs)) if missed else out


def _ranked_quantiles(counts: DataFrame, probs: list[float]) -> DataFrame:
    cum = running_sum(counts, ["column_name"], [F.asc("v")], "cnt", out="cum_end", few_groups=True)
    sizes = counts.groupBy("column_name").agg(F.sum("cnt").alias("n"))
    targets = (
        sizes.select("column_name", "n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"))
        .withColumn("h", (F.col("n") - 1) * F.col("prob"))
        .withColumn("k_lo", F.floor("h"))
        .withColumn("k_hi", F.ceil("h"))
    )
    # targets has (#columns x #probs) rows: bounded by the request, safe to broadcast.
    hits = cum.join(F.broadcast(targets), "column_name").withColumn("cum_start", F.col("cum_end") - F.col("cnt"))

    def holds(k):
        return (F.col(k) >= F.col("cum_start")) & (F.col(k) < F.col("cum_end"))

    picked = hits.filter(holds("k_lo") | holds("k_hi")).groupBy("column_name", "prob", "n", "h", "k_lo").agg(
        F.max(F.when(holds("k_lo"), F.col("v"))).alias("lo"),
        F.max(F.when(holds("k_hi"), F.col("v"))).alias("hi"),
    )
    return picked.select(
        "column_name",
        "prob",
        "n",
        (F.col("lo") + (F.col("h") - F.col("k_lo")) * (F.col("hi") - F.col("lo"))).alias("value"),
    )


def exact_median_by_group(df: DataFrame, group_cols: list[str], value_col: str) -> DataFrame:
    """Median of ``value_col`` per group (skew-safe), ``(groups..., median)``."""
    counts = (
        df.filter(F.col(value_col).isNotNull() & ~F.isnan(F.col(value_col).cast("double")))
        .groupBy(*group_cols, F.col(value_col).cast("double").alias("v"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    cum = running_sum(counts, group_cols, [F.asc("v")], "cnt", out="cum_end")
    sizes = counts.groupBy(*group_cols).agg(F.sum("cnt").alias("n"))
    t = sizes.withColumn("h", (F.col("n") - 1) * 0.5).withColumn("k_lo", F.floor("h")).withColumn("k_hi", F.ceil("h"))
    hits = cum.join(t, group_cols).withColumn("cum_start", F.col("cum_end") - F.col("cnt"))

    def holds(k):
        return (F.col(k) >= F.col("cum_start")) & (F.col(k) < F.col("cum_end"))

    picked = hits.filter(holds("k_lo") | holds("k_hi")).groupBy(*group_cols, "h", "k_lo").agg(
        F.max(F.when(holds("k_lo"), F.col("v"))).alias("lo"),
        F.max(F.when(holds("k_hi"), F.col("v"))).alias("hi"),
    )
    return picked.select(*group_cols, (F.col("lo") + (F.col("h") - F.col("k_lo")) * (F.col("hi") - F.col("lo"))).alias("median"))
