"""Column kinds, column profile, top values and target suggestions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.scalar import ID_NAMES, TARGET_NAME_HINTS
from tabsmith.operators.freq import column_stats, distinct_counts, frequency_table, unique_counts, with_texts
from tabsmith.operators.ranking import top_k_within
from tabsmith.session import cut_lineage


def kind_expr() -> F.Column:
    """Semantic kind from a ``column_stats`` row joined with ``unique_count``."""
    nn = F.col("non_null")
    u = F.col("unique_count")
    return (
        F.when(nn == 0, "empty")
        .when(F.col("storage") == "numeric", "numeric")
        .when(F.col("storage") == "temporal", "date")
        .when(F.col("date_share") > 0.8, "date")
        .when((u / nn < 0.3) & (u <= 50), "categorical")
        .when(F.col("avg_length") > 35, "text")
        .otherwise("categorical")
    )


def column_summary(df: DataFrame, columns: list[str] | None = None, freq: DataFrame | None = None) -> DataFrame:
    """Stats + distinct counts + kind, one row per column (bounded by the schema)."""
    uniques = distinct_counts(freq) if freq is not None else unique_counts(df, columns)
    stats = column_stats(df, columns)
    # Both sides have one row per column: their size is bounded by the schema.
    joined = stats.join(F.broadcast(uniques), "column_name", "left").withColumn(
        "unique_count", F.coalesce(F.col("unique_count"), F.lit(0)).cast("long")
    )
    return joined.withColumn("kind", kind_expr())


def column_kinds(df: DataFrame) -> DataFrame:
    s = column_summary(df)
    return s.select(
        F.col("position").cast("long").alias("position"),
        "column_name",
        "kind",
        F.col("non_null").cast("long").alias("non_null"),
        "unique_count",
    )


def profile(df: DataFrame, freq: DataFrame | None = None) -> DataFrame:
    """Per column: kind, missing, missing %, distinct; numeric mean/min/max (4 dp)."""
    s = column_summary(df, freq=freq)
    missing = F.col("rows") - F.col("non_null")
    numeric = F.col("kind") == "numeric"
    return s.select(
        F.col("position").cast("long").alias("position"),
        "column_name",
        "kind",
        missing.cast("long").alias("missing"),
        F.round(F.when(F.col("rows") > 0, missing / F.col("rows") * 100).otherwise(0.0), 2).alias("missing_percent"),
        "unique_count",
        F.when(numeric, F.round("mean", 4)).alias("mean"),
        F.when(numeric, F.round("min_value", 4)).alias("min_value"),
        F.when(numeric, F.round("max_value", 4)).alias("max_value"),
    )


def top_values(df: DataFrame, k: int = 5, kinds: tuple[str, ...] = ("date", "categorical", "text", "empty"),
               freq: DataFrame | None = None) -> DataFrame:
    """Top ``k`` values per column by count desc, value asc (long texts that begin alike: by their digest).
    FREQ is made once and feeds both the kinds and the ranking."""
    freq = freq if freq is not None else cut_lineage(frequency_table(df))
    chosen = column_summary(df, freq=freq).filter(F.col("kind").isin(*kinds)).select("column_name", "position")
    cand = freq.join(F.broadcast(chosen), "column_name")
    ranked = top_k_within(cand, ["column_name"], [F.desc("count"), F.asc("value")], k, "value", "rank")
    ranked = with_texts(df, ranked.select("position", "column_name", "rank", "value", "count"), df.columns)
    return ranked.select(
        F.col("position").cast("long").alias("position"),
        "column_name",
        F.col("rank").cast("long").alias("rank"),
        "value",
        F.col("count").cast("long").alias("count"),
    )


def problem_type_expr(kind: F.Column, unique: F.Column) -> F.Column:
    """A4: numeric with more than 15 distinct values is regression."""
    return F.when((kind == "numeric") & (unique > 15), "regression").otherwise("classification")


def target_suggestions(df: DataFrame, limit: int = 5) -> DataFrame:
    """A3: rank modelable columns as targets; top ``limit`` by score, then position."""
    s = column_summary(df)
    lname = F.lower(F.col("column_name"))
    hint_of = reduce(
        lambda acc, h: acc.when(F.instr(lname, h[0]) > 0, F.lit(h[0])),
        TARGET_NAME_HINTS[1:],
        F.when(F.instr(lname, TARGET_NAME_HINTS[0][0]) > 0, F.lit(TARGET_NAME_HINTS[0][0])),
    )
    hint_problem = F.create_map(*[x for h in TARGET_NAME_HINTS for x in (F.lit(h[0]), F.lit(h[1]))])
    hint_reason = F.create_map(*[x for h in TARGET_NAME_HINTS for x in (F.lit(h[0]), F.lit(h[2]))])
    s = s.withColumn("hint", hint_of)
    inferred = problem_type_expr(F.col("kind"), F.col("unique_count"))
    problem = F.when(F.col("hint").isNotNull(), hint_problem[F.col("hint")]).otherwise(inferred)
    reason = F.when(F.col("hint").isNotNull(), hint_reason[F.col("hint")]).otherwise(
        F.lit("Modelable column with enough labeled rows")
    )
    u = F.col("unique_count")
    score = (
        F.lit(40)
        + F.when(F.col("hint").isNotNull(), 45).otherwise(0)
        - F.when(lname.isin(*ID_NAMES) | lname.endswith("_id"), 35).otherwise(0)
        - F.when((F.col("kind") == "numeric") & (u == F.col("non_null")), 8).otherwise(0)
        + F.when((problem == "classification") & (u >= 2) & (u <= 12), 10).otherwise(0)
        + F.when((problem == "regression") & (u > 15), 10).otherwise(0)
    )
    eligible = s.filter(~F.col("kind").isin("empty", "date", "text") & (F.col("non_null") >= 10) & (u >= 2))
    scored = eligible.select(
        F.col("position").cast("long").alias("position"),
        "column_name",
        problem.alias("problem_type"),
        reason.alias("reason"),
        score.cast("long").alias("score"),
    )
    # One row per column: ordering it is a bounded driver-free sort.
    return scored.orderBy(F.desc("score"), F.asc("position")).limit(limit)
