"""Data-quality scan (A5-A15): duplicates, missing cells, constants, identifiers,
high-cardinality text, IQR outliers, issue list, quality score and dataset health.

All facts come from three passes over the data: the FREQ table (distinct
counts), the wide ``column_stats`` aggregate, the full-row duplicate count
(``groupBy(all).count()``, partial aggregation first) and the numeric value
counts for the exact quartiles. Everything after that works on frames with one
row per column.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.scalar import (
    bounded_score,
    health_risk,
    health_status,
    is_id_like_name,
    lenient_timestamp,
    quality_grade,
    severity_from_percent,
)
from tabsmith.operators.freq import column_specs, unique_counts
from tabsmith.operators.profile import column_summary
from tabsmith.operators.quantiles import exact_quantiles
from tabsmith.operators.rules import said
from tabsmith.session import settled


def one_row_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join two single-row aggregates side by side (equi-join on a constant key)."""
    return left.withColumn("_one", F.lit(1)).join(F.broadcast(right.withColumn("_one", F.lit(1))), "_one").drop("_one")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: ``rows`` and ``duplicate_rows`` (copies beyond the first; null = null)."""
    # 128 bits of two independent hashes stand for a row; the null flags tell (null, a) from (a, null)
    cells = [x for c in df.columns for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    groups = df.groupBy(F.xxhash64(*cells), F.xxhash64(F.lit(1), *cells)).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("rows"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
    )


def outlier_columns(df: DataFrame, distinct: dict[str, int] | None = None) -> DataFrame:
    """Per numeric column with >= 8 distinct values and IQR != 0, values
    outside ``[q1 - 1.5 IQR, q3 + 1.5 IQR]``; sorted by count desc. ``distinct``: the columns' distinct values, if counted."""
    specs = [s for s in column_specs(df) if s.numeric and not isinstance(s.dtype, T.BooleanType)]
    if not specs:
        schema = "position long, column_name string, count long, percent double, lower_bound double, upper_bound double"
        return df.sparkSession.createDataFrame([], schema)
    names = [s.name for s in specs]
    pos = F.create_map(*[x for s in specs for x in (F.lit(s.name), F.lit(s.position))])
    q = exact_quantiles(df, names, [0.25, 0.75])
    quart = q.groupBy("column_name").agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("q3"),
    )
    # A constant column and one without spread have none; the distinct values of the others are counted up to 8.
    bounds = (
        quart.withColumn("iqr", F.col("q3") - F.col("q1"))
        .filter(F.col("iqr") != 0)
        .withColumn("lower", F.col("q1") - 1.5 * F.col("iqr"))
        .withColumn("upper", F.col("q3") + 1.5 * F.col("iqr"))
    )
    limits = {r["column_name"]: (r["lower"], r["upper"]) for r in bounds.collect()}  # one row a numeric column
    varied = {r["column_name"] for r in unique_counts(df, list(limits)).where("unique_count >= 8").collect()} if limits and distinct is None else {c for c in limits if distinct[c] >= 8} if limits else set()
    bounds = bounds.filter(F.col("column_name").isin(*varied)) if varied else bounds.limit(0)
    cell = lambda c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double"))
    sums = [F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n"), F.col(f"o{i}").alias("count")) for i, c in enumerate(names) if c in varied]
    facts = [x for i, c in enumerate(names) if c in varied for x in (F.count(cell(c)).alias(f"n{i}"), F.count_if((cell(c) < limits[c][0]) | (cell(c) > limits[c][1])).alias(f"o{i}"))]
    outside = settled(df.agg(*facts).select(F.inline(F.array(*sums)))) if sums else df.sparkSession.createDataFrame([], "column_name string, n long, count long")
    res = bounds.join(outside, "column_name").filter(F.col("count") > 0)
    return res.select(
        pos[F.col("column_name")].cast("long").alias("position"),
        "column_name",
        F.col("count").cast("long").alias("count"),
        F.round(F.col("count") / F.greatest(F.col("n"), F.lit(1)) * 100, 2).alias("percent"),
        F.round("lower", 4).alias("lower_bound"),
        F.round("upper", 4).alias("upper_bound"),
    )


def probably_datetime(df: DataFrame, order_by: str | None = None, sample: int = 60) -> DataFrame:
    """A12 for non-numeric, non-temporal columns: >= 8 non-null values and >= 80% of
    the first ``sample`` non-null values (in ``order_by`` order) parse as dates.

    ``(column_name, probably_datetime)``; temporal columns are always true.
    """
    specs = column_specs(df)
    temporal = [s.name for s in specs if s.temporal]
    texts = [s for s in specs if not s.numeric and not s.temporal]
    spark = df.sparkSession
    rows = [(n, True) for n in temporal]
    base = spark.createDataFrame(rows, "column_name string, probably_datetime boolean") if rows else None
    if not texts:
        return base if base is not None else spark.createDataFrame([], "column_name string, probably_datetime boolean")
    ordered = df.withColumn("_ord", F.col(f"`{order_by}`") if order_by else F.monotonically_increasing_id())
    # the first values are a top-n of each task, then of those: a column is never sorted
    cell = lambda s: F.col(f"`{s.name}`").cast("string")
    firsts = reduce(DataFrame.unionAll, [ordered.select(F.lit(s.name).alias("column_name"), cell(s).alias("value"), "_ord").where("value IS NOT NULL").orderBy(F.asc("_ord"), F.asc("value")).limit(sample) for s in texts])
    share = firsts.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("_k"), F.avg(lenient_timestamp(F.col("value")).isNotNull().cast("double")).alias("_s")
    )
    sums = df.agg(*[F.count(cell(s)).alias(f"n{i}") for i, s in enumerate(texts)])
    nn = sums.select(F.inline(F.array(*[F.struct(F.lit(s.name).alias("column_name"), F.col(f"n{i}").alias("_nn")) for i, s in enumerate(texts)])))
    res = share.join(nn, "column_name").select(
        "column_name", ((F.col("_nn") >= 8) & (F.col("_s") >= 0.8)).alias("probably_datetime")
    )
    return res if base is None else res.unionByName(base)


# Fixed value: the order of the checks.
ISSUE_ORDER = ("duplicates", "missing", "constant", "id_like", "high_cardinality", "outliers")


@dataclass
class QualityReport:
    columns: DataFrame  # one row per column with every fact and flag
    outliers: DataFrame
    overview: DataFrame  # one row: rows, column_count, duplicate_rows, missing_cells, ...
    issues: DataFrame
    summary: DataFrame  # one row: score, grade, issue_count, duplicate_rows, missing_cells, outlier_columns
    health: DataFrame  # one row


def column_flags(df: DataFrame, order_by: str | None = None, target: str | None = None) -> DataFrame:
    """Per column: missing, unique ratio, constant / id-like / high-cardinality flags."""
    summ = settled(column_summary(df))
    id_names = [c for c in df.columns if is_id_like_name(c)]
    # The date-shape sample only decides between "high-cardinality" and "date", so
    # it runs only for text columns that pass the cardinality test (a plan decision
    # over a frame with one row per column).
    candidates = [
        r["column_name"]
        for r in summ.select("column_name", "storage", "unique_count", "non_null").collect()
        if r["storage"] not in ("numeric", "temporal") and r["unique_count"] > 50
        and r["unique_count"] / max(r["non_null"], 1) >= 0.6
    ]
    pdt = probably_datetime(df.select(*[F.col(f"`{c}`") for c in candidates] + ([F.col(f"`{order_by}`")] if order_by and order_by not in candidates else [])),
                            order_by) if candidates else df.sparkSession.createDataFrame([], "column_name string, probably_datetime boolean")
    if candidates and order_by and order_by not in candidates:
        pdt = pdt.filter(F.col("column_name") != order_by)
    ratio = F.col("unique_count") / F.greatest(F.col("non_null"), F.lit(1))
    flags = (
        summ.join(F.broadcast(pdt), "column_name", "left")
        .withColumn("missing", (F.col("rows") - F.col("non_null")).cast("long"))
        .withColumn("unique_ratio", ratio)
        .withColumn("is_target", F.col("column_name") == F.lit(target) if target else F.lit(False))
        .withColumn("is_constant", F.col("unique_count") <= 1)
        .withColumn(
            "is_id_like",
            F.col("column_name").isin(*id_names) & (F.col("rows") >= 20) & (ratio >= 0.9) if id_names else F.lit(False),
        )
        .withColumn(
            "is_high_cardinality",
            (F.col("storage") != "numeric")
            & ~F.coalesce(F.col("probably_datetime"), F.lit(False))
            & (F.col("unique_count") > 50)
            & (ratio >= 0.6),
        )
    )
    return flags


def _cols_csv(flag: str, limit: int, order: list) -> F.Column:
    """Comma-joined names of flagged columns, first ``limit`` in ``order``."""
    arr = F.array_sort(F.collect_list(F.when(F.col(flag), F.struct(*order, F.col("column_name")))))
    return F.array_join(F.slice(F.transform(arr, lambda s: s["column_name"]), 1, limit), ",")


def quality_report(df: DataFrame, order_by: str | None = None) -> QualityReport:
    flags = settled(column_flags(df, order_by))
    outl = settled(outlier_columns(df, {r["column_name"]: r["unique_count"] for r in flags.collect()}))
    dup = duplicate_rows(df)
    n_cols = len(df.columns)

    per_col = flags.agg(
        F.coalesce(F.sum("missing"), F.lit(0)).cast("long").alias("missing_cells"),
        F.count(F.when(F.col("missing") > 0, 1)).cast("long").alias("missing_column_count"),
        F.count(F.when(F.col("is_constant"), 1)).cast("long").alias("constant_count"),
        F.count(F.when(F.col("is_id_like"), 1)).cast("long").alias("id_count"),
        F.count(F.when(F.col("is_high_cardinality") & ~F.col("is_id_like"), 1)).cast("long").alias("high_card_count"),
        _cols_csv("is_constant", 8, [F.col("position")]).alias("constant_columns"),
        _cols_csv("is_id_like", 8, [F.col("position")]).alias("id_columns"),
        F.array_join(
            F.slice(
                F.transform(
                    F.array_sort(
                        F.collect_list(
                            F.when(F.col("missing") > 0, F.struct((-F.col("missing")).alias("k"), F.col("position"), F.col("column_name")))
                        )
                    ),
                    lambda s: s["column_name"],
                ),
                1,
                5,
            ),
            ",",
        ).alias("missing_columns"),
        F.array_join(
            F.transform(
                F.array_sort(
                    F.collect_list(
                        F.when(F.col("is_high_cardinality") & ~F.col("is_id_like"), F.struct(F.col("position"), F.col("column_name")))
                    )
                ),
                lambda s: s["column_name"],
            ),
            ",",
        ).alias("high_card_all"),
    )
    out_agg = outl.agg(
        F.count(F.lit(1)).cast("long").alias("outlier_columns"),
        F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("outlier_values"),
        F.coalesce(F.max("percent"), F.lit(0.0)).alias("outlier_max_percent"),
        F.array_join(
            F.slice(
                F.transform(
                    F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("k"), F.col("position"), F.col("column_name")))),
                    lambda s: s["column_name"],
                ),
                1,
                5,
            ),
            ",",
        ).alias("outlier_column_names"),
    )
    ov = one_row_join(one_row_join(dup, per_col), out_agg)
    ov = (
        ov.withColumn("column_count", F.lit(n_cols).cast("long"))
        .withColumn("duplicate_percent", F.col("duplicate_rows") / F.greatest(F.col("rows"), F.lit(1)) * 100)
        .withColumn(
            "missing_percent", F.col("missing_cells") / F.greatest(F.col("rows") * F.col("column_count"), F.lit(1)) * 100
        )
    )
    ov = settled(ov)

    def issue(cond, type_name, severity, title, count, percent, columns):
        return ov.filter(cond).select(
            F.lit(type_name).alias("type"),
            severity.alias("severity"),
            F.lit(title).alias("title"),
            count.cast("long").alias("metric_count"),
            percent.cast("double").alias("metric_percent"),
            columns.alias("columns"),
        )

    null_pct = F.lit(None).cast("double")
    issues = reduce(
        DataFrame.unionByName,
        [
            issue(F.col("duplicate_rows") > 0, "duplicates", severity_from_percent(F.col("duplicate_percent")),
                  "Duplicate rows detected", F.col("duplicate_rows"), F.round("duplicate_percent", 2), F.lit("")),
            issue(F.col("missing_cells") > 0, "missing", severity_from_percent(F.col("missing_percent")),
                  "Missing values found", F.col("missing_cells"), F.round("missing_percent", 2), F.col("missing_columns")),
            issue(F.col("constant_count") > 0, "constant", F.lit("medium"), "Constant columns",
                  F.col("constant_count"), null_pct, F.col("constant_columns")),
            issue(F.col("id_count") > 0, "id_like", F.lit("medium"), "ID-like columns",
                  F.col("id_count"), null_pct, F.col("id_columns")),
            issue(F.col("high_card_count") > 0, "high_cardinality", F.lit("medium"),
                  "High-cardinality categorical columns", F.col("high_card_count"), null_pct,
                  F.array_join(F.slice(F.split(F.col("high_card_all"), ","), 1, 8), ",")),
            issue(F.col("outlier_columns") > 0, "outliers", severity_from_percent(F.col("outlier_max_percent")),
                  "Numeric outliers", F.col("outlier_values"), null_pct, F.col("outlier_column_names")),
        ],
    )
    sev_rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    # High first, then medium; equal ones in the order of the checks
    order = F.array_position(F.array(*map(F.lit, ISSUE_ORDER)), F.col("type"))
    issues = issues.withColumn("severity_rank", sev_rank.cast("long")).withColumn("_order", order).orderBy("severity_rank", "_order").drop("_order")

    counts = issues.agg(
        F.count(F.lit(1)).cast("long").alias("issue_count"),
        F.count(F.when(F.col("severity") == "high", 1)).cast("long").alias("high_issues"),
        F.count(F.when(F.col("severity") == "medium", 1)).cast("long").alias("medium_issues"),
        F.count(F.when(F.col("severity") == "low", 1)).cast("long").alias("low_issues"),
    )
    full = one_row_join(ov, counts)
    penalty = F.col("high_issues") * 16 + F.col("medium_issues") * 9 + F.col("low_issues") * 4
    score = F.when((F.col("rows") == 0) | (F.col("column_count") == 0), F.lit(0)).otherwise(
        F.greatest(F.lit(0), F.least(F.lit(100), 100 - penalty))
    )
    full = full.withColumn("score", score.cast("long"))
    summary = full.select(
        "score",
        quality_grade(F.col("score")).alias("grade"),
        "issue_count",
        "duplicate_rows",
        "missing_cells",
        "outlier_columns",
    )
    health = dataset_health(full)
    return QualityReport(flags, outl, ov, issues, summary, health)


def completeness(df: DataFrame) -> DataFrame:
    """A22 (one row): cells, missing cells and 100 less the missing share, within 0 and 100; one aggregate."""
    sums = df.agg((F.count(F.lit(1)) * len(df.columns)).alias("cells"), *[F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(df.columns)])
    filled = sum((F.col(f"_{i}") for i in range(len(df.columns))), F.lit(0))
    missing = F.col("cells") - filled
    score = F.when(F.col("cells") > 0, 100 - missing / F.col("cells") * 100).otherwise(100.0)
    return sums.select("cells", missing.cast("long").alias("missing_cells"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 2).alias("completeness"))


def dataset_health(full: DataFrame) -> DataFrame:
    """A15 from the one-row quality frame."""
    rows, ncols = F.col("rows"), F.col("column_count")
    completeness = bounded_score(100 - F.least(F.lit(70.0), F.col("missing_percent") * 2.0))
    duplication = bounded_score(100 - F.least(F.lit(70.0), F.col("duplicate_percent") * 2.5))
    structure_pen = (
        F.when(rows < 30, 35).when(rows < 100, 18).otherwise(0)
        + F.when(ncols < 2, 50).otherwise(0)
        + F.least(F.lit(30), F.col("constant_count") * 8)
        + F.least(F.lit(24), F.col("id_count") * 6)
    )
    structure = bounded_score(100 - structure_pen)
    signal_pen = (
        F.least(F.lit(35), F.col("outlier_columns") * 7)
        + F.least(F.lit(32), F.col("high_card_count") * 8)
        + F.when(ncols < 3, 18).otherwise(0)
    )
    signal = bounded_score(100 - signal_pen)
    h = (
        full.withColumn("completeness_score", completeness.cast("long"))
        .withColumn("duplication_score", duplication.cast("long"))
        .withColumn("structure_score", structure.cast("long"))
        .withColumn("signal_score", signal.cast("long"))
    )
    total = bounded_score(
        F.col("score") * 0.35
        + F.col("completeness_score") * 0.20
        + F.col("duplication_score") * 0.15
        + F.col("structure_score") * 0.15
        + F.col("signal_score") * 0.15
    ).cast("long")
    blockers = (F.when(rows < 30, 1).otherwise(0) + F.when(ncols < 2, 1).otherwise(0) + F.col("high_issues")).cast("long")
    h = h.withColumn("health_score", total).withColumn("blocker_count", blockers)
    return h.select(
        F.col("health_score").alias("score"),
        quality_grade(F.col("health_score")).alias("grade"),
        health_risk(F.col("health_score")).alias("risk_level"),
        health_status(F.col("health_score"), F.col("blocker_count")).alias("status"),
        (F.col("blocker_count") == 0).alias("can_train"),
        "blocker_count",
        F.least(F.col("medium_issues"), F.lit(6)).cast("long").alias("warning_count"),
        "completeness_score",
        "duplication_score",
        "structure_score",
        "signal_score",
    )


# The health checks (label, score, bounds of good and warning, detail) and the texts of small tables.
HEALTH_CHECKS = (
    ("Completeness", "completeness_score", 85, 65, "{missing_percent:2}% missing cells."),
    ("Duplicates", "duplication_score", 90, 70, "{duplicate_percent:2}% duplicate rows."),
    ("Structure", "structure_score", 85, 65, "{rows} rows and {column_count} columns."),
    ("Model signal", "signal_score", 85, 65, "{high_card_count} high-cardinality and {outlier_columns} outlier column group(s)."),
)
FEW_ROWS = "Dataset has fewer than 30 rows; validation and model ranking may be unreliable."
FEW_COLUMNS = "Dataset needs at least one feature column and one target column."


def health_checks(report: QualityReport) -> DataFrame:
    """A15 (one row): score and status, the four checks (label, score, status, detail), blockers and warnings (six of each at most)."""
    titles = lambda s: F.transform(F.sort_array(F.collect_list(F.when(F.col("severity") == s, F.struct(F.array_position(F.array(*map(F.lit, ISSUE_ORDER)), F.col("type")), F.col("title").alias("t"))))), lambda x: x.t)
    found = report.issues.agg(titles("high").alias("high"), titles("medium").alias("medium"))
    one = one_row_join(one_row_join(report.health, report.overview.select("rows", "column_count", "missing_percent", "duplicate_percent", "high_card_count", "outlier_columns")), found)
    rows = [
        F.struct(F.lit(label).alias("label"), F.col(score).alias("score"), F.when(F.col(score) >= good, "good").when(F.col(score) >= fair, "warning").otherwise("risk").alias("status"), said(detail).alias("detail"))
        for label, score, good, fair, detail in HEALTH_CHECKS
    ]
    small = F.array_compact(F.array(F.when(F.col("rows") < 30, FEW_ROWS), F.when(F.col("column_count") < 2, FEW_COLUMNS)))
    return one.select("score", "status", F.array(*rows).alias("checks"), F.slice(F.concat(small, "high"), 1, 6).alias("blockers"), F.slice("medium", 1, 6).alias("warnings"))
