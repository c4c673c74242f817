"""Target analysis and evaluation.

Every metric is derived from aggregates: classification metrics from the
confusion counts ``groupBy(actual, predicted).count()`` (partial aggregation,
so a dominant class costs nothing extra), regression metrics from one pass of
sums. They take any ``(actual, predicted[, probability])`` frame, so they are
independent of how the predictions were made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.scalar import is_numeric_type, is_temporal_type, lenient_timestamp, normalized_name
from tabsmith.operators.freq import digest, distinct_counts, frequency_table
from tabsmith.operators.quantiles import exact_quantiles
from tabsmith.operators.ranking import row_number_within
from tabsmith.session import settled


def _q(c: str):
    return F.col(f"`{c}`")


# ------------------------------------------------------------------ target
def class_counts(df: DataFrame, target: str) -> DataFrame:
    """A23 per class: ``(label, count, share)``."""
    counts = df.filter(_q(target).isNotNull()).groupBy(_q(target).cast("string").alias("label")).agg(
        F.count(F.lit(1)).alias("count")
    )
    total = counts.agg(F.sum("count").alias("_t"))
    return counts.withColumn("_o", F.lit(1)).join(F.broadcast(total.withColumn("_o", F.lit(1))), "_o").select(
        "label", F.col("count").cast("long").alias("count"), F.round(F.col("count") / F.col("_t"), 4).alias("share")
    )


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """A23 summary (one row): majority/minority, shares, ratio, severity."""
    c = class_counts(df, target)
    # One row per class: bounded by the number of classes.
    # class order: count desc, label asc; majority first, minority last
    order = F.struct(-F.col("count"), F.col("label"))
    agg = c.agg(
        F.count(F.lit(1)).cast("long").alias("class_count"),
        F.sum("count").alias("total"),
        F.min_by(F.struct("label", "count"), order).alias("maj"),
        F.max_by(F.struct("label", "count"), order).alias("mino"),
    )
    share_maj = F.col("maj.count") / F.col("total")
    share_min = F.col("mino.count") / F.col("total")
    ratio = F.col("maj.count") / F.greatest(F.col("mino.count"), F.lit(1))
    sev = (
        F.when((share_maj >= 0.85) | (ratio >= 8), "severe")
        .when((share_maj >= 0.7) | (ratio >= 4), "moderate")
        .when((share_maj >= 0.6) | (ratio >= 2), "mild")
        .otherwise("balanced")
    )
    return agg.select(
        sev.alias("severity"),
        "class_count",
        F.col("maj.label").alias("majority_class"),
        F.col("mino.label").alias("minority_class"),
        F.col("maj.count").cast("long").alias("majority_count"),
        F.col("mino.count").cast("long").alias("minority_count"),
        F.round(share_maj, 4).alias("majority_share"),
        F.round(share_min, 4).alias("minority_share"),
        F.round(ratio, 2).alias("imbalance_ratio"),
    )


def median(df: DataFrame, column: str) -> DataFrame:
    """One row, ``median``: null without values."""
    return exact_quantiles(df, [column], [0.5]).agg(F.max("value").alias("median"))


def target_summary(df: DataFrame, target: str) -> DataFrame:
    """A24 regression: mean / median / min / max / population std (4 dp)."""
    x = _q(target).cast("double")
    base = df.select(x.alias("y")).filter(F.col("y").isNotNull())
    stats = base.agg(F.avg("y").alias("mean"), F.min("y").alias("min"), F.max("y").alias("max"), F.stddev_pop("y").alias("std"))
    med = median(base, "y")
    return stats.withColumn("_o", F.lit(1)).join(F.broadcast(med.withColumn("_o", F.lit(1))), "_o").select(
        F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), F.round("min", 4).alias("min"),
        F.round("max", 4).alias("max"), F.round("std", 4).alias("std"),
    )


def category_purity(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """A10: sum over categories of weight(category) x max class share in it, on rows
    where feature and target are both present; 0 when < 2 categories.
    ``(column_name, purity)``: three aggregations, no per-group Python."""
    if not features:
        return df.sparkSession.createDataFrame([], "column_name string, purity double")
    structs = [F.struct(F.lit(c).alias("column_name"), digest(_q(c).cast("string")).alias("value")) for c in features]
    longf = (
        df.select(digest(_q(target).cast("string")).alias("_y"), F.explode(F.array(*structs)).alias("s"))
        .select("s.column_name", "s.value", "_y")
        .filter(F.col("value").isNotNull() & F.col("_y").isNotNull())
    )
    pair = longf.groupBy("column_name", "value", "_y").agg(F.count(F.lit(1)).alias("n"))
    per_cat = pair.groupBy("column_name", "value").agg(F.max("n").alias("top"), F.sum("n").alias("tot"))
    per_col = per_cat.groupBy("column_name").agg(
        (F.sum("top") / F.sum("tot")).alias("purity"), F.count(F.lit(1)).alias("categories")
    )
    return per_col.select("column_name", F.when(F.col("categories") < 2, 0.0).otherwise(F.col("purity")).alias("purity"))


def date_like_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """M2: temporal type, or non-numeric with >= 70% of all rows parsing and >= 3
    distinct dates. ``(column_name, is_date_like)``."""
    cols = columns or df.columns
    types = {c: df.schema[c].dataType for c in cols}
    texts = [c for c in cols if not (is_temporal_type(types[c]) or is_numeric_type(types[c]))]
    fixed = [(c, is_temporal_type(types[c])) for c in cols if c not in texts]
    spark = df.sparkSession
    out = spark.createDataFrame(fixed, "column_name string, is_date_like boolean")
    if not texts:
        return out
    # only parsed dates are shuffled, each column's distinct ones counted before they are counted again
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), lenient_timestamp(_q(c), types[c]).alias("ts")) for c in texts]))
    dates = df.select(cells.alias("s")).select("s.*").filter(F.col("ts").isNotNull()).groupBy("column_name", "ts").agg(F.count(F.lit(1)).alias("n"))
    parsed = dates.groupBy("column_name").agg(F.sum("n").alias("parsed"), F.count(F.lit(1)).alias("distinct_dates"))
    names = spark.createDataFrame([(c,) for c in texts], "column_name string")
    # one row on the right: the table's row count
    rows = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("_o", F.lit(1))
    told = names.join(parsed, "column_name", "left").withColumn("_o", F.lit(1)).join(F.broadcast(rows), "_o")
    flag = F.coalesce((F.col("parsed") >= 0.7 * F.col("rows")) & (F.col("distinct_dates") >= 3), F.lit(False))
    return out.unionByName(told.select("column_name", flag.alias("is_date_like")))


def leakage_scan(df: DataFrame, features: list[str], target: str, problem_type: str) -> DataFrame:
    """M3 per feature with >= 10 complete pairs: exact match share, target name in
    the feature name, |correlation| with the (encoded) target, category purity.
    ``(column_name, severity, score, reasons)`` for flagged columns only."""
    tname = normalized_name(target)
    y = _q(target)
    ys = y.cast("string")
    is_num_target = is_numeric_type(df.schema[target].dataType)
    # Classes encoded by sorted label order (only the sign differs from first-seen order).
    if problem_type == "classification":
        labels = df.select(ys.alias("l")).filter(F.col("l").isNotNull()).distinct()
        numbered = row_number_within(labels.withColumn("_all", F.lit(1)), ["_all"], [F.asc("l")], out="code")
        enc = numbered.select("l", (F.col("code") - 1).alias("code"))
        base = df.join(enc, ys == F.col("l"), "left")
        yenc = F.col("code").cast("double")
    else:
        base = df
        yenc = y.cast("double") if is_num_target else F.lit(None).cast("double")
    aggs = []
    for i, c in enumerate(features):
        x = _q(c)
        both = x.isNotNull() & y.isNotNull()
        dt = df.schema[c].dataType
        xn = F.unix_micros(x.cast("timestamp")).cast("double") if is_temporal_type(dt) else (
            x.cast("double") if is_numeric_type(dt) else x.try_cast("double"))
        pair = xn.isNotNull() & yenc.isNotNull()
        a, b = F.when(pair, xn), F.when(pair, yenc)
        aggs += [
            F.count(F.when(both, 1)).alias(f"n{i}"),
            F.avg(F.when(both, (x.cast("string") == ys).cast("double"))).alias(f"m{i}"),
            F.count(F.when(pair, 1)).alias(f"pn{i}"),
            (F.min(a) < F.max(a)).alias(f"pd{i}"),  # more than one value
            F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"r{i}"),
            F.count(x).alias(f"nn{i}"),
        ]
    wide = base.agg(*aggs)
    rows = []
    for i, c in enumerate(features):
        name_hit = bool(tname) and tname in normalized_name(c) and normalized_name(c) != tname
        rows.append(
            F.struct(
                F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("match"),
                F.col(f"pn{i}").alias("pn"), F.col(f"pd{i}").alias("pd"), F.col(f"r{i}").alias("r"),
                F.col(f"nn{i}").alias("nn"), F.lit(name_hit).alias("name_hit"),
            )
        )
    per = wide.select(F.inline(F.array(*rows))).filter(F.col("n") >= 10)
    # distinct counts come from one digest FREQ pass, not from a multi-distinct aggregate
    unique = distinct_counts(frequency_table(df, features))
    per = per.join(F.broadcast(unique), "column_name", "left")
    per = per.withColumn("uratio", F.coalesce("unique_count", F.lit(0)) / F.greatest(F.col("nn"), F.lit(1)))
    if problem_type == "classification":
        # nearly unique features say nothing about purity: they are not even read
        per = settled(per)
        pur = category_purity(df, [r["column_name"] for r in per.where(F.col("uratio") < 0.9).select("column_name").collect()], target)
        per = per.join(F.broadcast(pur), "column_name", "left")
    else:
        per = per.withColumn("purity", F.lit(None).cast("double"))
    r_ok = (F.col("pn") >= 10) & F.col("pd") & F.col("r").isNotNull() & ~F.isnan("r") & (F.abs("r") >= 0.98)
    exact = F.col("match") >= 0.98
    pure = (F.lit(problem_type == "classification")) & (F.col("uratio") < 0.9) & (F.coalesce("purity", F.lit(0.0)) >= 0.98)
    high = exact | r_ok | pure
    score = F.greatest(
        F.when(exact, F.col("match")).otherwise(0.0),
        F.when(F.col("name_hit"), 0.9).otherwise(0.0),
        F.when(r_ok, F.abs("r")).otherwise(0.0),
        F.when(pure, F.col("purity")).otherwise(0.0),
    )
    reasons = F.concat_ws(
        "; ",
        F.when(exact, F.lit("feature value almost exactly matches the target")),
        F.when(F.col("name_hit"), F.lit("column name contains the target name")),
        F.when(r_ok, F.lit("correlation with target")),
        F.when(pure, F.lit("category purity")),
    )
    flagged = per.filter(exact | F.col("name_hit") | r_ok | pure)
    return flagged.select(
        "column_name",
        F.when(high, "high").otherwise("medium").alias("severity"),
        F.round(score, 4).alias("score"),
        reasons.alias("reasons"),
    )


# ------------------------------------------------------------------ split
def stratified_split(df: DataFrame, label: str, order_key, test_share: float = 0.2) -> DataFrame:
    """M7: per class, the first ceil(share x class count) rows in ``order_key``
    order are the holdout. ``order_key`` should be a pseudo-random but
    deterministic key (e.g. a hash of the row id and the seed). Adds ``is_test``.
    The per-class numbering is skew-safe (a dominant class is split across tasks)."""
    keyed = df.withColumn("_k", order_key).withColumn("_y", _q(label).cast("string"))
    counts = keyed.groupBy("_y").agg(F.count(F.lit(1)).alias("_cn"))
    ranked = row_number_within(keyed, ["_y"], [F.asc("_k")], out="_rn")
    return ranked.join(counts, ranked["_y"].eqNullSafe(counts["_y"])).drop(counts["_y"]).withColumn(
        "is_test", F.col("_rn") <= F.ceil(F.col("_cn") * F.lit(test_share))
    ).drop("_k", "_y", "_rn", "_cn")


# ------------------------------------------------------------------ classification metrics
def confusion_counts(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return pred.groupBy(_q(actual).cast("string").alias("actual"), _q(predicted).cast("string").alias("predicted")).agg(
        F.count(F.lit(1)).cast("long").alias("count")
    )


def class_report(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """M17 per label: precision, recall, f1, support (zero division -> 0)."""
    # a prediction speaks for two labels: the true one and the one it names
    a, p = _q(actual).cast("string"), _q(predicted).cast("string")
    one = lambda label, support, tp, called: F.struct(label.alias("label"), support.alias("support"), tp.alias("tp"), called.alias("pred_n"))
    none, known = F.lit(0), lambda c: c.isNotNull().cast("int")
    cells = F.array(one(a, known(a), F.coalesce(a == p, F.lit(False)).cast("int"), none), one(p, none, none, known(p)))
    r = pred.select(F.inline(cells)).groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "tp", "pred_n")])
    prec = F.when(F.col("pred_n") > 0, F.col("tp") / F.col("pred_n")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    return r.select(
        "label", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"), F.col("support").cast("long").alias("support")
    )


def classification_metrics(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """M9 (one row): accuracy, balanced accuracy, weighted precision/recall/F1 (4 dp)."""
    rep = class_report(pred, actual, predicted)
    agg = rep.agg(
        F.sum("support").alias("n"),
        F.sum(F.col("recall") * F.col("support")).alias("correct"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("bal"),
        F.sum(F.col("precision") * F.col("support")).alias("wp"),
        F.sum(F.col("f1") * F.col("support")).alias("wf"),
    )
    return agg.select(
        F.round(F.col("correct") / F.col("n"), 4).alias("accuracy"),
        F.round("bal", 4).alias("balanced_accuracy"),
        F.round(F.col("wp") / F.col("n"), 4).alias("precision_weighted"),
        F.round(F.col("correct") / F.col("n"), 4).alias("recall_weighted"),
        F.round(F.col("wf") / F.col("n"), 4).alias("f1_weighted"),
    )


def threshold_curve(pred: DataFrame, positive: str, actual: str = "actual", probability: str = "probability",
                    thresholds=(0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8)) -> DataFrame:
    """One aggregate over rows x 7 thresholds (an explode of a fixed array,
    not a join): accuracy, precision, recall, f1, predicted positives and rate."""
    t = pred.select(
        (_q(actual).cast("string") == F.lit(positive)).alias("pos"),
        _q(probability).cast("double").alias("p"),
        F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold"),
    )
    hit = F.col("p") >= F.col("threshold")
    g = t.groupBy("threshold").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((hit & F.col("pos")).cast("long")).alias("tp"),
        F.sum((hit & ~F.col("pos")).cast("long")).alias("fp"),
        F.sum((~hit & F.col("pos")).cast("long")).alias("fn"),
        F.sum((~hit & ~F.col("pos")).cast("long")).alias("tn"),
    )
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    return g.select(
        "threshold",
        F.round((F.col("tp") + F.col("tn")) / F.col("n"), 4).alias("accuracy"),
        F.round(prec, 4).alias("precision"),
        F.round(rec, 4).alias("recall"),
        F.round(f1, 4).alias("f1"),
        (F.col("tp") + F.col("fp")).cast("long").alias("predicted_positive"),
        F.round((F.col("tp") + F.col("fp")) / F.col("n"), 4).alias("predicted_positive_rate"),
    )


def best_threshold(curve: DataFrame) -> DataFrame:
    """The threshold of the largest f1, then recall (ties: the smaller one), next to the default 0.5."""
    default = curve.where(F.col("threshold") == 0.5).select(F.col("f1").alias("default_f1"), F.lit(1).alias("_o"))
    best = curve.agg(F.max_by(F.struct("threshold", "f1", "recall"), F.struct("f1", "recall", -F.col("threshold"))).alias("b")).withColumn("_o", F.lit(1))
    return best.join(F.broadcast(default), "_o", "left").select(
        F.col("b.threshold").alias("recommended_threshold"), F.col("b.f1").alias("f1"), F.col("b.recall").alias("recall"), F.lit(0.5).alias("default_threshold"), "default_f1"
    )


def nearest_threshold(curve: DataFrame, wanted: float) -> DataFrame:
    """The curve's row nearest to ``wanted`` (ties: the smaller threshold)."""
    rows = F.struct(*[F.col(c) for c in curve.columns])
    return curve.agg(F.min_by(rows, F.struct(F.abs(F.col("threshold") - wanted), "threshold")).alias("r")).select("r.*")


def diagnostics(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """M17, one row: errors, error rate, most frequent confusion (ties: first labels)
    and the class of the least recall, then f1 (ties: first label)."""
    cm = confusion_counts(pred, actual, predicted)
    wrong = F.col("actual") != F.col("predicted")
    totals = cm.agg(
        F.sum("count").cast("long").alias("holdout_rows"), F.coalesce(F.sum(F.when(wrong, F.col("count"))), F.lit(0)).cast("long").alias("errors"),
        F.min(F.when(wrong, F.struct((-F.col("count")).alias("n"), "actual", "predicted"))).alias("c"),
    )
    report = class_report(pred, actual, predicted).where(F.col("support") > 0)
    weakest = report.agg(F.min(F.struct(F.round("recall", 4).alias("recall"), F.round("f1", 4).alias("f1"), "label")).alias("w"))
    # one row on either side
    return totals.withColumn("_o", F.lit(1)).join(F.broadcast(weakest.withColumn("_o", F.lit(1))), "_o").select(
        "holdout_rows", "errors", F.round(F.col("errors") / F.greatest(F.col("holdout_rows"), F.lit(1)), 4).alias("error_rate"),
        F.col("c.actual").alias("confused_actual"), F.col("c.predicted").alias("confused_predicted"), (-F.col("c.n")).cast("double").alias("confused_count"),
        F.col("w.label").alias("weakest_class"), F.col("w.recall").alias("weakest_recall"), F.col("w.f1").alias("weakest_f1"),
    )


def prediction_distribution(pred: DataFrame, predicted: str = "predicted") -> DataFrame:
    """Predictions by label."""
    return pred.groupBy(_q(predicted).cast("string").alias("label")).agg(F.count(F.lit(1)).cast("long").alias("count"))


def mistake_samples(pred: DataFrame, order_by: list[str], actual: str = "actual", predicted: str = "predicted", limit: int = 20) -> DataFrame:
    """The first misclassified rows in key order (the limit is the feature)."""
    wrong = pred.where(~_q(actual).cast("string").eqNullSafe(_q(predicted).cast("string")))
    return wrong.orderBy(*order_by).limit(limit).select(*order_by, _q(actual).cast("string").alias("actual"), _q(predicted).cast("string").alias("predicted"))


# ------------------------------------------------------------------ regression metrics
def _errors(pred: DataFrame, actual: str, predicted: str) -> DataFrame:
    a, p = _q(actual).cast("double"), _q(predicted).cast("double")
    base = pred.select(a.alias("a"), p.alias("p")).filter(F.col("a").isNotNull() & F.col("p").isNotNull())
    return base.withColumn("e", F.col("a") - F.col("p")).withColumn("_g", F.lit(1))


def _error_sums(base: DataFrame) -> DataFrame:
    return base.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("e") * F.col("e")).alias("sse"),
        F.avg(F.abs("e")).alias("mae"),
        F.avg(F.when(F.col("a") != 0, F.abs("e") / F.abs("a"))).alias("mape"),
        F.avg("e").alias("mean_error"),
        F.min("e").alias("over"),
        F.max("e").alias("under"),
        F.var_pop("a").alias("va"),
    )


def _scores() -> list[Column]:
    r2 = F.when(F.col("va") > 0, 1 - (F.col("sse") / F.col("n")) / F.col("va"))
    return [F.round(r2, 4).alias("r2"), F.round("mae", 4).alias("mae"), F.round(F.sqrt(F.col("sse") / F.col("n")), 4).alias("rmse")]


def regression_scores(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """r2, mae and rmse of :func:`regression_metrics` (one row), from one pass of sums: no median is looked up."""
    return _error_sums(_errors(pred, actual, predicted)).select(*_scores())


def regression_metrics(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """M10 + M18 (one row): r2, mae, rmse, mape (actual != 0), mean/median error,
    largest over/under prediction."""
    base = _errors(pred, actual, predicted)
    s = _error_sums(base)
    med = median(base, "e")
    j = s.withColumn("_o", F.lit(1)).join(F.broadcast(med.withColumn("_o", F.lit(1))), "_o")
    return j.select(
        F.col("n").cast("long").alias("holdout_rows"),
        *_scores(),
        F.round("mape", 4).alias("mape"),
        F.round("mean_error", 4).alias("mean_error"),
        F.round("median", 4).alias("median_error"),
        F.round("over", 4).alias("largest_over_prediction"),
        F.round("under", 4).alias("largest_under_prediction"),
    )


def top_residuals(pred: DataFrame, order_key: str, actual: str = "actual", predicted: str = "predicted", k: int = 20) -> DataFrame:
    """The ``k`` largest absolute errors (the feature is the top-k)."""
    a, p = _q(actual).cast("double"), _q(predicted).cast("double")
    e = pred.select(_q(order_key).alias("row_key"), a.alias("actual"), p.alias("predicted")).withColumn(
        "abs_error", F.abs(F.col("actual") - F.col("predicted"))
    )
    return e.orderBy(F.desc("abs_error"), F.asc("row_key")).limit(k)


def baseline_regression(train: DataFrame, test: DataFrame, target: str) -> DataFrame:
    """M8: always predict the training mean: r2, mae, rmse on the test rows."""
    mean = train.agg(F.avg(_q(target).cast("double")).alias("predicted")).withColumn("_o", F.lit(1))
    scored = test.select(_q(target).cast("double").alias("actual")).withColumn("_o", F.lit(1)).join(F.broadcast(mean), "_o")
    return regression_scores(scored.select("actual", "predicted"))


def baseline_classification(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """M8: always predict the training mode (ties -> smallest label)."""
    mode = (
        train.filter(_q(label).isNotNull())
        .groupBy(_q(label).cast("string").alias("m"))
        .agg(F.count(F.lit(1)).alias("c"))
        .agg(F.min_by("m", F.struct(-F.col("c"), F.col("m"))).alias("mode"))
    )
    scored = test.select(_q(label).cast("string").alias("actual")).withColumn("_o", F.lit(1)).join(
        F.broadcast(mode.withColumn("_o", F.lit(1))), "_o"
    ).select("actual", F.col("mode").alias("predicted"))
    return classification_metrics(scored).select("accuracy", "balanced_accuracy", "f1_weighted")
