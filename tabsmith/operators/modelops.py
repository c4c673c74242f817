"""Model-operations tables over a model registry.

Registry tables are ordinary DataFrames (``models``, ``snapshots``, ``alerts``,
``audits``), so the per-model logic of the original runs for every model at
once. Every per-group ordering uses the skew-safe numbering of
``operators.ranking`` (a group key that owns a third of the registry is cut
across tasks); the "previous row" is an equi-join on ``(group, row number)``,
whose keys are all distinct. Group totals come back by a join on the group, which
relies on the small side's run-time size or on adaptive skew splitting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.operators.ranking import row_number_within, top_k_within
from tabsmith.operators.rules import number

EXPERIMENT_KEYS = ["dataset_id", "target_column", "problem_type", "primary_metric"]
CHAMPION_KEYS = ["target_column", "problem_type", "primary_metric"]


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys]
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def experiment_history(models: DataFrame) -> DataFrame:
    """Per (dataset, target, problem, metric), newest first: run number, group
    size, previous (older) score, delta (4 dp), is_latest, is_best_for_group."""
    ranked = row_number_within(models, EXPERIMENT_KEYS, [F.desc("created_at"), F.desc("model_id")], out="_idx")
    sizes = models.groupBy(*EXPERIMENT_KEYS).agg(
        F.count(F.lit(1)).alias("group_run_count"),
        # best = highest score, the newest one among equal scores
        F.max_by("model_id", F.when(F.col("rank_score").isNotNull(), F.struct("rank_score", "created_at", "model_id"))).alias("_best"),
    )
    prev = ranked.select(*EXPERIMENT_KEYS, (F.col("_idx") - 1).alias("_idx"), F.col("rank_score").alias("previous_score"))
    j = _null_safe_join(ranked, sizes, EXPERIMENT_KEYS)
    j = _null_safe_join(j, prev, EXPERIMENT_KEYS + ["_idx"], "left")
    return j.select(
        "model_id", *EXPERIMENT_KEYS, "rank_score", "previous_score",
        F.round(F.col("rank_score") - F.col("previous_score"), 4).alias("score_delta"),
        (F.col("_idx") == 1).alias("is_latest"),
        F.coalesce(F.col("_best") == F.col("model_id"), F.lit(False)).alias("is_best_for_group"),
        (F.col("group_run_count") - F.col("_idx") + 1).cast("long").alias("group_run_number"),
        F.col("group_run_count").cast("long").alias("group_run_count"),
        "created_at",
    )


def history_summary(history: DataFrame) -> DataFrame:
    """W1 (one row): runs, best run (the newest among equal scores), latest run, and runs that improved on the one before."""
    return history.agg(
        F.count(F.lit(1)).cast("long").alias("runs"),
        F.max_by("model_id", F.when(F.col("rank_score").isNotNull(), F.struct("rank_score", "created_at", "model_id"))).alias("best_run"),
        F.max("rank_score").alias("best_score"),
        F.max_by("model_id", F.struct("created_at", "model_id")).alias("latest_run"),
        F.count_if(F.col("score_delta") > 0).cast("long").alias("improved_runs"),
    )


def best_model(models: DataFrame, by: str = "dataset_id", target: str | None = None) -> DataFrame:
    """The best-scoring model of each dataset (the newest among equal scores); with ``target`` among its models of that
    target, or among all where none of them has it."""
    scored = models.where(F.col("rank_score").isNotNull())
    fits = F.lit(True) if target is None else F.coalesce(F.col("target_column") == target, F.lit(False))
    order = F.struct(fits.alias("fits"), "rank_score", "created_at", "model_id")
    return scored.groupBy(by).agg(F.max_by(F.struct("model_id", "rank_score"), order).alias("b"), F.count(F.lit(1)).cast("long").alias("scored_models")).select(by, "b.model_id", "b.rank_score", "scored_models")


def champion_signals(models: DataFrame, promotions: DataFrame | None = None) -> DataFrame:
    """W2/W3 for every model: rank among scored models of its (target, problem,
    metric) group by score desc (newest first on ties), champion score, delta to
    the champion, status production / champion / challenger / unscored."""
    return _compared(models, promotions).drop("champion_id", "production_id")


def _compared(models: DataFrame, promotions: DataFrame | None) -> DataFrame:
    scored = models.filter(F.col("rank_score").isNotNull())
    ranked = row_number_within(scored, CHAMPION_KEYS, [F.desc("rank_score"), F.desc("created_at"), F.desc("model_id")], out="rank")
    champ = scored.groupBy(*CHAMPION_KEYS).agg(
        F.max("rank_score").alias("champion_score"),
        F.count(F.lit(1)).alias("group_size"),
        F.max_by("model_id", F.struct("rank_score", "created_at", "model_id")).alias("champion_id"),
    )
    out = models.join(ranked.select(F.col("model_id").alias("_mid"), "rank"), F.col("model_id") == F.col("_mid"), "left").drop("_mid")
    out = _null_safe_join(out, champ, CHAMPION_KEYS, "left")
    if promotions is not None:
        act = promotions.filter(F.col("status") == "active").select(*CHAMPION_KEYS, F.col("model_id").alias("production_id"))
        out = _null_safe_join(out, act, CHAMPION_KEYS, "left")
    else:
        out = out.withColumn("production_id", F.lit(None).cast(models.schema["model_id"].dataType))
    status = (
        F.when(F.col("rank").isNull(), "unscored")
        .when(F.col("model_id") == F.col("production_id"), "production")
        .when(F.col("model_id") == F.col("champion_id"), "champion")
        .otherwise("challenger")
    )
    return out.select(
        "model_id", *CHAMPION_KEYS, "rank_score",
        F.col("rank").cast("long").alias("rank"),  # null: unscored
        F.coalesce(F.col("group_size"), F.lit(0)).cast("long").alias("group_size"),
        "champion_score",
        F.round(F.col("rank_score") - F.col("champion_score"), 4).alias("delta_vs_champion"),
        status.alias("status"), "champion_id", "production_id",
    )


# What to do with a model beside its group's champion, the first that holds.
_ALONE = "Train another model with the same target to create a champion/challenger comparison."
_KEEP = ("Keep this model as champion while monitoring drift, confidence, and audit coverage.", "Use retrain-from-drift when fresh labeled data becomes available.")
CLOSE = 0.02


def champion_actions(models: DataFrame, promotions: DataFrame | None = None) -> DataFrame:
    """The signals with ``actions`` for every model, by its place beside champion and production model. ``models`` may
    carry ``best_model``, the name that a production model is called by."""
    rows = _compared(models, promotions)
    names = models.select(F.col("model_id").alias("production_id"), (F.col("best_model") if "best_model" in models.columns else F.lit(None).cast("string")).alias("production_name"))
    rows = rows.join(names, "production_id", "left")
    gap = F.col("champion_score") - F.col("rank_score")
    is_production = F.col("model_id").eqNullSafe(F.col("production_id"))
    is_champion = F.col("model_id").eqNullSafe(F.col("champion_id"))
    has_production = F.col("production_id").isNotNull()
    one = lambda *parts: F.array(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    behind = one(
        F.concat(F.lit("Champion remains stronger by "), number(gap), F.lit(" "), F.coalesce(F.col("primary_metric"), F.lit("score")), F.lit(" point(s).")),
        "Use the challenger as experiment evidence or retrain with richer labeled data.",
    )
    elsewhere = one(F.concat(F.lit("Production is currently assigned to "), F.coalesce("production_name", F.lit("another model")), F.lit(".")))
    said = (
        F.when(F.col("champion_id").isNull(), one(_ALONE))
        .when(is_production, one("This model is manually promoted to production. Keep monitoring drift, confidence, and alerts.", "Retrain from drift when recent labeled data shows a stronger challenger."))
        .when(is_champion & ~has_production, one("Promote this validated champion when it is ready for production traffic.", *_KEEP))
        .when(is_champion, one(*_KEEP))
        .when(F.col("rank_score").isNull(), one("Retrain or rerun this challenger so it has a comparable score."))
        .when(gap <= CLOSE, one("This challenger is close to champion performance; validate it with batch scoring before promotion.", "Compare drift and confidence on recent data before switching APIs."))
        .when(has_production, F.concat(behind, elsewhere))
        .otherwise(behind)
    )
    return rows.select(*[c for c in rows.columns if c not in ("champion_id", "production_id", "production_name")], said.alias("actions"))


def challengers(signals: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` best models behind each group's champion, whose rank is 1."""
    return signals.where(F.col("rank").between(2, n + 1))


def promote(promotions: DataFrame, incoming: DataFrame, promoted_at) -> DataFrame:
    """The active row of each incoming group becomes ``replaced`` at ``promoted_at``; the incoming row is inserted as
    ``active``. Keys may be null (equal to each other); rows that are not active stay as they are."""
    inc = incoming.select(*CHAMPION_KEYS, "model_id").withColumn("status", F.lit("active")).withColumn("promoted_at", promoted_at).withColumn(
        "replaced_at", F.lit(None).cast("timestamp")
    )
    groups = inc.select(*CHAMPION_KEYS).distinct().withColumn("_touched", F.lit(True))
    hit = _null_safe_join(promotions, groups, CHAMPION_KEYS, "left")
    gone = F.col("_touched").isNotNull() & (F.col("status") == "active")
    old = hit.withColumn("replaced_at", F.when(gone, promoted_at).otherwise(F.col("replaced_at"))).withColumn("status", F.when(gone, "replaced").otherwise(F.col("status")))
    return old.drop("_touched").unionByName(inc, allowMissingColumns=True)


def snapshot_deltas(snapshots: DataFrame) -> DataFrame:
    """W4 per model: latest score, previous score, delta (4 dp), snapshot count."""
    r = top_k_within(snapshots, ["model_id"], [F.desc("created_at"), F.desc("snapshot_id")], 2, "snapshot_id", "_rn")
    top2 = r.groupBy("model_id").agg(
        F.max(F.when(F.col("_rn") == 1, F.col("score"))).alias("latest_score"),
        F.max(F.when(F.col("_rn") == 2, F.col("score"))).alias("previous_score"),
    )
    n = snapshots.groupBy("model_id").agg(F.count(F.lit(1)).cast("long").alias("snapshots"))
    return top2.join(n, "model_id").select(
        "model_id", "latest_score", "previous_score",
        F.round(F.col("latest_score") - F.col("previous_score"), 4).alias("score_delta"), "snapshots",
    )


def merge_alerts(stored: DataFrame, incoming: DataFrame, now) -> DataFrame:
    """Full outer join of the stored active alerts with the incoming ones on
    (model_id, key): absent -> resolved (resolved_at = ``now``), present ->
    last_seen refreshed, new -> inserted active. ``incoming`` carries
    (model_id, key, level, seen_at). Alerts that were resolved before
    (``status`` = resolved) stay as they are, and so do further columns of an
    alert (title, message, ...): the incoming value if there is one."""
    keys = ["model_id", "key"]
    own = ["created_at", "last_seen", "resolved_at", "status"]
    if "status" not in stored.columns:
        stored = stored.withColumn("status", F.lit("active"))
    if "resolved_at" not in stored.columns:
        stored = stored.withColumn("resolved_at", F.lit(None).cast("timestamp"))
    texts = [c for c in dict.fromkeys(stored.columns + incoming.columns) if c not in (*keys, *own, "seen_at")]
    before = stored.where(F.col("status") == "resolved")
    a = stored.where(F.col("status") != "resolved").select(F.struct(*[F.col(f"`{c}`") for c in stored.columns]).alias("a"))
    i = incoming.select(F.struct(*[F.col(f"`{c}`") for c in incoming.columns]).alias("i"))
    j = a.join(i, (F.col("a.model_id") == F.col("i.model_id")) & (F.col("a.key") == F.col("i.key")), "full")

    def newer(name: str):
        sides = [F.col(f"{side}.`{name}`") for side, df in (("i", incoming), ("a", stored)) if name in df.columns]
        return F.coalesce(*sides).alias(name)

    gone = F.col("i").isNull()
    merged = j.select(
        *[newer(c) for c in keys], *[newer(c) for c in texts],
        F.when(gone, F.lit("resolved")).otherwise(F.lit("active")).alias("status"),
        F.coalesce("a.created_at", "i.seen_at").alias("created_at"),
        F.coalesce("i.seen_at", "a.last_seen").alias("last_seen"),
        F.when(gone, now).alias("resolved_at"),
    )
    return merged.unionByName(before, allowMissingColumns=True)


def audit_summary(audits: DataFrame) -> DataFrame:
    """A30 per model: audits, rows scored, low-confidence rows, mean of the audit
    average confidence (4 dp), latest audit time."""
    return audits.groupBy("model_id").agg(
        F.count(F.lit(1)).cast("long").alias("audits"),
        F.sum("row_count").cast("long").alias("rows_scored"),
        F.sum("low_confidence_rows").cast("long").alias("low_confidence_rows"),
        F.round(F.avg("average_confidence"), 4).cast("double").alias("mean_confidence"),
        F.max("created_at").alias("latest_audit"),
    )


def alert_counts(alerts: DataFrame) -> DataFrame:
    """Critical / warning / info counts over the (filtered) alerts."""
    return alerts.agg(
        F.count_if(F.col("level") == "critical").cast("long").alias("critical"),
        F.count_if(F.col("level") == "warning").cast("long").alias("warning"),
        F.count_if(F.col("level") == "info").cast("long").alias("info"),
    )


def registry_statistics(models: DataFrame) -> DataFrame:
    """Models by problem type."""
    return models.groupBy("problem_type").agg(F.count(F.lit(1)).cast("long").alias("models"))
