"""Model-operations queries (W1, W2/W3, W4, W6, W7, A30-A32) over registry
tables that Spark derives from orders and events by arithmetic, so the
registry grows with the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.operators import modelops as MO
from tabsmith.queries import T, query
from tabsmith.oracles import spark_round
from tabsmith.sql_registry import ORACLES, oracle


def models_registry(spark, d):
    """One model record per order."""
    o = T(spark, d, "orders")
    k = F.col("o_orderkey")
    target = F.when(k % 3 == 0, "churn").when(k % 3 == 1, "defaulted").otherwise("sales")
    problem = F.when(target == "sales", "regression").otherwise("classification")
    return o.select(
        k.alias("model_id"),
        F.concat(F.lit("ds"), (F.col("o_custkey") % 7).cast("string")).alias("dataset_id"),
        target.alias("target_column"),
        problem.alias("problem_type"),
        F.when(problem == "regression", "r2").otherwise("f1_weighted").alias("primary_metric"),
        F.when(k % 17 == 0, F.lit(None)).otherwise((F.col("o_custkey") * 7919 + k) % 10000 / 10000.0).alias("rank_score"),
        (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + k).alias("created_at"),
    )


MODELS_SQL = """SELECT o_orderkey AS model_id, 'ds' || CAST(o_custkey % 7 AS VARCHAR) AS dataset_id,
  CASE WHEN o_orderkey % 3 = 0 THEN 'churn' WHEN o_orderkey % 3 = 1 THEN 'defaulted' ELSE 'sales' END AS target_column,
  CASE WHEN o_orderkey % 3 = 2 THEN 'regression' ELSE 'classification' END AS problem_type,
  CASE WHEN o_orderkey % 3 = 2 THEN 'r2' ELSE 'f1_weighted' END AS primary_metric,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE (o_custkey * 7919 + o_orderkey) % 10000 / 10000.0 END AS rank_score,
  CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey AS created_at FROM orders"""


@query("experiment_history_orders")
def history(spark, d):
    return MO.experiment_history(models_registry(spark, d))


oracle("experiment_history_orders", f"""WITH m AS ({MODELS_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, target_column, problem_type, primary_metric ORDER BY created_at DESC, model_id DESC) AS idx,
   count(*) OVER (PARTITION BY dataset_id, target_column, problem_type, primary_metric) AS n,
   lead(rank_score) OVER (PARTITION BY dataset_id, target_column, problem_type, primary_metric ORDER BY created_at DESC, model_id DESC) AS previous_score FROM m),
b AS (SELECT dataset_id, target_column, problem_type, primary_metric,
   arg_max(model_id, (rank_score, created_at, model_id)) FILTER (WHERE rank_score IS NOT NULL) AS best FROM m GROUP BY 1, 2, 3, 4)
SELECT model_id, r.dataset_id, r.target_column, r.problem_type, r.primary_metric, rank_score, previous_score,
  round(rank_score - previous_score, 4) AS score_delta, idx = 1 AS is_latest, coalesce(best = model_id, FALSE) AS is_best_for_group,
  CAST(n - idx + 1 AS BIGINT) AS group_run_number, CAST(n AS BIGINT) AS group_run_count, created_at
FROM r JOIN b ON r.dataset_id = b.dataset_id AND r.target_column = b.target_column AND r.problem_type = b.problem_type
  AND r.primary_metric = b.primary_metric""")


def promotions_registry(spark, d):
    """The earliest scored model of each group was promoted once."""
    m = models_registry(spark, d).filter(F.col("rank_score").isNotNull())
    first = m.groupBy(*MO.CHAMPION_KEYS).agg(F.min_by("model_id", F.struct("created_at", "model_id")).alias("model_id"))
    return first.withColumn("status", F.lit("active"))


@query("champion_signals_orders")
def champions(spark, d):
    # unscored models have no rank; as a double, null reads alike in both engines
    return MO.champion_signals(models_registry(spark, d), promotions_registry(spark, d)).withColumn("rank", F.col("rank").cast("double"))


oracle("champion_signals_orders", f"""WITH m AS ({MODELS_SQL}),
s AS (SELECT * FROM m WHERE rank_score IS NOT NULL),
r AS (SELECT model_id, row_number() OVER (PARTITION BY target_column, problem_type, primary_metric ORDER BY rank_score DESC, created_at DESC, model_id DESC) AS rk FROM s),
c AS (SELECT target_column, problem_type, primary_metric, max(rank_score) AS champion_score, count(*) AS group_size,
    arg_max(model_id, (rank_score, created_at, model_id)) AS champion_id,
    arg_min(model_id, (created_at, model_id)) AS production_id FROM s GROUP BY 1, 2, 3)
SELECT m.model_id, m.target_column, m.problem_type, m.primary_metric, m.rank_score, CAST(rk AS DOUBLE) AS rank,
  CAST(coalesce(group_size, 0) AS BIGINT) AS group_size, champion_score, round(m.rank_score - champion_score, 4) AS delta_vs_champion,
  CASE WHEN rk IS NULL THEN 'unscored' WHEN m.model_id = production_id THEN 'production'
       WHEN m.model_id = champion_id THEN 'champion' ELSE 'challenger' END AS status
FROM m LEFT JOIN r ON r.model_id = m.model_id
LEFT JOIN c ON c.target_column = m.target_column AND c.problem_type = m.problem_type AND c.primary_metric = m.primary_metric""")


def _partly_promoted(spark, d):
    """Promotions of the classification groups alone."""
    return promotions_registry(spark, d).where("problem_type = 'classification'")


@query("champion_actions_orders")
def champion_actions(spark, d):
    models = models_registry(spark, d).withColumn("best_model", F.concat(F.lit("m"), F.col("model_id") % 5))
    return MO.champion_actions(models, _partly_promoted(spark, d)).select("model_id", "status", F.array_join("actions", "|").alias("actions"))


oracle("champion_actions_orders", f"""WITH m AS ({MODELS_SQL}), s AS (SELECT * FROM m WHERE rank_score IS NOT NULL),
c AS (SELECT target_column, problem_type, primary_metric, max(rank_score) AS top, arg_max(model_id, (rank_score, created_at, model_id)) AS champion,
   CASE WHEN problem_type = 'classification' THEN arg_min(model_id, (created_at, model_id)) END AS production FROM s GROUP BY 1, 2, 3),
j AS (SELECT m.*, champion, production, top - rank_score AS gap FROM m LEFT JOIN c USING (target_column, problem_type, primary_metric))
SELECT model_id, CASE WHEN rank_score IS NULL THEN 'unscored' WHEN model_id = production THEN 'production' WHEN model_id = champion THEN 'champion' ELSE 'challenger' END AS status,
  CASE WHEN champion IS NULL THEN 'Train another model with the same target to create a champion/challenger comparison.'
    WHEN model_id = production THEN 'This model is manually promoted to production. Keep monitoring drift, confidence, and alerts.|Retrain from drift when recent labeled data shows a stronger challenger.'
    WHEN model_id = champion THEN CASE WHEN production IS NULL THEN 'Promote this validated champion when it is ready for production traffic.|' ELSE '' END
      || 'Keep this model as champion while monitoring drift, confidence, and audit coverage.|Use retrain-from-drift when fresh labeled data becomes available.'
    WHEN rank_score IS NULL THEN 'Retrain or rerun this challenger so it has a comparable score.'
    WHEN gap <= 0.02 THEN 'This challenger is close to champion performance; validate it with batch scoring before promotion.|Compare drift and confidence on recent data before switching APIs.'
    ELSE 'Champion remains stronger by ' || regexp_replace(CAST(round(gap, 4) AS DECIMAL(38, 4))::VARCHAR, '(\\.\\d+?)0+$', '\\1') || ' ' || primary_metric || ' point(s).|Use the challenger as experiment evidence or retrain with richer labeled data.'
      || CASE WHEN production IS NULL THEN '' ELSE '|Production is currently assigned to m' || production % 5 || '.' END END AS actions FROM j""")


@query("challengers_orders")
def challengers(spark, d):
    return MO.challengers(champions(spark, d))


oracle("challengers_orders", f"SELECT * FROM ({ORACLES['champion_signals_orders']}) c WHERE rank BETWEEN 2 AND 9")


def snapshots_registry(spark, d):
    """One monitoring snapshot per event: score = value clipped to 0..100."""
    e = T(spark, d, "events")
    return e.select(F.col("event_id").alias("snapshot_id"), F.col("user_id").alias("model_id"),
                    F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("value"))).alias("score"), F.col("ts").alias("created_at"))


@query("snapshot_deltas_events")
def snapshot_deltas(spark, d):
    return MO.snapshot_deltas(snapshots_registry(spark, d))


oracle("snapshot_deltas_events", """WITH s AS (SELECT event_id AS snapshot_id, user_id AS model_id, least(100.0, greatest(0.0, value)) AS score, ts AS created_at FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY created_at DESC, snapshot_id DESC) AS rn, count(*) OVER (PARTITION BY model_id) AS n FROM s)
SELECT model_id, max(score) FILTER (WHERE rn = 1) AS latest_score, max(score) FILTER (WHERE rn = 2) AS previous_score,
  round(max(score) FILTER (WHERE rn = 1) - max(score) FILTER (WHERE rn = 2), 4) AS score_delta, CAST(max(n) AS BIGINT) AS snapshots
FROM r GROUP BY model_id""")


WEEK2 = "2024-01-15"


@query("alert_merge_events")
def alert_merge(spark, d):
    e = T(spark, d, "events")
    cut = F.lit(WEEK2).cast("timestamp")
    level = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "signup", "info").otherwise("warning")
    active = e.filter(F.col("ts") < cut).groupBy(F.col("user_id").alias("model_id"), F.col("event_type").alias("key")).agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("last_seen"), F.first(level).alias("level"))
    incoming = e.filter(F.col("ts") >= cut).groupBy(F.col("user_id").alias("model_id"), F.col("event_type").alias("key")).agg(
        F.max("ts").alias("seen_at"), F.first(level).alias("level"))
    merged = MO.merge_alerts(active, incoming, cut)
    return merged.groupBy("status", "level").agg(
        F.count(F.lit(1)).cast("long").alias("alerts"),
        F.count_distinct("model_id").cast("long").alias("models"),
        F.max("last_seen").alias("max_last_seen"),
        F.min("created_at").alias("min_created_at"),
        F.count(F.col("resolved_at")).cast("long").alias("resolved_rows"),
    )


oracle("alert_merge_events", f"""WITH e AS (SELECT *, CASE WHEN event_type = 'error' THEN 'critical' WHEN event_type = 'signup' THEN 'info' ELSE 'warning' END AS lvl FROM events),
a AS (SELECT user_id AS model_id, event_type AS key, min(ts) AS created_at, max(ts) AS last_seen, any_value(lvl) AS level FROM e WHERE ts < TIMESTAMP '{WEEK2}' GROUP BY 1, 2),
i AS (SELECT user_id AS model_id, event_type AS key, max(ts) AS seen_at, any_value(lvl) AS level FROM e WHERE ts >= TIMESTAMP '{WEEK2}' GROUP BY 1, 2),
m AS (SELECT coalesce(a.model_id, i.model_id) AS model_id, coalesce(i.level, a.level) AS level,
   CASE WHEN i.model_id IS NULL THEN 'resolved' ELSE 'active' END AS status, coalesce(a.created_at, i.seen_at) AS created_at,
   coalesce(i.seen_at, a.last_seen) AS last_seen, CASE WHEN i.model_id IS NULL THEN TIMESTAMP '{WEEK2}' END AS resolved_at
   FROM a FULL OUTER JOIN i ON a.model_id = i.model_id AND a.key = i.key)
SELECT status, level, CAST(count(*) AS BIGINT) AS alerts, CAST(count(DISTINCT model_id) AS BIGINT) AS models, max(last_seen) AS max_last_seen,
  min(created_at) AS min_created_at, CAST(count(resolved_at) AS BIGINT) AS resolved_rows FROM m GROUP BY 1, 2""")


@query("alert_rows_events")
def alert_rows(spark, d):
    """W6 row by row: alerts of the first week stored (signups already resolved), those of the second incoming."""
    e = T(spark, d, "events")
    cut = F.lit(WEEK2).cast("timestamp")
    stored = e.filter(F.col("ts") < cut).groupBy(F.col("user_id").alias("model_id"), F.col("event_type").alias("key")).agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("last_seen"), F.lit("warning").alias("level"), F.count(F.lit(1)).cast("string").alias("message"))
    resolved = F.col("key") == "signup"
    stored = stored.withColumn("status", F.when(resolved, "resolved").otherwise("active")).withColumn("resolved_at", F.when(resolved, F.col("last_seen")))
    incoming = e.filter((F.col("ts") >= cut) & (F.col("event_type") != "signup")).groupBy(F.col("user_id").alias("model_id"), F.col("event_type").alias("key")).agg(
        F.max("ts").alias("seen_at"), F.lit("critical").alias("level"))
    return MO.merge_alerts(stored, incoming, cut)


oracle("alert_rows_events", f"""WITH s AS (SELECT user_id AS model_id, event_type AS key, min(ts) AS created_at, max(ts) AS last_seen, CAST(count(*) AS VARCHAR) AS message
  FROM events WHERE ts < TIMESTAMP '{WEEK2}' GROUP BY 1, 2),
a AS (SELECT * FROM s WHERE key <> 'signup'),
i AS (SELECT user_id AS model_id, event_type AS key, max(ts) AS seen_at FROM events WHERE ts >= TIMESTAMP '{WEEK2}' AND event_type <> 'signup' GROUP BY 1, 2)
SELECT coalesce(a.model_id, i.model_id) AS model_id, coalesce(a.key, i.key) AS key, CASE WHEN i.model_id IS NULL THEN 'warning' ELSE 'critical' END AS level, message,
  CASE WHEN i.model_id IS NULL THEN 'resolved' ELSE 'active' END AS status, coalesce(a.created_at, i.seen_at) AS created_at, coalesce(i.seen_at, a.last_seen) AS last_seen,
  CASE WHEN i.model_id IS NULL THEN TIMESTAMP '{WEEK2}' END AS resolved_at
FROM a FULL OUTER JOIN i ON a.model_id = i.model_id AND a.key = i.key
UNION ALL SELECT model_id, key, 'warning', message, 'resolved', created_at, last_seen, last_seen FROM s WHERE key = 'signup'""")


def audits_registry(spark, d):
    """One prediction audit per event: rows scored from props."""
    e = T(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    conf = F.least(F.lit(1.0), F.col("value") / 100.0).cast("decimal(10,4)")
    return e.select(F.col("user_id").alias("model_id"), k.alias("row_count"),
                    F.when(conf < 0.55, k).otherwise(0).alias("low_confidence_rows"), conf.alias("average_confidence"),
                    F.col("ts").alias("created_at"))


@query("audit_summary_events")
def audit_summary(spark, d):
    return MO.audit_summary(audits_registry(spark, d))


oracle("audit_summary_events", f"""WITH a AS (SELECT user_id AS model_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS row_count,
   CAST(least(1.0, value / 100.0) AS DECIMAL(10, 4)) AS conf, ts FROM events)
SELECT model_id, CAST(count(*) AS BIGINT) AS audits, CAST(sum(row_count) AS BIGINT) AS rows_scored,
  CAST(sum(CASE WHEN conf < 0.55 THEN row_count ELSE 0 END) AS BIGINT) AS low_confidence_rows, {spark_round('avg(conf)', 4)} AS mean_confidence,
  max(ts) AS latest_audit FROM a GROUP BY 1""")


@query("alert_counts_events")
def alert_counts(spark, d):
    e = T(spark, d, "events")
    level = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "signup", "info").otherwise("warning")
    return MO.alert_counts(e.select(level.alias("level")))


oracle("alert_counts_events", """SELECT CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS critical,
  CAST(count(*) FILTER (WHERE event_type NOT IN ('error', 'signup')) AS BIGINT) AS warning,
  CAST(count(*) FILTER (WHERE event_type = 'signup') AS BIGINT) AS info FROM events""")


@query("registry_statistics_orders")
def registry_stats(spark, d):
    return MO.registry_statistics(models_registry(spark, d))


oracle("registry_statistics_orders", f"SELECT problem_type, CAST(count(*) AS BIGINT) AS models FROM ({MODELS_SQL}) m GROUP BY 1")


PROMOTED_AT = "2024-02-01 00:00:00"


ARCHIVED_AT = "2023-05-01 00:00:00"


def _keys_with_nulls(df):
    """Champion keys whose target and problem type are null for models of one clerk in three."""
    hide = F.col("model_id") % 3 == 0
    return df.withColumn("target_column", F.when(~hide, F.col("target_column"))).withColumn("problem_type", F.when(~hide, F.col("problem_type")))


@query("promotion_merge_orders")
def promotion_merge(spark, d):
    """Groups with null keys; besides the active promotion, each group has an older one that was archived."""
    m = _keys_with_nulls(models_registry(spark, d).filter(F.col("rank_score").isNotNull()))
    first = m.groupBy(*MO.CHAMPION_KEYS).agg(F.min_by("model_id", F.struct("created_at", "model_id")).alias("model_id"))
    none = F.lit(None).cast("timestamp")
    active = first.select("*", F.lit("active").alias("status"), none.alias("promoted_at"), none.alias("replaced_at"))
    archived = first.select(*MO.CHAMPION_KEYS, (F.col("model_id") + 1).alias("model_id"), F.lit("archived").alias("status"), none.alias("promoted_at"),
                            F.when(F.col("model_id") % 2 == 0, F.lit(ARCHIVED_AT).cast("timestamp")).alias("replaced_at"))
    latest = m.where(F.col("primary_metric").isNotNull()).groupBy(*MO.CHAMPION_KEYS).agg(F.max_by("model_id", F.struct("created_at", "model_id")).alias("model_id"))
    merged = MO.promote(active.unionByName(archived), latest.where(F.col("model_id") % 5 != 0), F.lit(PROMOTED_AT).cast("timestamp"))
    return merged.select(*MO.CHAMPION_KEYS, "model_id", "status", "promoted_at", "replaced_at")


oracle("promotion_merge_orders", f"""WITH m AS (SELECT CASE WHEN model_id % 3 <> 0 THEN target_column END AS target_column, CASE WHEN model_id % 3 <> 0 THEN problem_type END AS problem_type,
   primary_metric, model_id, created_at FROM ({MODELS_SQL}) x WHERE rank_score IS NOT NULL),
p AS (SELECT target_column, problem_type, primary_metric, arg_min(model_id, (created_at, model_id)) AS model_id FROM m GROUP BY 1, 2, 3),
i AS (SELECT * FROM (SELECT target_column, problem_type, primary_metric, arg_max(model_id, (created_at, model_id)) AS model_id FROM m GROUP BY 1, 2, 3) x WHERE model_id % 5 <> 0)
SELECT p.*, CASE WHEN i.model_id IS NULL THEN 'active' ELSE 'replaced' END AS status, NULL::TIMESTAMP AS promoted_at,
  CASE WHEN i.model_id IS NOT NULL THEN TIMESTAMP '{PROMOTED_AT}' END AS replaced_at
FROM p LEFT JOIN i ON (p.target_column, p.problem_type, p.primary_metric) IS NOT DISTINCT FROM (i.target_column, i.problem_type, i.primary_metric)
UNION ALL SELECT target_column, problem_type, primary_metric, model_id + 1, 'archived', NULL, CASE WHEN model_id % 2 = 0 THEN TIMESTAMP '{ARCHIVED_AT}' END FROM p
UNION ALL SELECT target_column, problem_type, primary_metric, model_id, 'active', TIMESTAMP '{PROMOTED_AT}', NULL FROM i""")


@query("best_model_per_dataset_orders")
def best_model(spark, d):
    """The best-scoring model of each dataset (newest on ties)."""
    return MO.best_model(models_registry(spark, d))


@query("best_model_for_target_orders")
def best_model_for_target(spark, d):
    """The best model of each customer for the churn target, or of all targets where it has none."""
    o = T(spark, d, "orders").select(F.col("o_orderkey").alias("model_id"), F.col("o_custkey").alias("customer"))
    return MO.best_model(models_registry(spark, d).join(o, "model_id"), "customer", "churn")


oracle("best_model_for_target_orders", f"""WITH m AS (SELECT x.*, o_custkey AS customer FROM ({MODELS_SQL}) x JOIN orders ON o_orderkey = model_id WHERE rank_score IS NOT NULL),
r AS (SELECT *, count(*) OVER (PARTITION BY customer) AS n, row_number() OVER (PARTITION BY customer ORDER BY target_column = 'churn' DESC, rank_score DESC, created_at DESC, model_id DESC) AS k FROM m)
SELECT customer, model_id, rank_score, CAST(n AS BIGINT) AS scored_models FROM r WHERE k = 1""")


@query("history_summary_orders")
def history_summary(spark, d):
    return MO.history_summary(MO.experiment_history(models_registry(spark, d)))


oracle("history_summary_orders", f"""WITH m AS ({MODELS_SQL}), r AS (SELECT *, round(rank_score - lag(rank_score) OVER (PARTITION BY dataset_id, target_column, problem_type, primary_metric ORDER BY created_at, model_id), 4) AS d FROM m)
SELECT CAST(count(*) AS BIGINT) AS runs, arg_max(model_id, (rank_score, created_at, model_id)) FILTER (rank_score IS NOT NULL) AS best_run, max(rank_score) AS best_score,
  arg_max(model_id, (created_at, model_id)) AS latest_run, CAST(count(*) FILTER (d > 0) AS BIGINT) AS improved_runs FROM r""")


oracle("best_model_per_dataset_orders", f"""SELECT dataset_id, arg_max(model_id, (rank_score, created_at, model_id)) AS model_id,
  max(rank_score) AS rank_score, CAST(count(*) AS BIGINT) AS scored_models FROM ({MODELS_SQL}) m WHERE rank_score IS NOT NULL GROUP BY 1""")


@query("snapshot_retention_events")
def snapshot_retention(spark, d):
    """The newest 40 snapshots of every model by the day; among those of a day, by id."""
    from tabsmith.sources.io import retained

    daily = T(spark, d, "events").select(F.col("user_id").alias("model_id"), F.col("event_id").alias("snapshot_id"), F.date_trunc("day", "ts").alias("created_at"))
    kept = retained(daily, 40, order_col="created_at", key="model_id", id_col="snapshot_id")
    return kept.groupBy("model_id").agg(F.count(F.lit(1)).cast("long").alias("kept"), F.min("created_at").alias("oldest_kept"), F.sum("snapshot_id").cast("long").alias("ids"))


oracle("snapshot_retention_events", """WITH r AS (SELECT user_id AS model_id, event_id, date_trunc('day', ts)::TIMESTAMP AS ts,
  row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts) DESC, event_id DESC) AS rn FROM events)
SELECT model_id, CAST(count(*) AS BIGINT) AS kept, min(ts) AS oldest_kept, CAST(sum(event_id) AS BIGINT) AS ids FROM r WHERE rn <= 40 GROUP BY 1""")
