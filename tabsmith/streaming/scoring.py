"""Scoring a stream with the batch model (optional extension of M27/M28).

Each micro-batch is scored with the same ``PipelineModel`` transform and two
sinks are written from ``foreachBatch``: the scored rows and one audit row per
batch (rows, low-confidence rows, mean confidence). The checkpoint lives in the
shared folder named by ``spark.checkpoint.dir``; a replayed batch overwrites the
folder of its batch id, so every batch counts once.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.plans.train import predict_with_confidence
from tabsmith.session import ensure_checkpoint_dir


def start_stream_scoring(stream: DataFrame, model: PipelineModel, model_id: str, scored_path: str, audit_path: str,
                         prepare=None, trigger_once: bool = False):
    spark = stream.sparkSession
    ckpt = ensure_checkpoint_dir(spark).rstrip("/") + f"/stream-scoring-{model_id}"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # a replayed batch overwrites its own folders, so it leaves its rows and its audit once
        rows = prepare(batch) if prepare else batch
        scored = predict_with_confidence(model, rows).drop("features", "rawPrediction", "probability", "probabilities")
        scored = scored.select(*[F.col(f"`{c}`") for c in scored.columns if not c.startswith("__") and c != "batch_id"]).persist()
        scored.write.mode("overwrite").parquet(f"{scored_path}/batch_id={batch_id}")
        audit = scored.agg(
            F.lit(model_id).alias("model_id"), F.count(F.lit(1)).cast("long").alias("row_count"),
            F.count(F.when(F.col("low_confidence"), 1)).cast("long").alias("low_confidence_rows"),
            F.round(F.avg("confidence"), 4).alias("average_confidence"), F.current_timestamp().alias("created_at"),
        )
        audit.write.mode("overwrite").parquet(f"{audit_path}/batch_id={batch_id}")
        scored.unpersist()

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", ckpt)
    writer = writer.trigger(availableNow=True) if trigger_once else writer
    return writer.start()
