"""Order statistics that never funnel one group into a single task.

A plain ``row_number().over(Window.partitionBy(k).orderBy(o))`` sorts every row of
a key inside one task; with a key that holds a third of the table that task is
the whole job. The helpers below instead

* range-partition on ``(group, order)`` so one hot group is cut across many
  tasks (the range partitioner samples the key distribution),
* number or sum rows locally inside each ``(partition, group)`` piece, whose
  size is bounded by a range partition,
* add the running totals of the earlier pieces of the same group. The piece
  table has at most ``partitions + groups`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ColumnLike = str | Column


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_sum(
    df: DataFrame,
    group_cols: Sequence[str],
    order: Sequence[ColumnLike],
    weight: ColumnLike | None = None,
    out: str = "running_total",
    partitions: int | None = None,
    keep: Sequence[str] | None = None,
    few_groups: bool = False,
) -> DataFrame:
    """Inclusive running sum of ``weight`` (1 per row when None) within each group.

    ``order`` must be a total order inside a group (add a unique tie-break),
    otherwise ties are numbered arbitrarily, as with ``row_number``. ``keep``: the columns that are
    held beside the groups and ``out``, if not all. ``few_groups``: the number of groups is bounded (columns,
    repeats), so the piece totals are broadcast and the rows move once.
    """
    groups = list(group_cols)
    order_cols = [_col(o) for o in order]
    weighted = df.withColumn("_w", F.lit(1).cast("long") if weight is None else _col(weight))
    sort_keys = [F.col(g).asc_nulls_first() for g in groups] + order_cols
    ranged = weighted.repartitionByRange(_partitions(df, partitions), *sort_keys).withColumn(
        "_pid", F.spark_partition_id()
    )
    piece_window = (
        Window.partitionBy("_pid", *groups)
        .orderBy(*order_cols)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # Both branches below must see the same partition ids (one range exchange,
    # one AQE read layout), so the numbered pieces are persisted once and both
    # the row side and the piece totals are read from those blocks. Lost blocks
    # are recomputed through the same shuffle dependency, hence the same ids.
    # Rows of weight 1 are counted by their place in the sorted partition: a window would move them once more.
    local = ranged.sortWithinPartitions(*sort_keys).withColumn("_local", F.monotonically_increasing_id()) if weight is None else ranged.withColumn("_local", F.sum("_w").over(piece_window))
    if keep is not None:
        local = local.select(*dict.fromkeys([*groups, *keep]), "_w", "_pid", "_local")
    local = local.persist(StorageLevel.MEMORY_AND_DISK)

    first = F.min("_local") - 1 if weight is None else F.lit(0)
    pieces = local.groupBy("_pid", *groups).agg((F.max("_local") - first).alias("_piece"), first.alias("_first"))
    earlier = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    renamed = [f"_og{i}" for i in range(len(groups))]
    offsets = pieces.select(
        F.col("_pid").alias("_opid"),
        *[F.col(g).alias(r) for g, r in zip(groups, renamed)],
        (F.coalesce(F.sum("_piece").over(earlier), F.lit(0)) - F.col("_first")).alias("_offset"),
    )
    # distinct names on both sides: the two frames share lineage (self-join)
    cond = [F.col("_pid") == F.col("_opid")] + [F.col(g).eqNullSafe(F.col(r)) for g, r in zip(groups, renamed)]
    joined = local.join(F.broadcast(offsets) if few_groups else offsets, cond, "inner").drop("_opid", *renamed)
    return joined.withColumn(out, F.col("_local") + F.col("_offset")).drop("_w", "_pid", "_local", "_offset")


def row_number_within(
    df: DataFrame,
    group_cols: Sequence[str],
    order: Sequence[ColumnLike],
    out: str = "row_number",
    partitions: int | None = None,
    keep: Sequence[str] | None = None,
    few_groups: bool = False,
) -> DataFrame:
    """1-based ``row_number()`` per group, skew-safe (see module docstring)."""
    return running_sum(df, group_cols, order, None, out, partitions, keep, few_groups)


def top_k_within(
    df: DataFrame,
    group_cols: Sequence[str],
    order: Sequence[ColumnLike],
    k: int,
    salt_of: ColumnLike,
    out: str = "rank",
    salt_buckets: int | None = None,
) -> DataFrame:
    """Exact top ``k`` rows per group, ranked 1..k.

    Each group is first split into ``salt_buckets`` sub-groups by a hash of
    ``salt_of``; the top ``k`` of every sub-group are kept (a window over a
    bounded slice), then the at most ``k * buckets`` survivors per group are
    ranked once more. A hot group therefore never sorts in one task.
    """
    groups = list(group_cols)
    order_cols = [_col(o) for o in order]
    buckets = salt_buckets or _partitions(df, None)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(_col(salt_of)), F.lit(buckets)))
    first = salted.withColumn(
        "_r1", F.row_number().over(Window.partitionBy(*groups, "_salt").orderBy(*order_cols))
    ).filter(F.col("_r1") <= k)
    ranked = first.withColumn(out, F.row_number().over(Window.partitionBy(*groups).orderBy(*order_cols)))
    return ranked.filter(F.col(out) <= k).drop("_salt", "_r1")
