"""Conversation prefix trie (operator 13): whole-sequence collapse.

Conversations are rebuilt from shared heads (``rebuild``), then ``prefix_trie`` builds the trie of their turn
sequences without ever walking it:

1. A turn is known by 128 bits of its role and text, a sequence by sums, over its turns, of 40-bit hashes of
   place and turn. Identical conversations are grouped by the sums into weighted sequences, each with its
   smallest member and the list of members that end there. From here on only one conversation a sequence counts.
2. Running sums along each distinct sequence name its prefixes: a node is a (depth, sums).
3. Sequences that are a proper prefix of another drop out by an anti-join with the prefixes; the rest are leaves.
4. One aggregate over (sequence x prefix) rows gives members, smallest member, leaves and last text of each node.
5. Subtree sums need no (node x ancestor) rows: each node lends its own tokens to the smallest leaf below it.
   A node's subtree holds all that its leaves were lent, but for what ancestors lent to its smallest leaf, which
   is a running sum along that leaf.

Work and shuffles are linear in the turns. Long conversations: numbers and running sums are taken in pieces
of a range partitioning, to which the totals of earlier pieces are added. A sequence's list of ends is hashed as a
stream over chunks of sorted ids; that hash is sequential by its definition, its memory is not bound to the list.

Edge cases: rows without conv_id belong to no conversation; null role and text are empty; turns equal in number
come in the order of role and text, repeated rows count each; conversations that are rebuilt without a turn are
members of the root alone; an empty table gives no node; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.llm.common import written

SUMS = ("s1", "s2", "s3")
#: Ids that one piece of a list of ends holds.
CHUNK = 4096


@dataclass(frozen=True)
class Heads:
    """Conversation c takes its first crc32(c) mod ``lengths`` turns from c - c mod ``every``."""

    every: int = 100
    lengths: int = 6

    def length(self, conv: Column) -> Column:
        return (F.crc32(conv.cast("string").cast("binary")) % self.lengths).cast("long")

    def base(self, conv: Column) -> Column:
        return conv - conv % self.every


def running_sums(df: DataFrame, group: str, order: list[Column], columns: dict[str, Column]) -> DataFrame:
    """Adds inclusive running sums (name -> summand) along ``order`` in each group, hot groups in pieces.

    A range partitioning cuts groups into pieces, each piece is summed for itself, and the totals of earlier pieces are
    added. Only groups that lie in several pieces need it: two rows a partition at most, hence the broadcast.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, F.col(group), *order).withColumns({f"__{c}": x for c, x in columns.items()} | {"__piece": F.spark_partition_id()})
    ranged = written(ranged, "pieces")
    here = Window.partitionBy("__piece", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(F.col(group).alias("__g"), F.col("__piece").alias("__p")).agg(*[F.sum(f"__{c}").alias(f"__{c}_total") for c in columns])
    parts = totals.withColumns({"__parts": F.count("*").over(Window.partitionBy("__g"))} | {f"__{c}_before": F.sum(f"__{c}_total").over(before) for c in columns})
    parts = parts.where("__parts > 1").select("__g", "__p", *[f"__{c}_before" for c in columns])
    summed = ranged.withColumns({c: F.sum(f"__{c}").over(here) for c in columns})
    joined = summed.join(F.broadcast(parts), (F.col(group) == F.col("__g")) & (F.col("__piece") == F.col("__p")), "left")
    joined = joined.withColumns({c: F.col(c) + F.coalesce(F.col(f"__{c}_before"), F.lit(0)) for c in columns})
    return joined.select(*df.columns, *columns)


def rebuild(conversations: DataFrame, heads: Heads = Heads()) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv, place, d1, d2, chars) and all conversations (conv, length), turnless ones too."""
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    known = running_sums(turns, "conv", order, {"i": F.lit(1).cast("long")}).select(
        "conv", "i", F.xxhash64(F.lit(1), "role", "text").alias("d1"), F.xxhash64(F.lit(2), "role", "text").alias("d2"), F.char_length("text").cast("long").alias("chars"),
    )
    known = written(known, "turns")
    size = known.groupBy("conv").agg(F.count("*").alias("size"))
    head = (
        known.where((F.col("conv") == heads.base(F.col("conv"))) & (F.col("i") < heads.lengths))
        .groupBy(F.col("conv").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("i", "d1", "d2", "chars"))).alias("head"))  # lengths - 1 turns at most
    )
    length = heads.length(F.col("conv"))
    convs = (
        size.withColumns({"base": heads.base(F.col("conv")), "own_from": length})
        .join(head, "base", "left")
        .select("conv", "own_from", "size", F.filter(F.coalesce("head", F.array()), lambda t: t.i <= F.col("own_from")).alias("head"))
        .withColumn("lent", F.size("head").cast("long"))
    )
    convs = written(convs, "conversations")
    first = convs.select("conv", F.inline("head")).select("conv", F.col("i").alias("place"), "d1", "d2", "chars")
    own = known.where(F.col("i") > length).join(convs.select("conv", "own_from", "lent"), "conv")
    rest = own.select("conv", (F.col("lent") + F.col("i") - F.col("own_from")).alias("place"), "d1", "d2", "chars")
    lengths = convs.select("conv", (F.col("lent") + F.greatest(F.col("size") - F.col("own_from"), F.lit(0))).alias("length"))
    return first.unionByName(rest), lengths


def _place_hashes() -> dict[str, Column]:
    """Three 40-bit numbers a turn and place; a sum of 2**23 of them still fits a long."""
    return {s: F.shiftrightunsigned(F.xxhash64(F.lit(k), "place", "d1", "d2"), 24) for k, s in enumerate(SUMS)}


def sequences(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct sequences (seq: smallest member, length, sums, weight) and their members (seq, conv)."""
    sums = turns.groupBy("conv").agg(*[F.sum(x).alias(s) for s, x in _place_hashes().items()])
    named = written(convs.join(sums, "conv", "left").select("conv", "length", *[F.coalesce(s, F.lit(0)).alias(s) for s in SUMS]), "sequences")
    found = named.groupBy("length", *SUMS).agg(F.min("conv").alias("seq"), F.count("*").alias("weight"))
    return found, named.join(found.drop("weight"), ["length", *SUMS]).select("seq", "conv")


def end_hashes(members: DataFrame) -> DataFrame:
    """seq and the sha256 of its members' ids, ascending, joined by commas."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, conv = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("seq", "conv"))
            turn = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]])) if len(seq) else np.zeros(0, int)
            cuts = sorted({*turn.tolist(), *range(0, len(seq), CHUNK), len(seq)})
            spans = [(a, b) for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_pydict({
                "seq": pa.array([seq[a] for a, _ in spans], pa.int64()), "at": pa.array([conv[a] for a, _ in spans], pa.int64()),
                "ids": pa.array([",".join(map(str, conv[a:b].tolist())) for a, b in spans], pa.string()),
            })

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            seqs, digests = [], []
            for seq, ids in zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist()):
                if seq != now:
                    if state is not None:
                        seqs.append(now)
                        digests.append(state.hexdigest())
                    now, state = seq, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict({"seq": pa.array(seqs, pa.int64()), "ends_sha256": pa.array(digests, pa.string())})
        if state is not None:
            yield pa.RecordBatch.from_pydict({"seq": pa.array([now], pa.int64()), "ends_sha256": pa.array([state.hexdigest()], pa.string())})

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = members.repartitionByRange(n, "seq", "conv").sortWithinPartitions("seq", "conv").mapInArrow(chunks, "seq long, at long, ids string")
    return pieces.repartition("seq").sortWithinPartitions("seq", "at").mapInArrow(hashed, "seq long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of ``rebuild``'s conversations, see the module's text."""
    found, members = sequences(turns, convs)
    seqs = written(found, "weighted")
    own = turns.join(seqs.select(F.col("seq").alias("conv")), "conv")
    hashes = _place_hashes()
    prefixes = running_sums(own.withColumns({f"g{s}": x for s, x in hashes.items()}), "conv", [F.col("place")], {s: F.col(f"g{s}") for s in SUMS})
    prefixes = prefixes.select(
        F.col("conv").alias("seq"), F.col("place").alias("depth"), *SUMS, *[(F.col(s) - F.col(f"g{s}")).alias(f"up{s}") for s in SUMS], "chars",
    )
    zero = F.lit(0).cast("long")
    root = seqs.select("seq", zero.alias("depth"), *[zero.alias(s) for s in SUMS], *[zero.alias(f"up{s}") for s in SUMS], zero.alias("chars"))
    prefixes = written(prefixes.unionByName(root), "prefixes")

    node, up = ["depth", *SUMS], [f"up{s}" for s in SUMS]
    proper = prefixes.join(seqs.select("seq", "length"), "seq").where(F.col("depth") < F.col("length")).select(F.col("depth").alias("length"), *SUMS).distinct()
    leaves = seqs.join(proper, ["length", *SUMS], "left_anti").select("seq", F.lit(1).alias("leaf"))
    weighted = written(seqs.select("seq", "length", "weight").join(leaves, "seq", "left"), "leaves")
    rows = prefixes.join(weighted, "seq")
    nodes = rows.groupBy(*node).agg(
        F.min("seq").alias("conv_id"), F.sum("weight").alias("n_convs"), F.count("leaf").alias("n_leaves"),
        F.min(F.when(F.col("leaf").isNotNull(), F.col("seq"))).alias("heir"), F.max("chars").alias("chars"),
        F.min(F.when(F.col("length") == F.col("depth"), F.col("seq"))).alias("ending"), *[F.max(u).alias(u) for u in up],
    )
    lent = running_sums(nodes.withColumn("tokens", (F.col("n_convs") - 1) * F.col("chars")), "heir", [F.col("depth")], {"lent": F.col("tokens")})
    lent = written(lent, "nodes")

    given = lent.groupBy(F.col("heir").alias("seq")).agg(F.sum("tokens").alias("given"))
    below = prefixes.join(given, "seq").groupBy(*node).agg(F.sum("given").alias("below"))  # given has the leaves alone
    children = lent.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *[F.col(u).alias(s) for u, s in zip(up, SUMS)]).agg(F.count("*").alias("n_children"))
    parents = lent.select((F.col("depth") + 1).alias("depth"), *[F.col(s).alias(u) for s, u in zip(SUMS, up)], F.col("conv_id").alias("parent_conv_id"))
    ends = end_hashes(members).withColumnRenamed("seq", "ending")
    out = lent.join(below, node).join(children, node, "left").join(parents, ["depth", *up], "left").join(ends, "ending", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves",
        (F.col("below") - (F.col("lent") - F.col("tokens"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
