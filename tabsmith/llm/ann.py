"""Approximate nearest neighbours by inner product (operator 2): a forest of random-projection trees.

* Rows with equal vectors form a class, searched once; a class stands for its ``k + 1`` least ids, which is all
  that a list of k neighbours can hold of it. So copies cost nothing and hot vectors have no hot leaf.
* Vectors get one coordinate more, sqrt(M^2 - |x|^2) with M the largest norm (0 in a query): then the order by
  inner product is the order by distance, and hyperplanes separate it.
* A tree has one random direction a level (of a few, the one along which the sample spreads most) and a median
  threshold a node. Directions and thresholds come from a bounded sample; every row is filed in every tree.
* A query walks all trees through one shared priority queue: the pending branch with the least sum of squared
  distances to the hyperplanes that it is on the wrong side of comes next, in whatever tree. It visits as many
  leaves as ``CHECKED`` sample queries, held against all rows in blocks, need for a recall of ``RECALL``.
* Each visited leaf is scored exactly, in double precision, in the task that holds the leaf (in blocks of
  ``BLOCK`` rows), which returns its best classes; the best of all leaves are expanded to ids.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
without id; of several lengths the most frequent counts (ties: the shorter). Rows equal in id and vector count
once; a query's neighbours never have its id. Fewer than k candidates give fewer rows. An empty table gives none.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.llm.common import bounded_sample, small_batches, written

TREES = 16
LEAF = 512
SAMPLE = 16_384
CHOICES = 8
CHECKED = 64
RECALL = 0.96
BLOCK = 4096
#: Queries whose results a task merges at a time.
MERGED = 256


def prepared(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id, cid (digest of the vector), vec (doubles, packed), dim, norm2 of the rows that take part."""
    source = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column("vec_id").to_pylist(), {"vec_id": [], "cid": [], "vec": [], "dim": [], "norm2": []}
            for i, value in zip(ids, batch.column("v")):
                if i is None or not value.is_valid or value.values.null_count:
                    continue
                x = value.values.to_numpy(zero_copy_only=False) + 0.0  # -0.0 is 0.0
                norm2 = float(x @ x)
                if norm2 > 0 and np.isfinite(x).all():
                    packed = x.astype("<f8").tobytes()
                    for name, got in zip(out, (i, hashlib.blake2b(packed, digest_size=16).digest(), packed, len(x), norm2)):
                        out[name].append(got)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("vec_id", pa.int64()), ("cid", pa.binary()), ("vec", pa.binary()), ("dim", pa.int32()), ("norm2", pa.float64())]))

    return source.mapInArrow(run, "vec_id long, cid binary, vec binary, dim int, norm2 double")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)


class Forest:
    def __init__(self, sample: np.ndarray, rows: int, norm: float, seed: int = 3):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.norm = norm
        deepest = int(np.log2(max(1, len(sample) // 4)))
        self.depth = int(min(max(0, np.ceil(np.log2(max(1, rows / LEAF)))), deepest))
        points = self.lift(sample)
        self.directions, self.thresholds = [], []
        for _ in range(TREES):
            node, directions, thresholds = np.zeros(len(points), np.int64), [], []
            for level in range(self.depth):
                choice = rng.normal(size=(CHOICES, points.shape[1]))
                choice /= np.linalg.norm(choice, axis=1, keepdims=True)
                best = choice[(points @ choice.T).std(axis=0).argmax()]
                at = points @ best
                cut = np.array([np.median(at[node == k]) if (node == k).any() else 0.0 for k in range(1 << level)])
                node = 2 * node + (at > cut[node])
                directions.append(best)
                thresholds.append(cut)
            self.directions.append(np.array(directions).reshape(self.depth, points.shape[1]))
            self.thresholds.append(thresholds)

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm - (x * x).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree (rows x trees)."""
        points, out = self.lift(x), np.zeros((len(x), TREES), np.int64)
        for t in range(TREES):
            at, node = points @ self.directions[t].T, np.zeros(len(x), np.int64)
            for level in range(self.depth):
                node = 2 * node + (at[:, level] > self.thresholds[t][level][node])
            out[:, t] = node
        return out

    def offsets(self, q: np.ndarray) -> list[np.ndarray]:
        return [self.directions[t][:, :-1] @ q for t in range(TREES)]

    def visit(self, q: np.ndarray, n: int) -> list[tuple[int, int]]:
        """The first ``n`` leaves (tree, leaf) that the shared queue yields."""
        at = self.offsets(q)
        queue = [(0.0, t, 0, 0) for t in range(TREES)]
        found = []
        while queue and len(found) < n:
            cost, t, level, node = heapq.heappop(queue)
            while level < self.depth:
                margin = at[t][level] - self.thresholds[t][level][node]
                side = int(margin > 0)
                level += 1
                heapq.heappush(queue, (cost + margin * margin, t, level, 2 * node + 1 - side))
                node = 2 * node + side
            found.append((t, node))
        return found

    def ranks(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """For each row of x the number of leaves a query must visit to meet it."""
        costs = []
        for t, at in enumerate(self.offsets(q)):
            cost = np.zeros(1)
            for level in range(self.depth):
                margin = at[level] - self.thresholds[t][level]
                cost = np.stack([cost + np.where(margin > 0, margin**2, 0), cost + np.where(margin > 0, 0, margin**2)], axis=1).ravel()
            costs.append(cost)
        order = np.argsort(np.argsort(np.concatenate(costs), kind="stable")) + 1
        first = np.arange(TREES) << self.depth
        return order[self.leaves(x) + first].min(axis=1)


def _top(scores: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of one row of scores; ties go to the smaller least id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        pick = np.flatnonzero(scores >= cut)
    else:
        pick = np.arange(len(scores))
    return pick[np.lexsort((least[pick], -scores[pick]))][:k]


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.einsum("qd,xd->qx", q, x, optimize=False)


def checked_visits(classes: DataFrame, queries: DataFrame, forest: Forest, k: int) -> int:
    """Leaves to visit for ``RECALL`` on ``CHECKED`` queries, whose true neighbours all rows are searched for."""
    own = bounded_sample(queries, CHECKED, 31, ["cid"]).select("cid", "vec").toPandas().sort_values("cid")
    q = matrix(pa.array(own["vec"].tolist(), pa.binary()))
    held = classes.sparkSession.sparkContext.broadcast(q)  # CHECKED vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("vec"))
            scores = held.value @ x.T
            for i, row in enumerate(scores):
                pick = np.argsort(-row, kind="stable")[: k + 1]
                yield pa.RecordBatch.from_pydict({"q": pa.array([i] * len(pick), pa.int32()), "score": row[pick], "vec": batch.column("vec").take(pa.array(pick))})

    near = classes.select("vec").mapInArrow(run, "q int, score double, vec binary")
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec"))).where(F.col("r") <= k + 1)
    best = best.toPandas()  # CHECKED * (k + 1) vectors
    need = []
    for i, group in best.groupby("q"):
        rows = group.sort_values("r")
        rows = rows[rows["vec"] != q[i].astype("<f8").tobytes()][:k]
        if len(rows):
            need.append(forest.ranks(q[i], matrix(pa.array(rows["vec"].tolist(), pa.binary()))))
    if not need:
        return TREES
    need = np.sort(np.concatenate(need))
    return int(max(TREES, need[min(len(need) - 1, int(np.ceil(RECALL * len(need))) - 1)]))


def nearest(table: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` nearest found of each query row.

    ``is_query`` is a condition on the column ``vec_id``.
    """
    small_batches(table)
    spark = table.sparkSession
    rows = written(prepared(table, id_column, vector_column), "vectors")
    lengths = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.col("dim") == lengths["dim"]).dropDuplicates(["vec_id", "cid"])
    place = F.row_number().over(Window.partitionBy("cid").orderBy("vec_id"))
    few = rows.withColumn("r", place).where(F.col("r") <= k + 1)
    classes = few.groupBy("cid").agg(F.first("vec").alias("vec"), F.max("norm2").alias("norm2"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = written(classes, "classes")
    n, norm = classes.agg(F.count("cid"), F.max("norm2")).first()
    asking = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "cid")
    queries = written(classes.join(asking.select("cid").distinct(), "cid").select("cid", "vec"), "queries")
    sample = bounded_sample(classes.select("cid", "vec"), SAMPLE, 13, ["cid"]).select("vec").toArrow()
    forest = Forest(matrix(sample["vec"]), n, norm)
    visits = checked_visits(classes, queries, forest, k)
    blocks = max(1, -(-n // (BLOCK << forest.depth)))
    held = spark.sparkContext.broadcast(forest)  # bounded by SAMPLE

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = held.value.leaves(matrix(batch.column("vec")))
                block = np.array([int.from_bytes(c[:7], "little") % blocks for c in batch.column("cid").to_pylist()], np.int32)
                for t in range(TREES):
                    yield pa.RecordBatch.from_pydict({
                        "tree": pa.array(np.full(batch.num_rows, t, np.int32)), "leaf": leaf[:, t], "block": block,
                        "cid": batch.column("cid"), "least": batch.column("least"), "vec": batch.column("vec"),
                    })

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, q in enumerate(matrix(batch.column("vec")) if batch.num_rows else []):
                seen = held.value.visit(q, visits)
                take = pa.array(np.full(len(seen), i))
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array([t for t, _ in seen], pa.int32()), "leaf": pa.array([x for _, x in seen], pa.int64()),
                    "qid": batch.column("cid").take(take), "vec": batch.column("vec").take(take),
                })

    def score(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict = {"qid": [], "cids": [], "scores": [], "leasts": []}
        if left.num_rows and right.num_rows:
            least, cids = right["least"].to_numpy(), right["cid"].to_pylist()
            x = matrix(right["vec"])
            for at in range(0, left.num_rows, 256):
                part = left.slice(at, 256)
                for qid, row in zip(part["qid"].to_pylist(), _products(matrix(part["vec"]), x)):
                    best = _top(row, least, k + 1)
                    out["qid"].append(qid)
                    out["cids"].append([cids[j] for j in best])
                    out["scores"].append(row[best])
                    out["leasts"].append(least[best])
        kinds = {"qid": pa.binary(), "cids": pa.list_(pa.binary()), "scores": pa.list_(pa.float64()), "leasts": pa.list_(pa.int64())}
        return pa.table({name: pa.array(out[name], kind) for name, kind in kinds.items()})

    def merge(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best classes of each query over all leaves that it visited; a class met in several trees counts once."""
        best: dict = {}
        for batch in parts:
            for row in batch.select(["qid", "cids", "scores", "leasts"]).to_pylist():
                mine = best.setdefault(row["qid"], {})
                mine.update(zip(row["cids"], zip((-x for x in row["scores"]), row["leasts"])))
                if len(mine) > 50 * k:
                    best[row["qid"]] = dict(sorted(mine.items(), key=lambda x: (x[1], x[0]))[: k + 1])
        for qid, mine in best.items():
            top = sorted(mine.items(), key=lambda x: (x[1], x[0]))[: k + 1]
            yield pa.RecordBatch.from_pydict({
                "qid": pa.array([qid] * len(top), pa.binary()), "cid": pa.array([c for c, _ in top], pa.binary()), "score": pa.array([-x[0] for _, x in top], pa.float64()),
            })

    filed = classes.select("cid", F.element_at("ids", 1).alias("least"), "vec").mapInArrow(file, "tree int, leaf long, block int, cid binary, least long, vec binary")
    wanted = queries.mapInArrow(walk, "tree int, leaf long, qid binary, vec binary").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pair = wanted.groupBy("tree", "leaf", "block").cogroup(filed.groupBy("tree", "leaf", "block"))
    found = pair.applyInArrow(score, "qid binary, cids array<binary>, scores array<double>, leasts array<long>")
    groups = max(1, -(-queries.count() // MERGED))
    found = found.withColumn("group", F.pmod(F.xxhash64("qid"), F.lit(groups)))
    near = found.groupBy("group").applyInArrow(merge, "qid binary, cid binary, score double")
    near = near.join(classes.select("cid", "ids"), "cid").groupBy("qid").agg(
        F.sort_array(F.flatten(F.collect_list(F.transform("ids", lambda v: F.struct((-F.col("score")).alias("minus"), v.alias("vec_id")))))).alias("near")
    )
    pairs = asking.join(near.withColumnRenamed("qid", "cid"), "cid")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = pairs.select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))
