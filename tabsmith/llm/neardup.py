"""MinHash near-duplicates (operator 7), verified by odd sketches and then on the full shingle sets.

1. Every document's set of word shingles (64-bit hashes) gives its size, a 128-bit digest, MinHash samples,
   band keys, and an odd sketch: the samples folded into a parity bitmap. Documents with equal sets form one
   class at once; only classes are compared from here on.
2. Classes that share a band key meet in a bucket. Each is held against the bucket's leader, its least class:
   never all pairs. The population count of the XOR of two odd sketches estimates the similarity; what is
   clearly below the threshold goes, the rest is confirmed on the full sets. Confirmed links give components.
3. Buckets that still hold several components are compared in full, in blocks: each class outside the
   leader's component against every class of another component, on the full sets where the sketches leave a
   doubt. So a link is lost only if its two classes share no band key, a chance of at most ``MISS`` at the
   threshold and less above it. Only links that join components leave a block, never all pairs.

Edge cases: a text with 1 to n - 1 words is one shingle; null, empty and blank texts have an empty set and
link with nothing; a null id is no label: its component is the least id of the others, null if there is none,
and it is never kept. Rows with one id and several texts each take the component of their own text. An empty
table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import pieces, small_batches, utf8, written
from tabsmith.llm.components import components
from tabsmith.llm.words import mix, shingles, word_hashes

MISS = 1e-5
BAND_ROWS = 5
#: 64-bit words of the odd sketch.
SKETCH = 8
#: Rows of a bucket that a task holds against as many others at a time.
BLOCK = 2048


@dataclass(frozen=True)
class Rule:
    """Words of a shingle, and the similarity from which documents link: num / den at least."""

    words: int = 5
    num: int = 80
    den: int = 100

    @property
    def threshold(self) -> float:
        return self.num / self.den

    @property
    def bands(self) -> int:
        return math.ceil(math.log(MISS) / math.log(1 - self.threshold**BAND_ROWS))

    @property
    def samples(self) -> int:
        return self.bands * BAND_ROWS

    @property
    def sketch_flips(self) -> int:
        """Differing sketch bits up to which a pair stays a candidate: five standard deviations of slack."""
        t, k, bits = self.threshold, self.samples, SKETCH * 64
        least = t - 5 * math.sqrt(t * (1 - t) / k)
        differing = 2 * k * (1 - least)
        expected = bits / 2 * (1 - math.exp(-2 * differing / bits))
        return math.ceil(expected + 5 * math.sqrt(expected))


def sets_of(text: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, end to end, and the texts' bounds."""
    hashes, rows = shingles(*word_hashes(*utf8(text)), words)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[first], np.searchsorted(row[first], np.arange(len(rows)))


def signature(hashes: np.ndarray, bounds: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x bands) and odd sketches (texts x SKETCH) of sets that aren't empty."""
    rng = np.random.Generator(np.random.PCG64(41))
    odd = rng.integers(0, 1 << 63, rule.samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salt = rng.integers(0, 1 << 63, rule.samples, dtype=np.uint64)
    n = len(bounds) - 1
    keys, sketch = np.zeros((n, rule.bands), np.uint64), np.zeros((n, SKETCH), np.uint64)
    rows, bits = np.arange(n), np.uint64(SKETCH * 64)
    for i in range(rule.samples):
        least = np.minimum.reduceat(hashes * odd[i], bounds[:-1])
        band = i // BAND_ROWS
        keys[:, band] = mix(keys[:, band] ^ (least + np.uint64(band + 1)))
        bit = mix(least + salt[i]) % bits
        sketch[rows, (bit >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (bit & np.uint64(63))
    return keys, sketch


def _long_lists(values: np.ndarray) -> pa.Array:
    """An n x k matrix of 64-bit words as lists of k longs."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.astype("<u8").view("<i8").ravel()))


def describe(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, text_key, n_shingles, cls (the set's digest; null if empty), bands and sketch of each document."""
    source = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            hashes, bounds = sets_of(part.column("text"), rule.words)
            size = np.diff(bounds)
            full = np.flatnonzero(size)
            cls = np.full(len(size), None, object)
            keys, sketch = np.zeros((len(size), rule.bands), np.uint64), np.zeros((len(size), SKETCH), np.uint64)
            if len(full):
                own = np.append(bounds[:-1][full], bounds[-1])
                digest = np.stack([np.add.reduceat(mix(hashes + np.uint64(salt)), own[:-1]) for salt in (7, 11)], axis=1)
                cls[full] = [d.tobytes() for d in digest]
                keys[full], sketch[full] = signature(hashes, own, rule)
            yield pa.RecordBatch.from_pydict({
                "doc_id": part.column("doc_id"), "text_key": part.column("text_key"), "n_shingles": size.astype(np.int64),
                "cls": pa.array(list(cls), pa.binary()), "bands": _long_lists(keys), "sketch": _long_lists(sketch),
            })

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, text_key long, n_shingles long, cls binary, bands array<long>, sketch array<long>")


def _flips() -> Column:
    """Population count of the XOR of ``sketch_u`` and ``sketch_v``."""
    return F.aggregate(F.zip_with("sketch_u", "sketch_v", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)


def _plausible(rule: Rule) -> Column:
    small, large = F.least("n_u", "n_v"), F.greatest("n_u", "n_v")
    return (small * rule.den >= large * rule.num) & (_flips() <= rule.sketch_flips)


def texts_of(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """cls, text: a text of each class in ``wanted`` (cls)."""
    wanted = classes.join(wanted.select("cls").distinct(), "cls").select("cls", F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    source = docs.select(F.col("doc_id").alias("__doc"), F.col("text").cast("string").alias("text"))
    same = F.col("__doc").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))
    return source.join(wanted, same).groupBy("cls").agg(F.min("text").alias("text"))


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """Those of ``pairs`` (u, v; classes) whose full shingle sets reach the threshold."""
    pairs = written(pairs.select("u", "v").distinct(), "candidates")
    both = pairs.select(F.col("u").alias("cls")).union(pairs.select(F.col("v").alias("cls")))
    texts = written(texts_of(both, classes, docs), "texts")
    sides = pairs.join(texts.select(F.col("cls").alias("u"), F.col("text").alias("text_u")), "u")
    sides = sides.join(texts.select(F.col("cls").alias("v"), F.col("text").alias("text_v")), "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text_v"):
            a, ab = sets_of(part.column("text_u"), rule.words)
            b, bb = sets_of(part.column("text_v"), rule.words)
            keep = np.zeros(part.num_rows, bool)
            for i in range(part.num_rows):
                x, y = a[ab[i] : ab[i + 1]], b[bb[i] : bb[i + 1]]
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep[i] = rule.den * common >= rule.num * (len(x) + len(y) - common)
            yield part.select(["u", "v"]).filter(pa.array(keep))

    return written(sides.select("u", "v", "text_u", "text_v").mapInArrow(run, "u binary, v binary"), "links")


def full_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """cls, hashes: the packed shingle set of each class in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            hashes, bounds = sets_of(part.column("text"), rule.words)
            packed = [hashes[a:b].astype("<u8").tobytes() for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_pydict({"cls": part.column("cls"), "hashes": pa.array(packed, pa.binary())})

    return texts_of(wanted, classes, docs).mapInArrow(run, "cls binary, hashes binary")


def _rest(members: DataFrame, roots: DataFrame, classes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """Links between different components in buckets that hold several of them; those that join nothing new
    within a block are left out, so a block gives fewer links than it has rows."""
    held = members.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    buckets = held.groupBy("key").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.min_by("root", "cls").alias("main"), F.count("cls").alias("n")
    ).where(F.col("lo") != F.col("hi"))
    held = written(held.join(buckets.select("key", "main", "n"), "key"), "mixed")
    small = held.where(F.col("root") != F.col("main"))
    counts = small.groupBy("key").agg(F.count("cls").alias("n_small"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    small_blocks = F.ceil(F.col("n_small") / BLOCK).cast("int")
    place = F.xxhash64(F.lit(3), "cls")
    sets = full_sets(held, classes, docs, rule)
    held = held.join(sets, "cls").join(counts, "key")
    each = held.withColumn("a", F.explode(F.sequence(F.lit(0), small_blocks - 1))).withColumn("b", F.pmod(place, blocks).cast("int"))
    few = held.where((F.col("root") != F.col("main")) & (blocks > 1)).withColumn("a", F.pmod(place, small_blocks).cast("int"))
    few = few.withColumn("b", F.explode(F.sequence(F.lit(0), blocks - 1)))
    columns = ["key", "a", "b", "cls", "root", "sketch", "hashes"]
    # with one block, the rows outside of the main component are both sides
    one = (blocks == 1) & (F.col("root") != F.col("main"))
    both = each.select(*columns, F.when(one, 2).otherwise(0).alias("few")).union(few.select(*columns, F.lit(1).alias("few")))

    def compare(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(parts))
        sketch = table["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, SKETCH)
        sets = [np.frombuffer(x, "<u8") for x in table["hashes"].to_pylist()]
        size = np.array([len(x) for x in sets])
        bounds = np.concatenate([[0], np.cumsum(size)])
        words, ids = np.unique(np.concatenate(sets), return_inverse=True)
        cls = table["cls"].to_pylist()
        _, root = np.unique(np.array(table["root"].to_pylist(), object), return_inverse=True)
        side = table["few"].to_numpy()
        rest, mask = np.flatnonzero(side != 1), np.zeros(len(words), bool)
        links = []
        for i in np.flatnonzero(side > 0):
            j = rest[root[rest] != root[i]]
            j = j[np.minimum(size[j], size[i]) * rule.den >= np.maximum(size[j], size[i]) * rule.num]
            j = j[np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1) <= rule.sketch_flips]
            if not len(j):
                continue
            mask[ids[bounds[i] : bounds[i + 1]]] = True
            at = np.concatenate([[0], np.cumsum(size[j])])
            own = ids[np.repeat(bounds[j] - at[:-1], size[j]) + np.arange(at[-1])]
            common = np.add.reduceat(mask[own].astype(np.int64), at[:-1])
            mask[ids[bounds[i] : bounds[i + 1]]] = False
            for x in j[rule.den * common >= rule.num * (size[i] + size[j] - common)]:
                if root[x] != root[i]:
                    links.append((cls[i], cls[x]))
                    root[root == root[x]] = root[i]
        if links:
            yield pa.RecordBatch.from_pydict({"u": pa.array([u for u, _ in links], pa.binary()), "v": pa.array([v for _, v in links], pa.binary())})

    return both.groupBy("key", "a", "b").applyInArrow(compare, "u binary, v binary")


def near_duplicates(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable), kept, representative and text_key of each document.

    ``representative`` marks the rows that stand for their component even where ids are null or repeated: those
    of the least (id, text), and every row with an empty set.
    """
    small_batches(docs)
    found = written(describe(docs, rule), "signatures")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    classes = written(
        found.where(F.col("cls").isNotNull()).groupBy("cls").agg(
            F.min(first).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
        ).select("cls", "first.doc_id", "first.text_key", "n_shingles", "bands", "sketch"),
        "classes",
    )
    members = classes.select("cls", "n_shingles", "sketch", F.posexplode("bands").alias("band", "value"))
    members = members.select("cls", "n_shingles", "sketch", F.xxhash64("band", "value").alias("key"))
    sizes = members.groupBy("key").agg(F.min("cls").alias("leader"), F.count("cls").alias("n")).where(F.col("n") > 1)
    members = written(members.join(sizes, "key"), "buckets")
    side = classes.select(F.col("cls").alias("leader"), F.col("n_shingles").alias("n_v"), F.col("sketch").alias("sketch_v"))
    pairs = members.where(F.col("cls") != F.col("leader")).select("leader", F.col("cls").alias("u"), F.col("n_shingles").alias("n_u"), F.col("sketch").alias("sketch_u"))
    pairs = pairs.dropDuplicates(["leader", "u"]).join(side, "leader").where(_plausible(rule))
    links = confirmed(pairs.select("u", F.col("leader").alias("v")), classes, docs, rule)
    roots = components(links)
    more = written(_rest(members.select("key", "cls", "sketch"), roots, classes, docs, rule), "links")
    if not more.isEmpty():
        roots = components(links.union(more))
    labels = classes.select("cls", "doc_id", "text_key").join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    labels = labels.withColumn("root", F.coalesce("root", "cls"))
    least = labels.groupBy("root").agg(F.min(first).alias("first"))
    labels = labels.join(least, "root").select("cls", "first")
    out = found.select("doc_id", "text_key", "n_shingles", "cls").join(labels, "cls", "left")
    alone = F.col("cls").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    stands = alone | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key")))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    out = out.withColumn("component_id", component).withColumn("representative", stands)
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "representative", "text_key")
