"""Suffix-array dedup (operator 12): depth-limited radix sort.

Suffixes are ordered only through their first ``window`` bytes, by most-significant-digit passes. A group of
suffixes that agree in all digits is exactly a repeated window; a suffix that is alone in its group after any
pass is dropped there and then. So that only suffixes with a chance reach the passes over bytes, and move between
tasks in runs instead of one by one, the first digit of a window is not its first bytes but its *anchor*:

1. **Anchor digit.** The anchor of a window is that ``GRAM``-byte string in it whose hash is smallest (the first, if
   several). It depends on the window's bytes alone, so equal windows have equal anchors at equal places. Neighbouring
   windows share theirs: a text falls into runs of windows, one run in about 85 windows of 200 bytes. Each run is one
   row (anchor hash, text, place). Runs whose anchor occurs nowhere else drop out. Every task sends one probe a
   distinct anchor and knows its own repeated ones, so a frequent anchor costs one row a task in that exchange.
2. **Byte digits.** The bytes of the remaining runs are cut from their texts and dealt out by anchor. Inside
   a bucket the windows start in groups of (anchor, place of the anchor in the window) and are split by four passes
   over digits of ``window / 4`` bytes, told apart by a 64-bit hash. Windows of one group behind the last pass are
   repeated.
3. Anchors with more than ``HOT`` runs don't fit a bucket. Their windows go on one by one: all remaining
   digits are taken at once, as a row (128-bit hash, text, place), counted with partial aggregation and joined back.
4. Removed bytes are the union of the repeated windows, text by text.

Texts that occur more than once are repeated as a whole if they hold a window at all. They are known by a 64-bit hash
and 15 bits of a checksum; two different texts are taken for one with a chance of 2**-79 a pair, digits of different
bytes for equal ones with 2**-64 a pair.

Memory: a task holds a slice of a text, a bucket, or a text. Disk: each text moves twice, remaining runs once.

Edge cases: matches never cross texts; null texts are empty; shorter texts than the window lose nothing; repeated rows
are copies of each other, whatever their ids; an empty table gives no rows; kept columns named like an output
column are replaced by it. Texts of one repeated byte or a short period cost most: each window is a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm.common import give_back, pieces, small_batches, table_count, utf8, written
from tabsmith.llm.words import mix

GRAM = 32
#: Runs of an anchor from which on its windows go one by one.
HOT = 20_000
#: Bytes of runs in a bucket, on average, and of those that are split at a time (an anchor's at least).
BUCKET_BYTES = 8 << 20
PART_BYTES = 2 << 20
#: Windows of a slice of a long text; anchors that are held back to be counted in their own task.
SLICE, HELD = 1 << 20, 1 << 20
PASSES = 4
OWN = ("n_bytes", "n_removed", "spans", "kept")

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.Generator(np.random.PCG64(12)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64(0xFFFFFFFF)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_ODD), n, 1 << 64))


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` bytes, by doubling: that of 2k bytes is that of k, shifted, and of the next k."""
    part, have = _BYTE[data], 1
    out, done = None, 0
    while True:
        if n & have:
            out, done = (part, have) if out is None else (out[: len(data) - done - have + 1] * _power(have) + part[done:], done + have)
        if have * 2 > n:
            return mix(out[: max(0, len(data) - n + 1)])
        part, have = part[:-have] * _power(have) + part[have:] if len(part) > have else part[:0], have * 2


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x, have = np.minimum(x[:-have], x[have:]), have * 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def runs(data: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: text, first window (from the text's beginning), windows, place of the anchor, hash."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    if len(data) < window:
        return none
    gram = gram_hashes(data, GRAM)
    ranked = (gram & ~_LOW) | np.arange(len(gram), dtype=np.uint64)
    anchor = (_smallest(ranked, window - GRAM + 1) & _LOW).astype(np.int64)
    size = np.diff(bounds)
    inside = np.zeros(len(data) + 1, np.int8)  # windows that end in the text that they begin in
    full = size >= window
    np.add.at(inside, bounds[:-1][full], 1)
    np.add.at(inside, bounds[1:][full] - window + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[: len(anchor)]))
    if not len(at):
        return none
    first = np.flatnonzero(np.concatenate([[True], (anchor[at[1:]] != anchor[at[:-1]]) | (at[1:] != at[:-1] + 1)]))
    start = at[first]
    count = np.diff(np.append(first, len(at)))
    text = np.searchsorted(bounds, start, side="right") - 1
    return text, start - bounds[text], count, anchor[start] - start, gram[anchor[start]]


# -- a run's place is one long: 15 bits of the text's checksum, 32 of the first window, 8 of their number less 1, 8 of the anchor's place


def _packed(check: np.ndarray, start: np.ndarray, count: np.ndarray, off: np.ndarray) -> np.ndarray:
    return (check << 48) | (start << 16) | ((count - 1) << 8) | off


def _check(place: Column) -> Column:
    return F.shiftright(place, 48).cast("int")


def _start(place: Column) -> Column:
    return F.shiftright(place, 16).bitwiseAND(F.lit(0xFFFFFFFF))


def _count(place: Column) -> Column:
    return F.shiftright(place, 8).bitwiseAND(F.lit(0xFF)) + 1


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """Texts with their key (k, c). Null texts have that of the empty text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(*more, F.xxhash64(F.lit(12), text).alias("k"), F.crc32(text.cast("binary")).bitwiseAND(F.lit(0x7FFF)).cast("int").alias("c"), text.alias("__text"))


def _probes(anchor: np.ndarray, key: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """Rows of a task's runs: the first of each anchor goes where that anchor is counted, the others anywhere."""
    order = np.lexsort((place, key, anchor))
    anchor, key, place = anchor[order], key[order], place[order]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (key[1:] != key[:-1]) | (place[1:] != place[:-1])
    anchor, key, place = anchor[new], key[new], place[new]  # copies of a text in this task say the same
    probe = np.ones(len(anchor), bool)
    probe[1:] = anchor[1:] != anchor[:-1]
    number = np.diff(np.append(np.flatnonzero(probe), len(anchor)))
    seen = np.zeros(len(anchor), np.int64)
    seen[probe] = number
    meet = np.where(probe, anchor, mix(anchor + mix(key.view(np.uint64) + place.view(np.uint64))))
    return pa.RecordBatch.from_arrays(
        [pa.array(probe), pa.array(meet.view(np.int64)), pa.array(anchor.view(np.int64)), pa.array(key), pa.array(place), pa.array(seen)],
        names=["probe", "meet", "anchor", "k", "place", "seen"],
    )


def _repeated_anchors(docs: DataFrame, window: int) -> DataFrame:
    """Runs (anchor, k, place, probe, total) whose anchor occurs at two places or more; total, with probes, is its number of runs."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in pieces(batches, "__text"):
            data, bounds = utf8(batch.column("__text"))
            key, check = batch.column("k").to_numpy(), batch.column("c").to_numpy().astype(np.int64)
            for text, start, count, off, anchor in _sliced(data, bounds, window):
                held.append((anchor, key[text], _packed(check[text], start, count, off)))
            if sum(len(x[0]) for x in held) >= HELD:
                yield _probes(*map(np.concatenate, zip(*held)))
                held = []
        if held:
            yield _probes(*map(np.concatenate, zip(*held)))

    found = _keyed(docs).mapInArrow(find, "probe boolean, meet long, anchor long, k long, place long, seen long")
    met = Window.partitionBy("probe", "meet")
    counted = found.select(
        "*", F.sum("seen").over(met).alias("total"), F.max("seen").over(met).alias("most"),
        (F.min("k").over(met) != F.max("k").over(met)).alias("texts"), (F.min("place").over(met) != F.max("place").over(met)).alias("places"),
    )
    return counted.where(~F.col("probe") | (F.col("most") > 1) | F.col("texts") | F.col("places")).select("anchor", "k", "place", "probe", "total")


def _sliced(data: np.ndarray, bounds: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """``runs`` of all texts; texts with more than ``SLICE`` windows in slices, so that memory doesn't go by their length."""
    if len(data) <= SLICE + window:
        yield runs(data, bounds, window)
        return
    for t in range(len(bounds) - 1):
        for a in range(int(bounds[t]), max(int(bounds[t + 1]) - window + 1, int(bounds[t]) + 1), SLICE):
            part = data[a : min(a + SLICE + window - 1, int(bounds[t + 1]))]
            text, start, count, off, anchor = runs(part, np.array([0, len(part)]), window)
            yield text + t, start + (a - bounds[t]), count, off, anchor


def _split(group: np.ndarray, digit: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One radix pass: the members ``alive`` of each group, split by their digit; the new groups and who is not alone."""
    key = mix(group * _ODD + digit)
    order = np.argsort(key)
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    kept = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(order) else order
    return key[kept], alive[kept]


def repeated_windows(anchor: np.ndarray, data: np.ndarray, begin: np.ndarray, count: np.ndarray, off: np.ndarray, window: int) -> np.ndarray:
    """Begins, in ``data``, of the windows of all runs that have an equal in another place. Runs must be distinct places.

    Run i has ``count[i]`` windows from ``begin[i]`` on and its anchor ``off[i]`` bytes behind that.
    """
    run = np.repeat(np.arange(len(begin)), count)
    step = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
    at = begin[run] + step
    group = mix(anchor[run] + mix((off[run] - step).astype(np.uint64)))
    width = -(-window // PASSES)
    digits = gram_hashes(data, width)
    for j in range(PASSES):
        group, at = _split(group, digits[at + min(j * width, window - width)], at)
    return at


def _spans_of(at: np.ndarray, run: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal [from, to) that windows beginning at ``at`` (ascending in each run, runs ascending) cover: run, from, to."""
    new = np.ones(len(at), bool)
    new[1:] = (run[1:] != run[:-1]) | (at[1:] > at[:-1] + window)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return run[first], at[first], at[last] + window


_SPAN = "k long, c int, a long, b long"


def _span_batch(key: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array((place >> 48).astype(np.int32)), pa.array(a), pa.array(b)], names=["k", "c", "a", "b"])


def _columns(table: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, ...]:
    """Anchor, key, place, bytes and their bounds of rows of runs."""
    anchor, key, place = (table.column(c).to_numpy() for c in ("anchor", "k", "place"))
    blob = table.column("bytes").cast(pa.large_binary())
    blob = pa.concat_arrays(blob.chunks if isinstance(blob, pa.ChunkedArray) else [blob])  # drops the offset of a slice
    _, bounds, data = blob.buffers()
    bounds = np.frombuffer(bounds, np.int64, len(blob) + 1)
    return anchor.view(np.uint64), key, place, np.frombuffer(data, np.uint8)[: bounds[-1]], bounds


def _spans_of_runs(table: pa.Table, window: int) -> pa.RecordBatch:
    anchor, key, place, data, bounds = _columns(table)
    begin, count = bounds[:-1], ((place >> 8) & 0xFF) + 1
    at = np.sort(repeated_windows(anchor, data, begin, count, place & 0xFF, window))
    run, a, b = _spans_of(at, np.searchsorted(begin, at, side="right") - 1, window)
    move = ((place[run] >> 16) & 0xFFFFFFFF) - begin[run]
    return _span_batch(key[run], place[run], a + move, b + move)


def _in_buckets(found: DataFrame, window: int, buckets: int) -> DataFrame:
    """Spans (k, c, a, b) of the repeated windows among runs (anchor, k, place, bytes)."""

    def sort(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(parts))
        table = table.take(pc.sort_indices(table, [("anchor", "ascending"), ("k", "ascending"), ("place", "ascending")]))
        anchor = table["anchor"].to_numpy()
        size = pc.binary_length(table["bytes"]).to_numpy()
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        part = np.cumsum(size)[first] // PART_BYTES  # anchors stay whole
        cuts = [*first[np.concatenate([[True], np.diff(part) > 0])].tolist(), len(anchor)]
        for lo, hi in zip(cuts, cuts[1:]):
            yield _spans_of_runs(table.slice(lo, hi - lo), window)
            give_back()

    dealt = found.withColumn("bucket", F.pmod("anchor", F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(sort, _SPAN)


def _one_by_one(found: DataFrame, window: int) -> DataFrame:
    """The same spans, by counting every window for itself: the way of anchors with too many runs."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "bytes", 1 << 18):
            _, key, place, data, bounds = _columns(batch)
            count = ((place >> 8) & 0xFF) + 1
            run = np.repeat(np.arange(len(count)), count)
            step = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
            at = bounds[:-1][run] + step
            half = window // 2
            left, right = gram_hashes(data, half)[at], gram_hashes(data, window - half)[at + half]
            a = ((place[run] >> 16) & 0xFFFFFFFF) + step
            yield pa.RecordBatch.from_arrays(
                [pa.array(mix(left + right * _ODD).view(np.int64)), pa.array(mix(right + mix(left)).view(np.int64)), pa.array(key[run]), pa.array((place[run] >> 48).astype(np.int32)), pa.array(a)],
                names=["w1", "w2", "k", "c", "a"],
            )

    rows = written(found.mapInArrow(explode, "w1 long, w2 long, k long, c int, a long"), "windows")
    where = F.xxhash64("k", "c", "a")
    repeated = rows.groupBy("w1", "w2").agg(F.min(where).alias("lo"), F.max(where).alias("hi")).where("lo <> hi").select("w1", "w2")
    return rows.join(repeated, ["w1", "w2"], "left_semi").select("k", "c", "a", (F.col("a") + window).alias("b"))


def repeated_spans(docs: DataFrame, window: int = 200, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Spans [a, b) of bytes, of each distinct text (k, c), that repeated windows cover; they may overlap."""
    small_batches(docs)
    if not GRAM < window <= 256:
        raise ValueError(f"windows of {GRAM + 1} to 256 bytes")
    alive = written(_repeated_anchors(docs, window), "runs")
    held = alive.select(F.sum(_count(F.col("place")) + window - 1)).first()[0]
    # copies of a text say the same from several tasks, and one of them will do
    places = alive.groupBy("k", _check(F.col("place")).alias("c")).agg(F.collect_set(F.struct("anchor", "place")).alias("runs"))
    texts = _keyed(docs).groupBy("k", "c").agg(F.first(F.col("__text").cast("binary")).alias("__bytes"))
    cut = texts.join(places, ["k", "c"]).select(
        "k", F.inline(F.transform("runs", lambda r: F.struct(r.anchor.alias("anchor"), r.place.alias("place"), F.substring(F.col("__bytes"), (_start(r.place) + 1).cast("int"), (_count(r.place) + window - 1).cast("int")).alias("bytes")))),
    )
    crowded = alive.where(F.col("probe")).where(F.col("total") > hot).select("anchor").distinct()
    if crowded.isEmpty():
        return _in_buckets(cut, window, table_count(held, bucket_bytes))
    cut, crowded = written(cut, "cut"), written(crowded, "crowded")
    few = _in_buckets(cut.join(crowded, "anchor", "left_anti"), window, table_count(held, bucket_bytes))
    return few.unionByName(_one_by_one(cut.join(crowded, "anchor", "left_semi"), window))


def remove_repeats(docs: DataFrame, keep: list[str], window: int = 200, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``keep`` and, for each text: ``n_bytes``, ``n_removed``, ``spans`` (maximal removed runs) and ``kept``, its other bytes."""
    spans = repeated_spans(docs, window, hot, bucket_bytes).groupBy("k", "c").agg(F.collect_list(F.struct("a", "b")).alias("__spans"))
    copies = _keyed(docs).groupBy("k", "c").agg(F.count("*").alias("__copies"))
    known = copies.join(spans, ["k", "c"], "left").where("__copies > 1 OR __spans IS NOT NULL")
    carried = [F.col(f"`{c}`") for c in keep if c not in OWN]
    rows = _keyed(docs, (F.struct(*carried) if carried else F.struct(F.lit(0).alias("none"))).alias("__kept"))
    joined = rows.join(known, ["k", "c"], "left").select("__kept", "__text", F.coalesce("__copies", F.lit(1)).alias("__copies"), F.col("__spans.a").alias("__from"), F.col("__spans.b").alias("__to"))
    own = T._parse_datatype_string("n_bytes long, n_removed long, spans array<struct<a: long, b: long>>, kept binary")
    schema = T.StructType([joined.schema["__kept"], *own.fields])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            removed, spans, kept = [], [], []
            data, bounds = utf8(batch.column("__text"))
            whole = data.tobytes()
            n_copies = batch.column("__copies").to_pylist()
            for i, n in enumerate(n_copies):
                text = whole[bounds[i] : bounds[i + 1]]
                if n > 1 and len(text) >= window:
                    found = [(0, len(text))]
                elif (a := batch.column("__from")[i]).is_valid:
                    found = merged(a.values.to_numpy(), batch.column("__to")[i].values.to_numpy())
                else:
                    found = []
                ends = [0, *(x for span in found for x in span), len(text)]
                kept.append(b"".join(text[ends[j] : ends[j + 1]] for j in range(0, len(ends), 2)) if found else text)
                spans.append([{"a": a, "b": b} for a, b in found])
                removed.append(len(text) - len(kept[-1]))
            arrays = [batch.column("__kept"), pa.array(np.diff(bounds), pa.int64()), pa.array(removed, pa.int64())]
            arrays += [pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    out = joined.mapInArrow(remove, schema)
    return out.select(*([F.col("__kept.*")] if carried else []), *OWN)


def merged(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The union of spans as maximal runs, ascending; spans that touch are one."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    return list(zip(a[new].tolist(), b[np.append(np.flatnonzero(new)[1:], len(a)) - 1].tolist()))
