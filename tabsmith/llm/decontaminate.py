"""Benchmark decontamination (operator 10): n-gram seeds, then Smith-Waterman alignment.

1. Every run of ``SEED_WORDS`` words of a test item is a seed, however many documents hold it. Items go out to
   the tasks in blocks of about ``BLOCK_WORDS`` words, one pass over the corpus a block; a Bloom filter of fixed
   size passes over the other words.
2. Around each seed, a passage as long as an alignment through it can span is cut out for each item that holds
   the seed. Words of the item count as matches and all others as mismatches, wherever they stand: the best run's
   sum is never below the alignment's score, and passages whose sum misses the threshold go. So common seeds,
   which most often stand alone, cost little, and no copy with a seed is lost for being repeated.
3. Smith-Waterman (match 2, mismatch -1, gap -1) on words scores each passage left against the item, in array
   operations over many pairs. The score is the best alignment's, over that of the item with itself.

Words are runs of ASCII letters, digits and bytes from 0x80, in lower case; in scripts written without spaces
(Chinese, Japanese, Thai, Lao, Burmese, Khmer, Tibetan) each character is a word, and their punctuation is none.
A match needs ``LEAST_MATCHES`` words, or half of the item's, whichever is more, so the share of an item that must be
there falls from all of it (up to ``LEAST_MATCHES`` words) to a half (twice as many). An item of fewer than
``SEED_WORDS`` words is its own seed, so a copy of it is found wherever it stands. What can't match: copies without
``SEED_WORDS`` words of a longer item in a row. Edge cases: null and empty texts and items match nothing; repeated rows are
judged one by one, and rows equal in id and text give one row an item; equal scores go to the earlier passage. An empty
table on either side gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import pieces, small_batches, table_count, utf8, written
from tabsmith.llm.words import NOT_ALNUM, mix, shingles, word_hashes

SEED_WORDS = 3
#: Words of the items that are sent to the tasks at a time.
BLOCK_WORDS = 1 << 19
#: Bits of the Bloom filter: 4 MB, whatever the number of seeds.
FILTER_BITS = 1 << 25
#: Code points of unspaced scripts (1) and of their punctuation (2): first, last, kind.
_SCRIPTS = (
    (0x0E00, 0x0FFF, 1), (0x1000, 0x109F, 1), (0x1780, 0x17FF, 1), (0x3000, 0x3004, 2), (0x3005, 0x3007, 1), (0x3008, 0x3020, 2), (0x3021, 0x302F, 1),
    (0x3030, 0x3030, 2), (0x3031, 0x30FA, 1), (0x30FB, 0x30FB, 2), (0x30FC, 0x312F, 1), (0x31A0, 0x31FF, 1), (0x3400, 0x9FFF, 1), (0xF900, 0xFAFF, 1),
    (0xFF01, 0xFF0F, 2), (0xFF1A, 0xFF20, 2), (0xFF3B, 0xFF40, 2), (0xFF5B, 0xFF65, 2), (0xFF66, 0xFF9F, 1), (0x20000, 0x3FFFF, 1),
)
_EDGES = np.array([x for first, last, _ in _SCRIPTS for x in (first, last + 1)])
_KIND = np.array([0, *(x for _, _, kind in _SCRIPTS for x in (kind, 0))])
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the item's own score, and score in matched words, from which a document is contaminated.
THRESHOLD, LEAST_MATCHES = 0.5, 6
#: Cells of the alignment tables that a task holds at a time.
CELLS = 1 << 21


class Filter:
    """Which 64-bit keys may be in a set; no key of the set is missed."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(keys: np.ndarray) -> list[np.ndarray]:
        return [(mix(keys + np.uint64(salt)) % np.uint64(FILTER_BITS)).astype(np.int64) for salt in (1, 2)]

    def __contains__(self, key: int) -> bool:
        return bool(self.find(np.array([key], np.uint64))[0])

    def find(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in self.places(keys):
            found &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


def spaced(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with spaces around each character of the unspaced scripts, and for their punctuation."""
    lead = np.flatnonzero(data >= 0xE0)
    if not len(lead):
        return data, bounds
    size = np.where(data[lead] >= 0xF0, 4, 3)
    tail = [data[np.minimum(lead + j, len(data) - 1)].astype(np.int64) & 0x3F for j in (1, 2, 3)]
    point = (data[lead].astype(np.int64) & 0x0F) << 12 | tail[0] << 6 | tail[1]
    point = np.where(size == 4, (data[lead].astype(np.int64) & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2], point)
    kind = np.searchsorted(_EDGES, point, side="right")
    whole = lead + size <= len(data)
    single, mark = whole & (_KIND[kind] == 1), whole & (_KIND[kind] == 2)
    if not (single.any() or mark.any()):
        return data, bounds
    data = data.copy()
    for j in range(3):  # all marks have three bytes
        data[lead[mark] + j] = 0x20
    at = np.stack([lead[single], lead[single] + size[single]], axis=1).ravel()
    return np.insert(data, at, 0x20), bounds + 2 * np.searchsorted(lead[single], bounds)


def item_words(benchmark: DataFrame) -> DataFrame:
    """item_id and words (hashes) of each test item that has a seed."""
    source = benchmark.select("item_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            words, rows = word_hashes(*spaced(*utf8(part.column("text"))), NOT_ALNUM)
            lists = pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(words.view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("item_id"), lists], ["item_id", "words"])

    kind = source.schema["item_id"].dataType.simpleString()
    return source.mapInArrow(run, f"item_id {kind}, words array<long>").where(F.size("words") > 0)


class Items:
    """A block of test items: which of them hold a seed or a word, and how far alignments reach."""

    def __init__(self, table: pa.Table, kind: str, threshold: float):
        self.ids, self.kind = table["item_id"].combine_chunks(), kind
        lists = [np.asarray(x, np.int64).view(np.uint64) for x in table["words"].to_pylist()]
        self.words, self.length = lists, np.array([len(x) for x in lists], np.int64)
        flat, bounds = np.concatenate([np.zeros(0, np.uint64), *lists]), np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        #: Words of a text that an alignment spans at most: 2 * matches - others >= threshold * 2 * length.
        self.span = np.maximum(np.minimum(SEED_WORDS, self.length), np.ceil((3 - 2 * threshold) * self.length).astype(np.int64))
        self.least = np.maximum(threshold * MATCH * self.length, MATCH * np.minimum(LEAST_MATCHES, self.length))
        #: Lengths of seeds: all of a short item, ``SEED_WORDS`` words of the others.
        self.widths = np.unique(np.minimum(SEED_WORDS, self.length)).tolist()
        seeds, at = shingles(flat, bounds, SEED_WORDS)
        pair = np.unique(np.stack([seeds, np.repeat(np.arange(len(lists), dtype=np.uint64), np.diff(at))], axis=1), axis=0)
        self.seeds, first = np.unique(pair[:, 0], return_index=True)
        self.first, self.item = np.append(first, len(pair)), pair[:, 1].astype(np.int64)
        self.cost = np.add.reduceat(2 * self.span[self.item], first) if len(pair) else np.zeros(0, np.int64)
        self.vocabulary, word = np.unique(flat, return_inverse=True)
        self.held = np.unique(np.repeat(np.arange(len(lists)), self.length) * len(self.vocabulary) + word)
        bits = np.zeros(FILTER_BITS, bool)
        for places in Filter.places(self.seeds):
            bits[places] = True
        self.filter = Filter(np.packbits(bits, bitorder="little"))

    def find(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``seeds`` are an item's, and their places in ``self.seeds``."""
        at = np.flatnonzero(self.filter.find(seeds)) if len(self.seeds) else np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.seeds, seeds[at]), len(self.seeds) - 1)
        real = self.seeds[place] == seeds[at]
        return at[real], place[real]

    def passages(self, words: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Row, item, first and last word (exclusive) of the passages that may reach the threshold."""
        for width in self.widths:
            seeds, bounds = shingles(words, rows, width, short=False)
            at, place = self.find(seeds)
            row = np.searchsorted(bounds, at, side="right") - 1
            at = rows[row] + at - bounds[row]
            part = np.cumsum(self.cost[place]) // CELLS
            for hits in np.split(np.arange(len(at)), np.flatnonzero(np.diff(part)) + 1):
                if len(hits):
                    yield self._cut(words, rows, row[hits], at[hits], place[hits], width)

    def _cut(self, words: np.ndarray, rows: np.ndarray, row: np.ndarray, at: np.ndarray, place: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
        item, hit = self.item[_ranges(self.first[place], self.first[place + 1])], np.repeat(np.arange(len(at)), np.diff(self.first)[place])
        row, at = row[hit], at[hit]
        order = np.lexsort((at, item, row))
        row, item, at = row[order], item[order], at[order]
        far = self.span[item] - width
        start, end = np.maximum(rows[row], at - far), np.minimum(rows[row + 1], at + width + far)
        new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] > end[:-1])]))
        row, item, start, end = row[new], item[new], start[new], end[np.append(new[1:], len(end)) - 1]
        # long runs in parts that overlap by as much as any alignment spans
        over = self.span[item]
        n = np.maximum(1, -(-(end - start - over) // (8 * over)))
        k = _ranges(np.zeros(len(n), np.int64), n)
        row, item, start, end, over = (np.repeat(x, n) for x in (row, item, start, end, over))
        start = start + 8 * over * k
        end = np.minimum(end, start + 9 * over)
        good = self._bound(words, item, start, end) >= self.least[item]
        return row[good], item[good], start[good], end[good]

    def _bound(self, words: np.ndarray, item: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each passage the largest sum of a run: ``MATCH`` for a word of the item, ``MISMATCH`` for another."""
        own, size = words[_ranges(start, end)], end - start
        which = np.repeat(np.arange(len(item)), size)
        at = np.minimum(np.searchsorted(self.vocabulary, own), len(self.vocabulary) - 1)
        key = item[which] * len(self.vocabulary) + at
        near = np.minimum(np.searchsorted(self.held, key), len(self.held) - 1)
        gain = np.where((self.vocabulary[at] == own) & (self.held[near] == key), MATCH, MISMATCH)
        total, apart = np.cumsum(gain), which * (4 * len(gain) + 4)  # sets passages apart
        low = np.minimum.accumulate(total - gain - apart) + apart
        return np.maximum.reduceat(total - low, np.cumsum(size) - size)


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start[i] .. end[i] - 1 for each i, end to end."""
    size = end - start
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def align(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of a[i] (items) in b[i] (passages): score, and the words of b it spans [from, to)."""
    score = np.zeros(len(a), np.int64)
    span = np.zeros((len(a), 2), np.int64)
    order = np.lexsort(([len(x) for x in a], [len(x) for x in b]))
    while len(order):
        n = np.searchsorted(np.maximum.accumulate([len(b[i]) for i in order]) * np.arange(1, len(order) + 1), CELLS, side="right")
        take, order = order[: max(1, n)], order[max(1, n) :]
        items, texts = [a[i] for i in take], [b[i] for i in take]
        best, end = _table(items, texts)
        # on reversed words, up to that end, the best alignment ends where it begins
        _, begin = _table([x[::-1] for x in items], [t[:e][::-1] for t, e in zip(texts, end)])
        span[take, 0], span[take, 1] = end - begin, end
        score[take] = best
    return score, span[:, 0], span[:, 1]


def _table(items: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    rows, width = max(map(len, items)), max(1, *map(len, texts))
    text = np.zeros((len(texts), width), np.int64)
    inside = np.zeros((len(texts), width), bool)
    for i, t in enumerate(texts):
        text[i, : len(t)] = t
        inside[i, : len(t)] = True
    slope = -GAP * np.arange(1, width + 1)
    last = np.zeros((len(texts), width + 1), np.int64)
    best, end = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    lengths = np.array([len(x) for x in items])
    for r in range(rows):
        word = np.array([x[r] if r < len(x) else 0 for x in items], np.int64)
        live = r < lengths
        now = last[:, :-1] + np.where((text == word[:, None]) & inside, MATCH, MISMATCH)
        now = np.maximum(np.maximum(now, last[:, 1:] + GAP), 0)
        now = np.maximum.accumulate(now + slope, axis=1) - slope  # gaps along the row
        now[~inside] = 0
        now[~live] = 0
        top = now.argmax(axis=1)
        value = now[np.arange(len(texts)), top]
        better = value > best
        best[better], end[better] = value[better], top[better] + 1
        last[:, 1:] = now
    return best, end


def aligned(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, text_key, item_id, score, net_matches, start, end of the passages that reach the threshold."""
    held = docs.sparkSession.sparkContext.broadcast(items)  # BLOCK_WORDS
    source = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        for part in pieces(batches):
            words, rows = word_hashes(*spaced(*utf8(part.column("text"))), NOT_ALNUM)
            for row, item, start, end in items.passages(words, rows):
                score, first, last = align([items.words[i].view(np.int64) for i in item], [words[a:b].view(np.int64) for a, b in zip(start, end)])
                good = np.flatnonzero(score >= items.least[item])
                row, item, start = row[good], item[good], (start - rows[row])[good]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id").take(pa.array(row)), "text_key": part.column("text_key").take(pa.array(row)), "item_id": items.ids.take(pa.array(item)),
                    "score": score[good] / (MATCH * items.length[item]), "net_matches": score[good] // MATCH, "start": start + first[good], "end": start + last[good],
                })

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, text_key long, item_id {items.kind}, score double, net_matches long, start long, end long")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_key, item_id, score, net_matches, start, end (words of the document) of each copy found.

    ``text_key`` (Spark's xxhash64 of the text) tells rows apart that share an id.
    """
    small_batches(docs)
    items = written(item_words(benchmark), "items")
    n = table_count(items.agg(F.sum(F.size("words"))).first()[0], BLOCK_WORDS)
    found = []
    for block in range(n):
        own = items.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(n)) == block).toArrow()  # BLOCK_WORDS
        copies = aligned(docs, Items(own, items.schema["item_id"].dataType.simpleString(), threshold))
        found.append(copies if n == 1 else written(copies, "aligned"))
    scored = reduce(DataFrame.unionAll, found)
    best = scored.groupBy("doc_id", "text_key", "item_id").agg(F.max(F.struct("score", -F.col("start"), "net_matches", "end")).alias("m"))
    return best.select("doc_id", "text_key", "item_id", "m.score", "m.net_matches", (-F.col("m.col2")).alias("start"), "m.end")
