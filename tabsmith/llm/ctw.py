"""LM scoring (operator 6): context-tree weighting over binary-decomposed bytes.

A text is the bytes of its words (lower case in A-Z), a space after each but the last, and an end byte: a code
for its tokens. Each byte is eight binary decisions, each a node of a binary tree; each node has a context
tree over the preceding bytes, 0 to ``DEPTH`` of them. A tree node's probability mixes its own
Krichevsky-Trofimov estimate and its children's product, half and half; after training the mixture weights
and estimates are frozen, and a decision's probability runs from the deepest context seen in training up to
the empty one. So the code length of a byte depends on it and the ``DEPTH`` bytes before alone.

The work is an exchange between blocks of texts and owners of keys:

1. Texts are packed into blocks of about ``BLOCK`` bytes, written once.
2. Each block asks, once for each distinct key, for the words and the (DEPTH + 1)-byte windows that it holds,
   and says how often its training texts hold them. A key goes to the owner given by its hash; a window to the
   owner of its last two context bytes, so that an owner has whole subtrees.
3. Owners add up counts. Subtrees below two context bytes are weighted there; the 65,536 sums above them
   (256 contexts by 256 nodes) give the two uppermost levels.
4. Owners answer each block's keys: counts of words, code lengths of windows; each block adds up its texts.

Everything is counted over all training texts, and all work is linear in the input; a word that is everywhere
is one key a block. Words are told apart by 64-bit hashes.

Edge cases: null and empty texts are the end alone; without training texts every count is 0 and each decision
has probability one half; repeated rows are scored and counted one by one; extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import pieces, segment_sums, small_batches, table_count, utf8, written
from tabsmith.llm.langid import windows
from tabsmith.llm.words import SPACE, mix, word_hashes, word_spans

DEPTH = 5
BLOCK = 24 << 20
#: Input bytes for each owner of keys.
OWNER = 12 << 20
END_BYTE, SPACE_BYTE = 10, 32
_END = np.uint64(1)  # the end as a key among word hashes
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
WORD, WINDOW = 0, 1


def streams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code bytes of the texts end to end, and their bounds."""
    data, bounds = utf8(text)
    starts, ends, rows = word_spans(data, bounds)
    count = np.diff(rows)
    empty = np.flatnonzero(count == 0)
    at = rows[empty]
    starts, ends = np.insert(starts, at, 0), np.insert(ends, at, 0)  # an empty word before the end of an empty text
    last = np.cumsum(np.maximum(count, 1)) - 1
    length = ends - starts + 1
    to = np.cumsum(length)
    source = np.repeat(starts - (to - length), length) + np.arange(to[-1] if len(to) else 0)
    close = to - 1
    source[close] = 0
    out = _LOWER[data[source]] if len(data) else np.zeros(len(source), np.uint8)
    out[close] = SPACE_BYTE
    out[close[last]] = END_BYTE
    return out, np.concatenate([[0], to[last]]) if len(last) else np.zeros(1, np.int64)


def pack(docs: DataFrame, held_out: Column) -> DataFrame:
    """Blocks: their number, ids and folds of their texts, the code bytes (compressed), their number and bounds."""
    source = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, folds, data, bounds, size = [], [], [], [np.zeros(1, np.int64)], 0

        def flush() -> pa.RecordBatch:
            block = pa.RecordBatch.from_pydict({
                "block": pa.array([uuid.uuid4().int >> 65], pa.int64()), "ids": pa.ListArray.from_arrays(pa.array([0, sum(map(len, ids))], pa.int32()), pa.concat_arrays(ids)),
                "folds": pa.ListArray.from_arrays(pa.array([0, sum(map(len, ids))], pa.int32()), pa.concat_arrays(folds)),
                "data": pa.array([zstandard.compress(np.concatenate(data).tobytes(), 3)], pa.binary()), "size": pa.array([sum(map(len, data))], pa.int64()), "bounds": pa.array([np.concatenate(bounds)], pa.list_(pa.int64())),
            })
            del ids[:], folds[:], data[:], bounds[1:]
            return block

        for part in pieces(batches):
            code, at = streams(part.column("text"))
            ids.append(part.column("doc_id"))
            folds.append(part.column("held_out"))
            data.append(code)
            bounds.append(at[1:] + size)
            size += len(code)
            if size >= BLOCK:
                yield flush()
                size = 0
        if ids:
            yield flush()

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"block long, ids array<{kind}>, folds array<boolean>, data binary, size long, bounds array<long>")


def _arrays(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(zstandard.decompress(row["data"]), np.uint8), np.asarray(row["bounds"], np.int64), np.asarray(row["folds"], bool)


def _parts(data: np.ndarray, bounds: np.ndarray, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts [a, b) of about ``limit`` bytes."""
    part = (bounds[:-1]) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(bounds) - 1]
    yield from zip(cuts, cuts[1:])


def _keys(kind: int, data: np.ndarray, bounds: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Words (the end last) or windows of the texts [a, b), and the texts' bounds in them."""
    own, at = data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
    if kind == WINDOW:
        return windows(own, at, DEPTH + 1, END_BYTE), at
    words, rows = word_hashes(own, at, SPACE)
    return np.insert(words, rows[1:], _END), rows + np.arange(len(rows))


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys_, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return keys_, np.bincount(inverse, np.concatenate(counts), len(keys_))


def _owner(kind: int, keys: np.ndarray, owners: int) -> np.ndarray:
    place = keys if kind == WORD else (keys >> np.uint64(8)) & np.uint64(0xFFFF)
    return (mix(place + np.uint64(kind)) % np.uint64(owners)).astype(np.int64)


def _asked(data: np.ndarray, bounds: np.ndarray, folds: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct keys, ascending, and their training counts."""
    keys, counts = [], []
    for a, b in _parts(data, bounds):
        found, at = _keys(kind, data, bounds, a, b)
        train = np.repeat(~folds[a:b], np.diff(at))
        k, n = np.unique(found[train], return_counts=True)
        rest = np.unique(found[~train])
        keys += [k, rest]
        counts += [n, np.zeros(len(rest))]
    return _merge(keys, counts)


def _by_owner(kind: int, keys: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of a block's keys by owner, and the owners' bounds in it."""
    to = _owner(kind, keys, owners)
    order = np.argsort(to, kind="stable")
    return order, np.searchsorted(to[order], np.arange(owners + 1))


def requests(blocks: DataFrame, owners: int) -> DataFrame:
    """owner, kind, block, keys, counts (packed): what each block asks of each owner."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                data, bounds, folds = _arrays(row)
                for kind in (WORD, WINDOW):
                    keys, counts = _asked(data, bounds, folds, kind)
                    order, cuts = _by_owner(kind, keys, owners)
                    full = np.flatnonzero(np.diff(cuts))
                    yield pa.RecordBatch.from_pydict({
                        "owner": full.astype(np.int32), "kind": pa.array([kind] * len(full), pa.int32()), "block": pa.array([row["block"]] * len(full), pa.int64()),
                        "keys": pa.array([keys[order[cuts[o] : cuts[o + 1]]].astype("<u8").tobytes() for o in full], pa.binary()),
                        "counts": pa.array([counts[order[cuts[o] : cuts[o + 1]]].astype("<u4").tobytes() for o in full], pa.binary()),
                    })

    return blocks.mapInArrow(run, "owner int, kind int, block long, keys binary, counts binary")


# -- context trees ------------------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of numbers from 0.5 on, by Stirling's series after a shift by 8."""
    shift = np.log(x)
    for k in range(1, 8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.918938533204672742 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - 1.1447298858494002


class Level:
    """The nodes of one depth: key (context bytes, then the node in the byte's tree), bit counts, log
    probability, and the weight of the own estimate against the children's."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.keys, self.n0, self.n1 = keys, n0, n1
        own = log_kt(n0, n1)
        if below is None:
            self.log, self.weight = own, np.ones(len(keys))
        else:
            self.log = np.logaddexp(own, below) - np.log(2)
            self.weight = 1 / (1 + np.exp(np.clip(below - own, -700, 700)))

    def update(self, keys: np.ndarray, bits: np.ndarray, p: np.ndarray) -> np.ndarray:
        """``p`` (of the bits; NaN: no context seen yet) carried up through this depth."""
        if not len(self.keys):
            return p
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        n0, n1, w = self.n0[at], self.n1[at], self.weight[at]
        kt = (np.where(bits == 1, n1, n0) + 0.5) / (n0 + n1 + 1.0)
        mixed = np.where(np.isnan(p), kt, w * kt + (1 - w) * p)
        return np.where(known, mixed, p)


def _nodes(window: np.ndarray, depth: int, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """Key of the node of decision ``bit`` of the window's last byte in its ``depth`` context bytes, and the bit."""
    byte = window & np.uint64(255)
    node = (np.uint64(1) << np.uint64(bit)) | (byte >> np.uint64(8 - bit))
    context = (window >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1)
    return (context << np.uint64(8)) | node, (byte >> np.uint64(7 - bit)) & np.uint64(1)


def subtrees(window: np.ndarray, counts: np.ndarray, least: int = 2) -> list[Level]:
    """Levels ``DEPTH`` down to ``least`` from the counts of distinct windows."""
    levels: list[Level] = []
    window, counts = window[counts > 0], counts[counts > 0]
    for depth in range(DEPTH, least - 1, -1):
        seen, inverse = np.unique(window & np.uint64((1 << 8 * (depth + 1)) - 1), return_inverse=True)
        n = np.bincount(inverse, counts, len(seen))
        made = [_nodes(seen, depth, bit) for bit in range(8)]
        keys, inverse = np.unique(np.concatenate([k for k, _ in made]), return_inverse=True)
        bits, n = np.concatenate([b for _, b in made]), np.tile(n, 8)
        n1 = np.bincount(inverse, n * bits, len(keys))
        n0 = np.bincount(inverse, n, len(keys)) - n1
        below = None
        if levels:
            parent = np.searchsorted(keys, levels[-1].keys & np.uint64((1 << 8 * (depth + 1)) - 1))
            below = np.bincount(parent, levels[-1].log, len(keys))
        levels.append(Level(keys, n0, n1, below))
    return levels


def top_levels(keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> list[Level]:
    """Depths 1 and 0 from the sums over each depth-1 node's children."""
    one = Level(keys, n0, n1, below)
    zero, inverse = np.unique(keys & np.uint64(255), return_inverse=True)
    return [one, Level(zero, np.bincount(inverse, n0, len(zero)), np.bincount(inverse, n1, len(zero)), np.bincount(inverse, one.log, len(zero)))]


def log10_probabilities(window: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 probability of each window's last byte in its context; ``levels``: depths DEPTH .. 0."""
    total = np.zeros(len(window))
    for bit in range(8):
        p = np.full(len(window), np.nan)
        for depth, level in zip(range(DEPTH, -1, -1), levels):
            p = level.update(*_nodes(window, depth, bit), p)
        total += np.log10(np.where(np.isnan(p), 0.5, p))
    return total


# -- owners and blocks --------------------------------------------------------------------------------------

def _gathered(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    asked = [np.frombuffer(x, "<u8") for x in table["keys"].to_pylist()]
    keys, counts = _merge(asked, [np.frombuffer(x, "<u4") for x in table["counts"].to_pylist()])
    return keys, counts, asked


def totals(asked: DataFrame) -> DataFrame:
    """kind, key, a, b, c: for words (key 0) tokens and distinct tokens; for each depth-1 node its bit counts and
    the log probability of its children."""

    def run(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, _ = _gathered(pa.Table.from_batches(list(parts)))
        if key[1].as_py() == WORD:
            node, sums = np.zeros(1, np.int64), [np.array([counts.sum()]), np.array([float((counts > 0).sum())]), np.zeros(1)]
        else:
            two = subtrees(keys, counts)[-1]
            node, inverse = np.unique(two.keys & np.uint64(0xFFFF), return_inverse=True)
            node, sums = node.astype(np.int64), [np.bincount(inverse, x, len(node)) for x in (two.n0, two.n1, two.log)]
        yield pa.RecordBatch.from_pydict({"kind": pa.array([key[1].as_py()] * len(node), pa.int32()), "key": node, **{x: np.asarray(v, np.float64) for x, v in zip("abc", sums)}})

    made = asked.groupBy("owner", "kind").applyInArrow(run, "kind int, key long, a double, b double, c double")
    return made.groupBy("kind", "key").agg(*[F.sum(x).alias(x) for x in "abc"])


def answers(asked: DataFrame, top: list[Level]) -> DataFrame:
    """block, kind, owner, values (packed, in the order of the keys asked): counts of words, log10 probabilities of windows."""
    held = asked.sparkSession.sparkContext.broadcast(top)  # 256 contexts x 256 nodes at most

    def run(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(parts))
        keys, counts, asked_ = _gathered(table)
        if key[1].as_py() == WORD:
            values = counts
        else:
            values = log10_probabilities(keys, subtrees(keys, counts) + held.value)
        for block, own in zip(table["block"].to_pylist(), asked_):
            found = values[np.searchsorted(keys, own)]
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([block], pa.int64()), "kind": pa.array([key[1].as_py()], pa.int32()), "owner": pa.array([key[0].as_py()], pa.int32()),
                "values": pa.array([found.astype("<u8" if key[1].as_py() == WORD else "<f4").tobytes()], pa.binary()),
            })

    return asked.groupBy("owner", "kind").applyInArrow(run, "block long, kind int, owner int, values binary")


def lm_scores(docs: DataFrame, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every document."""
    small_batches(docs)
    blocks = written(pack(docs, held_out), "blocks")
    size = blocks.agg(F.sum("size")).first()[0]
    owners = table_count(size, OWNER)
    asked = written(requests(blocks, owners), "requests")
    sums = totals(asked).toPandas()  # 1 + 65,536 rows at most
    words, nodes = sums[sums.kind == WORD], sums[sums.kind == WINDOW].sort_values("key")
    tokens, distinct = float(words.a.sum()), float(words.b.sum())
    top = top_levels(nodes["key"].to_numpy().astype(np.uint64), *(nodes[x].to_numpy(np.float64) for x in "abc"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scale = np.log10(tokens + 0.1 * (distinct + 1))

    def add_up(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        data, bounds, folds = _arrays(row)
        out: dict = {x: [] for x in ("n_tokens", "n_known", "base_score", "score")}
        for k in (WORD, WINDOW):
            parts = []
            for a, b in _parts(data, bounds):
                found, at = _keys(k, data, bounds, a, b)
                codes, distinct_keys = pd.factorize(found)
                parts.append((codes.astype(np.int32), distinct_keys, at))
            keys = np.unique(np.concatenate([d for _, d, _ in parts]))
            order, _ = _by_owner(k, keys, owners)
            own = right.filter(pc.equal(right["kind"], k)).sort_by("owner")
            values = np.empty(len(keys))
            values[order] = np.concatenate([np.frombuffer(x, "<u8" if k == WORD else "<f4") for x in own["values"].to_pylist()])
            for codes, distinct_keys, at in parts:
                value = values[np.searchsorted(keys, distinct_keys)]
                if k == WINDOW:
                    out["score"].append(segment_sums(value[codes], at))
                else:
                    out["n_tokens"].append(np.diff(at))
                    out["n_known"].append(segment_sums((value > 0)[codes], at))
                    out["base_score"].append(segment_sums((np.log10(value + 0.1) - scale)[codes], at))
        columns = {k: np.concatenate(v) for k, v in out.items()}
        return pa.table({
            "doc_id": left["ids"].combine_chunks().flatten(), "held_out": folds, "n_tokens": columns["n_tokens"].astype(np.int64), "n_known": columns["n_known"].astype(np.int64),
            "train_tokens": np.full(len(folds), int(tokens), np.int64), "base_score": columns["base_score"], "score": columns["score"],
        })

    pair = blocks.groupBy("block").cogroup(answers(asked, top).groupBy("block"))
    return pair.applyInArrow(add_up, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
