"""Toxicity (operator 5): a convolutional text classifier, trained here in numpy by Spark's tasks.

A word (lower case, cut at anything in ASCII but letters and digits) is embedded as a sum of rows of a hashed
table: two for the word itself, so that words seldom share both, and one each for its first 4 and 6 bytes,
which inflected forms share. Filters of several widths slide over the word embeddings; the largest response of each filter
over the whole text feeds a logistic unit. The score is that probability, moved in log-odds by a shift for
the text's predicted language (operator 1's model, never the ``lang`` column) so that the language's best
threshold on the validation texts falls on ``THRESHOLD``.

Every labelled document that has a text takes part, with its whole text: four fifths (by a hash of the text, so that
copies stay together) train the network, the last fifth sets the thresholds. The training texts lie in shards of about
``SAMPLE`` texts. In each of ``ROUNDS`` rounds every task goes through its shard from the common weights on, and the mean of
what the shards changed goes into the common weights (a row of the table: the mean over the shards that met it).
Both classes weigh the same in training; the bias is corrected for their shares afterwards. The driver and each task hold
the weights, about 25 MB, and a task ``SEGMENT`` hashed words; no text reaches the driver. Thresholds come from
counts of all validation texts by language, class and log-odds on a grid of 1 / ``GRID``.

Training and scoring take every word of every text, ``SLICE`` words at a time: the largest response over a text is the
largest over its slices.

Short runs of words from clean texts are trained on as clean texts of their own, so that brevity is no sign.

Edge cases: null texts count as empty; texts without words have score 0; unlabelled,
null-labelled and repeated label rows teach nothing or, repeated, count once; without a labelled row of each
class every score is 0, and a warning says so. One row out for each row in. Of the input's other columns the named
ones are carried on; one named ``score`` or ``predicted`` is replaced.
"""

from __future__ import annotations

import copy
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm import langid
from tabsmith.llm.common import byte_slices, give_back, pieces, small_batches, table_count, utf8, written
from tabsmith.llm.words import NOT_ALNUM, span_hashes, word_spans

THRESHOLD = 0.3
#: Labelled texts of a shard, about; rounds after which the shards' weights are averaged; texts of a step.
SAMPLE = 8000
ROUNDS = 4
BATCH = 64
#: Hashed words that a task trains on at a time (16 bytes each).
SEGMENT = 1 << 21
#: Labelled ids that are sent to every executor at most; more are joined by a shuffle.
BROADCAST = 1 << 20
#: Log-odds of validation texts are counted by steps of 1 / GRID, and as EXTREME beyond it.
GRID = 256
EXTREME = 16
#: Words that are scored at a time, bytes that are cut into words at a time.
SLICE = 1 << 16
SLICE_BYTES = 1 << 19
#: Rows of the table: two parts for whole words, two for beginnings.
PARTS = (1 << 18, 1 << 18, 1 << 16, 1 << 16)
BEGINNINGS = (4, 6)
#: Rows of the table that are averaged together, and the unit of the exact sums, which the order cannot change.
BLOCK = 10_240
UNIT = 2.0**-36
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 12


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The table rows of each word (words x 4), and the texts' bounds in words."""
    data, bounds = utf8(text)
    cuts = [0]
    while cuts[-1] < len(data):  # between words, so that none is cut
        end = min(cuts[-1] + SLICE_BYTES, len(data))
        gap = np.flatnonzero(NOT_ALNUM[data[cuts[-1] : end]])
        if end < len(data):
            end = cuts[-1] + int(gap[-1]) + 1 if len(gap) else _next_gap(data, end)
        cuts.append(end)
    rows, at = [], np.zeros(len(bounds), np.int64)
    for a, b in zip(cuts, cuts[1:]):
        own, begin = _tokens(data[a:b], np.clip(bounds, a, b) - a)
        at += begin
        rows.append(own)
    return np.concatenate(rows) if rows else np.zeros((0, len(PARTS)), np.int32), at


def _next_gap(data: np.ndarray, at: int) -> int:
    while at < len(data):
        gap = np.flatnonzero(NOT_ALNUM[data[at : at + SLICE_BYTES]])
        if len(gap):
            return at + int(gap[0]) + 1
        at += SLICE_BYTES
    return len(data)


def _tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, at = word_spans(data, bounds, NOT_ALNUM)
    whole = span_hashes(data, starts, ends)
    hashes = [whole, whole >> np.uint64(40)] + [span_hashes(data, starts, np.minimum(ends, starts + n)) for n in BEGINNINGS]
    first = np.concatenate([[0], np.cumsum(PARTS)[:-1]])
    return np.stack([(h % np.uint64(n)).astype(np.int32) + np.int32(f) for h, n, f in zip(hashes, PARTS, first)], axis=1), at


class Network:
    def __init__(self, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.table = rng.normal(0, 0.1, (sum(PARTS), DIM)).astype(np.float32)
        self.filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.out_bias = np.float32(0)

    def embed(self, rows: np.ndarray) -> np.ndarray:
        return self.table[rows[:, 0]] + self.table[rows[:, 1]] + self.table[rows[:, 2]] + self.table[rows[:, 3]]

    def pooled(self, emb: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest response of each filter in each text (texts x filters, 0 at least) and the places."""
        count, n = np.diff(rows), len(rows) - 1
        best, places = [], []
        left = np.repeat(rows[1:], count) - np.arange(len(emb))  # words from here to the text's end
        for filt, bias in zip(self.filters, self.bias):
            width = len(filt)
            value = emb @ filt[0]
            for j in range(1, width):
                value[:-j] += (emb @ filt[j])[j:]
            value += bias
            value[left < width] = 0
            top = np.zeros((n, FILTERS), np.float32)
            full = count > 0
            if full.any():
                top[full] = np.maximum.reduceat(value, rows[:-1][full], axis=0)
            best.append(np.maximum(top, 0))
            places.append(value)
        return np.concatenate(best, axis=1), places

    def log_odds(self, words: np.ndarray, rows: np.ndarray) -> np.ndarray:
        top = np.zeros((len(rows) - 1, len(self.out)), np.float32)
        for a, b in byte_slices(len(words), SLICE):
            b = min(b + max(WIDTHS) - 1, len(words))  # a filter that begins at a slice's end sees the words behind
            held = slice(np.searchsorted(rows[1:], a, side="right"), np.searchsorted(rows[:-1], b))
            cut = np.clip(np.append(rows[:-1][held], rows[1:][held][-1:]), a, b) - a
            top[held] = np.maximum(top[held], self.pooled(self.embed(words[a:b]), cut)[0])
        return (top @ self.out + self.out_bias).astype(np.float64)

    def winners(self, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each text, and the first word of its first place (-1: no response)."""
        top = np.zeros((len(rows) - 1, len(self.out)), np.float32)
        place = np.full(top.shape, -1, np.int64)
        for a, b in byte_slices(len(words), SLICE):
            b = min(b + max(WIDTHS) - 1, len(words))
            held = slice(np.searchsorted(rows[1:], a, side="right"), np.searchsorted(rows[:-1], b))
            cut = np.clip(rows[held.start : held.stop + 1], a, b) - a
            best, values = self.pooled(self.embed(words[a:b]), cut)
            text = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
            goal = np.where(best > top[held], best, np.inf)
            for k, value in enumerate(values):
                at, f = np.nonzero(value == goal[text, k * FILTERS : (k + 1) * FILTERS])
                place[held.start + text[at[::-1]], k * FILTERS + f[::-1]] = a + at[::-1]  # of equal places the first stays
            top[held] = np.maximum(top[held], best)
        return top, place

    def step(self, words: np.ndarray, rows: np.ndarray, label: np.ndarray, rate: float, memory: dict, weight: np.ndarray | float = 1.0) -> None:
        """One Adagrad step on a batch; only the winning place of each filter carries a gradient. A row of the table
        has one rate."""
        top, place = self.winners(words, rows)
        p = 1 / (1 + np.exp(-(top @ self.out + self.out_bias)))
        err = ((p - label) * weight / len(label)).astype(np.float32)

        def move(name, target, gradient):
            memory[name] = memory.get(name, 1e-6) + gradient * gradient
            target -= rate * gradient / np.sqrt(memory[name])

        places, moves = [], []
        for k, filt in enumerate(self.filters):
            text, f = np.nonzero(place[:, k * FILTERS : (k + 1) * FILTERS] >= 0)
            at = place[text, k * FILTERS + f]
            g = err[text] * self.out[k * FILTERS + f]
            by_filter = (f[:, None] == np.arange(FILTERS)) * g[:, None]
            grad_f = np.stack([self.embed(words[at + j]).T @ by_filter for j in range(len(filt))])
            for j in range(len(filt)):
                places.append(at + j)
                moves.append(g[:, None] * filt[j].T[f])
            move(("f", k), filt, grad_f)
            move(("b", k), self.bias[k], by_filter.sum(axis=0))
        move("o", self.out, err @ top)
        memory["ob"] = memory.get("ob", 1e-6) + float(err.sum()) ** 2
        self.out_bias = np.float32(self.out_bias - rate * err.sum() / np.sqrt(memory["ob"]))
        at, back = np.unique(words[np.concatenate(places)].ravel(), return_inverse=True)
        g = np.zeros((len(at), DIM), np.float32)
        np.add.at(g, back, np.repeat(np.concatenate(moves), words.shape[1], axis=0))
        held = memory.setdefault("t", np.full((len(self.table), 1), 1e-6, np.float32))
        held[at] += np.mean(g * g, axis=1, keepdims=True)
        self.table[at] -= rate * g / np.sqrt(held[at])

    def dense(self, memory: dict) -> tuple[np.ndarray, np.ndarray]:
        """All weights but the table, end to end, and their squared gradients."""
        own = {("f", k): x for k, x in enumerate(self.filters)} | {("b", k): x for k, x in enumerate(self.bias)} | {"o": self.out, "ob": np.array([self.out_bias])}
        held = [np.broadcast_to(memory.get(n, 1e-6), x.shape).ravel() for n, x in own.items()]
        return np.concatenate([x.ravel() for x in own.values()]).astype(np.float64), np.concatenate(held).astype(np.float64)

    def set_dense(self, memory: dict, values: np.ndarray, held: np.ndarray) -> None:
        own = {("f", k): x for k, x in enumerate(self.filters)} | {("b", k): x for k, x in enumerate(self.bias)} | {"o": self.out}
        a = 0
        for name, x in own.items():
            x[...] = values[a : a + x.size].reshape(x.shape)
            memory[name] = held[a : a + x.size].reshape(x.shape).astype(np.float32)
            a += x.size
        self.out_bias, memory["ob"] = np.float32(values[a]), float(held[a])


def gather(words: np.ndarray, rows: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = [words[rows[i] : rows[i + 1]] for i in pick]
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])


class Classifier:
    def __init__(self, network: Network | None, shifts: dict[str, float], language: langid.Model):
        self.network, self.shifts, self.language = network, shifts, language

    def scores(self, text: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.zeros(len(text))
        words, rows = tokens(text)
        odds = self.network.log_odds(words, rows)
        odds += np.array([self.shifts.get(x, self.shifts[""]) for x in self.language.predict(text)[0]])
        return np.where(np.diff(rows) > 0, 1 / (1 + np.exp(-odds)), 0.0)


def best_shift(odds: np.ndarray, label: np.ndarray, weight: np.ndarray) -> float:
    """The shift that puts the threshold of the best F1 of the weighted texts (middle of ties) on ``THRESHOLD``."""
    goal = np.log(THRESHOLD / (1 - THRESHOLD))
    order = np.argsort(-odds)
    hit = np.cumsum((label * weight)[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + (label * weight).sum())
    last = np.append(np.diff(odds[order]) < 0, True)  # no threshold lies between equal odds
    k = int(np.where(last, f1, -1).argmax())
    below = odds[order[k + 1]] if k + 1 < len(odds) else odds[order[k]] - 1
    return float(goal - (odds[order[k]] + below) / 2)


def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashed words, bounds and labels of the texts, about ``SEGMENT`` words at a time."""
    words, sizes, label = [], [], []
    for part in pieces(batches):
        own, at = tokens(part.column("text"))
        words.append(own)
        sizes.append(np.diff(at))
        label.append(part.column("__toxic").to_numpy())
        if sum(map(len, words)) >= SEGMENT:
            yield _joined(words, sizes, label)
            words, sizes, label = [], [], []
    if words:
        yield _joined(words, sizes, label)


def _joined(words: list, sizes: list, label: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.concatenate(words), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(label).astype(np.float32)


def train_on(network: Network, memory: dict, parts: Iterator[tuple], passes: int, weights: tuple[float, float], seed: int) -> None:
    """Take ``passes`` passes over each segment of a shard."""
    rng = np.random.Generator(np.random.PCG64(seed))
    for words, at, label in parts:
        weight = np.where(label == 1, weights[1], weights[0]).astype(np.float32)
        for _ in range(passes):
            for part in np.array_split(rng.permutation(len(label)), max(1, len(label) // BATCH)):
                own, rows = gather(words, at, part)
                crops = [(r, int(rng.integers(rows[r], rows[r + 1])), int(rng.integers(1, 13))) for r in np.flatnonzero((label[part] == 0) & (np.diff(rows) > 0))[::2]]
                short = [own[first : min(first + n, rows[r + 1])] for r, first, n in crops]  # parts of clean texts are clean
                rows = np.concatenate([rows, rows[-1] + np.cumsum([len(x) for x in short], dtype=np.int64)])
                none = np.zeros(len(short), np.float32)
                network.step(np.concatenate([own, *short]), rows, np.append(label[part], none), 0.05, memory, np.append(weight[part], none + np.float32(weights[0])))


CHANGES = "block int, at binary, step binary, held binary"


def _changes(block: int, at: np.ndarray, step: np.ndarray, held: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "at": [at.astype("<i4").tobytes()], "step": [step.astype("<f4").tobytes()], "held": [held.astype("<f4").tobytes()]})


def _read_changes(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.frombuffer(row["at"], "<i4")
    return at, np.frombuffer(row["step"], "<f4").reshape(len(at), -1), np.frombuffer(row["held"], "<f4").reshape(len(at), 1)


def mean_changes(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean of the shards' changes to a block's rows, each over the shards that met the row."""
    sums = None
    for part in parts:
        for row in part.select(["at", "step", "held"]).to_pylist():
            at, step, held = _read_changes(row)
            if sums is None:
                sums, count = np.zeros((BLOCK, step.shape[1] + 1), np.int64), np.zeros(BLOCK, np.int64)
            sums[at] += np.rint(np.clip(np.append(step, held, axis=1).astype(np.float64), -1024, 1024) / UNIT).astype(np.int64)
            count[at] += 1
    at = np.flatnonzero(count)
    mean = sums[at] * UNIT / count[at][:, None]
    yield _changes(key[0].as_py(), at, mean[:, :-1], mean[:, -1])


def one_round(train: DataFrame, network: Network, memory: dict, passes: int, weights: tuple[float, float], seed: int) -> None:
    """Every shard is trained on from the given weights; they become the mean of what comes out."""
    held = train.sparkSession.sparkContext.broadcast((network, memory))  # bounded by PARTS
    dense_block = sum(PARTS) // BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, squares = held.value
        own, mine = copy.deepcopy((start, squares))  # the worker's other tasks start from the same weights
        train_on(own, mine, segments(batches), passes, weights, seed)
        if "t" not in mine:
            return  # no text
        old = squares["t"]
        at = np.flatnonzero(mine["t"] > old)
        for block in np.unique(at // BLOCK):
            rows = at[at // BLOCK == block]
            yield _changes(block, rows - block * BLOCK, own.table[rows] - start.table[rows], mine["t"][rows] - old[rows])
        (values, ends), (first, begun) = own.dense(mine), start.dense(squares)
        yield _changes(dense_block, np.arange(len(values)), values - first, ends - begun)

    found = train.mapInArrow(run, CHANGES).groupBy("block").applyInArrow(mean_changes, CHANGES).toArrow()  # bounded by PARTS
    for row in (row for batch in found.to_batches(max_chunksize=1) for row in batch.to_pylist()):
        at, step, more = _read_changes(row)
        if row["block"] == dense_block:
            values, squares = network.dense(memory)
            values[at] += step[:, 0]
            squares[at] += more[:, 0]
            network.set_dense(memory, values, squares)
        else:
            network.table[at + row["block"] * BLOCK] += step
            memory["t"][at + row["block"] * BLOCK] += more
    held.destroy()


def odds_counts(texts: DataFrame, classifier: Classifier) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Predicted language, log-odds on the grid, class and number of the texts."""
    held = texts.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            odds = np.clip(held.value.network.log_odds(*tokens(part.column("text"))), -EXTREME, EXTREME)
            lang = pa.array(held.value.language.predict(part.column("text"))[0], pa.string())
            yield pa.RecordBatch.from_pydict({"lang_pred": lang, "step": np.rint(odds * GRID).astype(np.int32), "toxic": part.column("__toxic")})

    counts = texts.mapInArrow(run, "lang_pred string, step int, toxic int").groupBy("lang_pred", "step", "toxic").agg(F.count(F.lit(1)).alias("n"))
    got = counts.orderBy("lang_pred", "step", "toxic").toArrow()  # bounded by GRID, EXTREME and the languages
    return np.array(got["lang_pred"].to_pylist(), object), got["step"].to_numpy() / GRID, got["toxic"].to_numpy().astype(float), got["n"].to_numpy().astype(float)


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = 1000) -> Classifier:
    """Learn from all ``documents`` (doc_id, text, lang) that have a ``toxic`` label of 0 or 1, in shards of about
    ``sample`` texts; the fewer steps a pass has, the more passes are made."""
    small_batches(documents)
    language = langid.fit(documents)
    marks = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("__toxic"))
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    marks = written(marks.join(rows.select("doc_id").distinct(), "doc_id", "left_semi"), "marks")
    usable = {r["__toxic"]: r["n"] for r in marks.groupBy("__toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(usable) < 2:
        warnings.warn(f"toxicity: labelled documents by class: {usable}; nothing is learned, every score is 0", stacklevel=2)
        return Classifier(None, {"": 0.0}, language)
    total = sum(usable.values())
    rows = rows.join(F.broadcast(marks) if total <= BROADCAST else marks, "doc_id").repartition(table_count(total, sample), "doc_id")
    rows = rows.dropDuplicates(["doc_id", "text"]).withColumn("__check", F.pmod(F.xxhash64(F.lit(23), "text"), F.lit(5)) == 0)
    rows = rows.sortWithinPartitions("__check", F.xxhash64(F.lit(29), "doc_id"), "doc_id", "text")
    rows = written(rows, "labelled", "__check")
    count = {(r["__check"], r["__toxic"]): r["n"] for r in rows.groupBy("__check", "__toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    split = (False, 0) in count and (False, 1) in count  # else too few for both: all train
    train = rows.where(~F.col("__check")) if split else rows
    number = {c: count.get((False, c), 0) + (0 if split else count.get((True, c), 0)) for c in (0, 1)}
    weights = tuple(sum(number.values()) / (2 * number[c]) for c in (0, 1))
    batches = max(1, sum(number.values()) // BATCH)
    passes = min(30, -(-int(steps * table_count(total, sample) ** 0.5) // batches))
    network, memory = Network(), {"t": np.full((sum(PARTS), 1), 1e-6, np.float32)}
    for seed in range(ROUNDS):
        one_round(train.select("text", "__toxic"), network, memory, -(-passes // ROUNDS), weights, seed)
    network.out_bias += np.float32(np.log(number[1] / number[0]))
    lang, odds, label, weight = odds_counts(rows.where(F.col("__check")).select("text", "__toxic"), Classifier(network, {"": 0.0}, language))
    shifts = {"": best_shift(odds, label, weight) if label.any() else 0.0}
    for name in np.unique(lang):
        own = lang == name
        if (label * weight)[own].sum() >= 10:
            shifts[str(name)] = best_shift(odds[own], label[own], weight[own])
    give_back()
    return Classifier(network, shifts, language)


def score(docs: DataFrame, classifier: Classifier, columns: list[str]) -> DataFrame:
    """``columns`` of every document with ``score`` and ``predicted`` (score >= THRESHOLD)."""
    small_batches(docs)
    held = docs.sparkSession.sparkContext.broadcast(classifier)  # bounded by PARTS and operator 1's sample
    source = docs.select(*[c for c in columns if c not in ("score", "predicted")], F.col("text").cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "__text"):
            own = {n: part.column(n) for n in part.schema.names if n != "__text"}
            yield pa.RecordBatch.from_pydict(own | {"score": held.value.scores(part.column("__text"))})

    scored = source.mapInArrow(run, f"{kept}, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
