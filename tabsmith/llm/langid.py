"""Language ID (operator 1): prediction by partial matching.

Each language has a byte context tree of orders 0 .. K, kept as sorted arrays of (context, byte) counts. The
statistics are frozen after training. A byte costs -log2 of its probability under method C: in the longest
context the language has seen, count / (n + d); for a byte unseen there, the escape d / (n + d) and on to the
next shorter context, down to 1 / 256 (n: bytes seen in the context, d: distinct ones). The language with the
smallest total code length over the whole text wins; ties go to the smaller name.

Training takes a bounded sample: at most ``SAMPLE_DOCS`` different texts a language, the first by a seeded
hash, of at most ``SAMPLE_TEXT`` bytes each; longer texts give a seeded slice of that size. A language's sample is
counted by ``COUNTERS`` tasks. Prediction takes every byte of every text, in slices of ``SLICE`` bytes that see the
bytes before them, so that memory doesn't go by a text's length.

Edge cases: null texts and texts without a letter are ``und`` with score 0; so is everything if nothing could
be learned. Rows are never dropped, repeated ids give repeated rows; ties go to the smaller name. A kept column named
like an output column is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import bounded_sample, byte_slices, give_back, pieces, small_batches, utf8, worker_cache

ORDER = 4
SAMPLE_DOCS = 1000
SAMPLE_TEXT = 8 << 10
COUNTERS = 4
SLICE = 1 << 19
#: Known windows that a worker keeps with their costs; beyond, it starts anew.
KEEP = 1 << 20


def windows(data: np.ndarray, bounds: np.ndarray, length: int, pad: int = 10) -> np.ndarray:
    """For each byte the ``length`` bytes that end in it as one number; before a text stands ``pad``."""
    key, have = data.astype(np.uint64), 1
    while have < length:  # double the bytes that a key holds
        more = min(have, length - have)
        key[have:] |= (key[:-have] & np.uint64((1 << 8 * more) - 1)) << np.uint64(8 * have)
        have += more
    # the first bytes of each text must not see the text before
    pads = np.uint64(int.from_bytes(bytes([pad]) * 8, "big"))
    for seen in range(1, length):
        at = bounds[:-1] + seen - 1
        at = at[at < bounds[1:]]
        low = np.uint64((1 << 8 * seen) - 1)
        key[at] = (key[at] & low) | (pads & ~low & np.uint64((1 << 8 * length) - 1))
    return key


class Tree:
    """Frozen statistics of one language: for each order the costs in bits of seen bytes, and of escapes."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, order: int = ORDER):
        self.order, self.levels = order, []
        for k in range(order + 1):
            seen, inverse = np.unique(grams & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n_seen = np.bincount(inverse, counts, len(seen))
            context, of = np.unique(seen >> np.uint64(8), return_inverse=True)
            n, d = np.bincount(of, n_seen, len(context)), np.bincount(of, minlength=len(context))
            self.levels.append((seen, np.log2((n + d)[of] / n_seen), context, np.log2((n + d) / d)))

    def costs(self, grams: np.ndarray) -> np.ndarray:
        cost, open_ = np.zeros(len(grams)), np.arange(len(grams))
        for k in range(self.order, -1, -1):
            seen, hit_cost, context, escape = self.levels[k]
            if not len(seen):
                continue
            key = grams[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(seen, key), len(seen) - 1)
            hit = seen[at] == key
            cost[open_[hit]] += hit_cost[at[hit]]
            open_, key = open_[~hit], key[~hit] >> np.uint64(8)
            at = np.minimum(np.searchsorted(context, key), len(context) - 1)
            known = context[at] == key
            cost[open_[known]] += escape[at[known]]
        cost[open_] += 8.0
        return cost


class Model:
    def __init__(self, trees: dict[str, Tree], token: str):
        self.names, self.token = sorted(trees), token
        self.trees = [trees[x] for x in self.names]

    def code_lengths(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text (rows) under each language (columns), and the texts' bytes."""
        data, bounds = utf8(pc.utf8_lower(pc.fill_null(text, "").cast(pa.large_string())))
        out = np.zeros((len(text), len(self.names)))
        if len(data) and self.names:
            for a, b in byte_slices(len(data), SLICE):
                self._add(out, data, bounds, a, b)
        return out, np.diff(bounds)

    def _add(self, out: np.ndarray, data: np.ndarray, bounds: np.ndarray, a: int, b: int) -> None:
        """Add the bits of the bytes a .. b to the texts' totals."""
        order = self.trees[0].order
        lo = max(0, a - order)
        cuts = np.unique(np.clip(bounds, lo, b)) - lo
        codes, grams = pd.factorize(windows(data[lo:b], cuts, order + 1)[a - lo :])
        rank = np.argsort(grams)
        costs = np.empty((len(grams), len(self.names)), np.float32)
        costs[rank] = self._known(grams[rank])
        texts = np.flatnonzero((bounds[:-1] < b) & (bounds[1:] > a) & (np.diff(bounds) > 0))
        first = np.maximum(bounds[texts] - a, 0)
        for j in range(len(self.names)):
            out[texts, j] += np.add.reduceat(costs[:, j][codes], first, dtype=np.float64)

    def _known(self, grams: np.ndarray) -> np.ndarray:
        """Costs (grams x languages); windows met before in this worker are looked up."""
        cache = worker_cache("language")
        if cache.get("ppm") is None or cache["ppm"][0] != self.token or len(cache["ppm"][1]) > KEEP:
            cache["ppm"] = (self.token, np.zeros(0, np.uint64), np.zeros((0, len(self.names)), np.float32))
        _, old, old_costs = cache["ppm"]
        at = np.minimum(np.searchsorted(old, grams), max(0, len(old) - 1))
        new = grams[old[at] != grams] if len(old) else grams
        if len(new):
            new_costs = np.stack([t.costs(new) for t in self.trees], axis=1).astype(np.float32)
            keys = np.concatenate([old, new])
            order = np.argsort(keys, kind="stable")
            old, old_costs = keys[order], np.concatenate([old_costs, new_costs])[order]
            cache["ppm"] = (self.token, old, old_costs)
            at = np.searchsorted(old, grams)
        return old_costs[at]

    def predict(self, text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, posterior under equal priors, and bits a byte of the best language, for each text."""
        bits, size = self.code_lengths(text)
        letter = pc.fill_null(pc.match_substring_regex(pc.fill_null(text, "").cast(pa.large_string()), r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if not self.names:
            return ["und"] * len(text), np.zeros(len(text)), np.zeros(len(text))
        best = bits.argmin(axis=1)
        least = bits.min(axis=1)
        score = 1 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(axis=1)
        names = np.array([*self.names, "und"], object)
        return list(names[np.where(letter, best, -1)]), np.where(letter, score, 0.0), least / np.maximum(size, 1)


def fit(train: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_text: int = SAMPLE_TEXT, order: int = ORDER) -> Model:
    """Learn from ``train`` (text, lang); rows without text, letter or lang teach nothing."""
    small_batches(train)
    rows = train.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    size = F.octet_length("text")
    first = F.pmod(F.xxhash64(F.lit(17), "text"), size - sample_text + 1).cast("int") + 1
    part = F.make_valid_utf8(F.substring(F.col("text").cast("binary"), first, F.lit(sample_text)).cast("string"))
    part = F.btrim(part, F.lit("\ufffd"))  # characters cut at the ends
    rows = rows.withColumn("text", F.when(size <= sample_text, F.col("text")).otherwise(part))
    rows = bounded_sample(rows, sample_docs, 11, ["text"], "lang")

    def count(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(parts))
        data, bounds = utf8(pc.utf8_lower(table["text"].combine_chunks().cast(pa.large_string())))
        grams, n = np.unique(windows(data, bounds, order + 1), return_counts=True)
        yield pa.RecordBatch.from_pydict({"lang": [key[0].as_py()], "grams": [grams.astype("<u8").tobytes()], "counts": [n.astype("<i4").tobytes()]})

    # COUNTERS rows a language, together of at most sample_docs * sample_text windows
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(F.lit(19), "text"), F.lit(COUNTERS)))
    learned = dealt.groupBy("lang", "__part").applyInArrow(count, "lang string, grams binary, counts binary").collect()
    trees = {}
    for name in sorted({r["lang"] for r in learned}):
        own = [r for r in learned if r["lang"] == name]
        grams, inverse = np.unique(np.concatenate([np.frombuffer(r["grams"], "<u8") for r in own]), return_inverse=True)
        trees[name] = Tree(grams, np.bincount(inverse, np.concatenate([np.frombuffer(r["counts"], "<i4") for r in own])), order)
    token = str(hash(tuple(sorted((r["lang"], hash(bytes(r["grams"]))) for r in learned))))
    del learned
    give_back()  # on the driver, too
    return Model(trees, token)


def identify(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    """``columns`` of every document with ``lang_pred``, ``score`` and ``bits_per_byte``."""
    small_batches(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    source = docs.select(*[c for c in columns if c not in ("lang_pred", "score", "bits_per_byte")], F.col("text").cast("string").alias("text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            lang, score, rate = held.value.predict(part.column("text"))
            columns_ = {n: part.column(n) for n in part.schema.names if n != "text"}
            yield pa.RecordBatch.from_pydict(columns_ | {"lang_pred": pa.array(lang, pa.string()), "score": score, "bits_per_byte": rate})

    return source.mapInArrow(run, f"{kept}, lang_pred string, score double, bits_per_byte double")
