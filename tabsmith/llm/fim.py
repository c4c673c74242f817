"""Fill-in-middle transformation (operator 11): cuts are found by a piecewise-linear learned rank index.

A text is a run of lines; its boundaries are the byte offsets before, between and behind them. The map from a
boundary's rank to its offset is learned: line segments are fitted to all boundaries of a text, each good to
``epsilon`` bytes (a segment that misses by more is halved), and what a segment is off by at each boundary is
stored beside it in one byte. A cut is asked for by rank: its segment predicts an offset, the stored residual
makes it exact. Two cuts part the text into prefix, middle and suffix, written in one of two orders:

* ``psm``: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* ``spm``: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
* ``plain``: the text as it is, where it is empty, holds a marker, or the draw says so.

All draws come from the sha256 of ``seed:doc_id``, so that a task that runs again, or another layout of the
table, gives the same rows. ``restored`` rebuilds the text from output and form by built-in string functions.

Rows are independent: there is no exchange, and a task holds one Arrow batch.

Edge cases: a null text counts as empty (``plain``, no lines, empty output); a null id draws as the empty string;
repeated rows give repeated results; an empty table gives no rows; a kept column named like an output column is
replaced by it; carriage returns and other separators are part of a line, only line feeds end one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm.common import pieces, segment_sums, small_batches, utf8

#: Fixed values of the output format.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
OWN = ("n", "form", "prefix_chars", "middle_chars", "output")


@dataclass(frozen=True)
class Rule:
    """``seed`` of the draws; shares, in percent, of texts to be cut and of cut texts in the order ``spm``."""

    seed: int = 7
    cut_percent: int = 100
    spm_percent: int = 50


@dataclass
class RankIndex:
    """Boundary rank to offset, for several texts at once.

    Ranks count through all texts of the index; the boundaries of text t are ``rows[t]`` to ``rows[t + 1] - 1``.
    """

    first: np.ndarray  # first boundary of each segment
    base: np.ndarray  # its offset
    slope: np.ndarray  # bytes a boundary
    residual: np.ndarray  # of every boundary

    @classmethod
    def fit(cls, offsets: np.ndarray, rows: np.ndarray, epsilon: int = 127) -> RankIndex:
        """Segments of which none crosses texts and none is off by more than ``epsilon`` (at most 127)."""
        lo, hi = rows[:-1].astype(np.int64), rows[1:].astype(np.int64) - 1
        kept, residual = [], np.zeros(len(offsets), np.int8)
        while len(lo):
            slope = (offsets[hi] - offsets[lo]) / np.maximum(hi - lo, 1)
            count = hi - lo + 1
            start = np.cumsum(count) - count
            at = np.repeat(lo - start, count) + np.arange(count.sum())
            off = offsets[at] - _predicted(np.repeat(offsets[lo], count), np.repeat(slope, count), at - np.repeat(lo, count))
            good = np.maximum.reduceat(np.abs(off), start) <= epsilon
            inside = np.repeat(good, count)
            residual[at[inside]] = off[inside]
            kept.append((lo[good], offsets[lo[good]], slope[good]))
            lo, hi = lo[~good], hi[~good]
            mid = (lo + hi) // 2
            lo, hi = np.concatenate([lo, mid + 1]), np.concatenate([mid, hi])
        first, base, slope = (np.concatenate(x) if kept else np.zeros(0) for x in zip(*kept)) if kept else (np.zeros(0, np.int64),) * 3
        order = np.argsort(first)
        return cls(first[order], base[order], slope[order], residual)

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """Exact offsets of the boundaries with these ranks."""
        segment = np.searchsorted(self.first, ranks, side="right") - 1
        return _predicted(self.base[segment], self.slope[segment], ranks - self.first[segment]) + self.residual[ranks]


def _predicted(base: np.ndarray, slope: np.ndarray, steps: np.ndarray) -> np.ndarray:
    return base + np.rint(slope * steps).astype(np.int64)


def line_boundaries(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets, from its beginning, of each text's line boundaries, and the texts' bounds among them (texts + 1)."""
    n = len(bounds) - 1
    ends = np.flatnonzero(data == 10) + 1
    size = np.diff(bounds)
    open_end = np.flatnonzero(size > 0)
    open_end = open_end[data[bounds[open_end + 1] - 1] != 10]  # texts without a line feed at the end
    text = np.concatenate([np.arange(n), np.searchsorted(bounds, ends - 1, side="right") - 1, open_end])
    offset = np.concatenate([np.zeros(n, np.int64), ends, bounds[open_end + 1]])
    offset[n:] -= bounds[text[n:]]
    order = np.lexsort((offset, text))
    return offset[order], np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))])


def _draws(id_column: str, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"__h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, keep: list[str], rule: Rule = Rule(), id_column: str = "doc_id") -> DataFrame:
    """``keep`` and, for each text: ``n`` lines, ``form``, ``prefix_chars``, ``middle_chars``, ``output``."""
    small_batches(docs)
    carried = [F.col(f"`{c}`") for c in keep if c not in OWN]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = F.instr(text, PREFIX) + F.instr(text, SUFFIX) + F.instr(text, MIDDLE) > 0
    rows = docs.select(F.struct(*carried).alias("__kept") if carried else F.struct(F.lit(0).alias("none")).alias("__kept"), text.alias("__text"), marked.alias("__marked"), *_draws(id_column, rule.seed))
    fields = [
        T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
    ]
    schema = T.StructType([rows.schema["__kept"], *fields])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            yield pa.RecordBatch.from_arrays([batch.column("__kept"), *_transformed(batch, rule)], names=schema.names)

    out = rows.mapInArrow(cut, schema)
    return out.select(*([F.col("__kept.*")] if carried else []), *OWN)


def _transformed(batch: pa.RecordBatch, rule: Rule) -> list[pa.Array]:
    data, bounds = utf8(batch.column("__text"))
    offsets, rows = line_boundaries(data, bounds)
    index = RankIndex.fit(offsets, rows)
    n = np.diff(rows) - 1
    h1, h2, h3, h4 = (batch.column(f"__h{i}").to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4))
    ranks = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0) + rows[:-1]
    left, right = bounds[:-1] + index.select(ranks[0]), bounds[:-1] + index.select(ranks[1])
    marked = batch.column("__marked").to_numpy(zero_copy_only=False).astype(bool)
    plain = (n == 0) | marked | (h3 % 100 >= rule.cut_percent)
    spm = ~plain & (h4 % 100 < rule.spm_percent)
    char = ((data & 0xC0) != 0x80).astype(np.int64)  # a code point begins at each byte that continues none
    ends = np.stack([bounds[:-1], left, right], axis=1).ravel()
    chars = segment_sums(char, np.append(ends, len(data))).astype(np.int64)
    whole = data.tobytes()
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    output = []
    for a, b, c, d, is_plain, is_spm in zip(bounds[:-1].tolist(), left.tolist(), right.tolist(), bounds[1:].tolist(), plain.tolist(), spm.tolist()):
        if is_plain:
            output.append(whole[a:d])
        elif is_spm:
            output.append(b"".join((s, whole[c:d], p, whole[a:b], m, whole[b:c])))
        else:
            output.append(b"".join((p, whole[a:b], s, whole[c:d], m, whole[b:c])))
    return [
        pa.array(n, pa.int64()),
        pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(), pa.string()),
        pa.array(chars[0::3], pa.int64(), mask=plain),
        pa.array(chars[1::3], pa.int64(), mask=plain),
        pa.array(output, pa.binary()).cast(pa.string()),
    ]


def restored(output: Column, form: Column) -> Column:
    """The text, rebuilt from output and form. No cut text holds a marker, so each stands once in an output."""

    def between(opening: str, closing: str) -> Column:
        return F.substring_index(F.substring_index(output, opening, -1), closing, 1)

    middle = F.substring_index(output, MIDDLE, -1)
    return (
        F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
        .when(form == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX)))
        .otherwise(output)
    )
