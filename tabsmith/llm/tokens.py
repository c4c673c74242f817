"""Token counts (operator 3) and SentencePiece encoding and decoding (operator 4) over tables of texts.

Both send the model file's bytes to the tasks (a file of bounded size) and build the lattice once a worker; see
``unigram`` for the rules. Counting keeps only best score and piece count; encoding is a streaming Viterbi that
commits ids as soon as all surviving paths share a boundary. Texts are taken whole, in batches of whole rows.

Edge cases: null texts count as empty: 0 pieces, score 0, no ids, decoded to the empty text. The round trip is
exact but for texts that hold U+2581 itself, which reads back as a space, as in the public library. One row out
for each row in; columns not named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.common import pieces, small_batches, worker_cache
from tabsmith.llm.unigram import Lattice

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:  # on the driver; the tasks get the bytes
        return f.read()


def lattice(model: bytes) -> Lattice:
    cache = worker_cache("tokens")
    if cache.get("model") != model:
        cache["model"], cache["lattice"] = model, Lattice(model)
    return cache["lattice"]


def _source(docs: DataFrame, columns: list[str]) -> tuple[DataFrame, str]:
    source = docs.select(*columns, F.col("text").cast("string").alias("__text"))
    return source, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "__text")


def _own(part: pa.RecordBatch) -> dict:
    return {n: part.column(n) for n in part.schema.names if n != "__text"}


def count_tokens(docs: DataFrame, model: bytes, columns: list[str]) -> DataFrame:
    """``columns``, n_tokens and best_score of every text."""
    small_batches(docs)
    source, kept = _source(docs, columns)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(held.value)
        for part in pieces(batches, "__text"):
            found = [own.count(t or "") for t in part.column("__text").to_pylist()]
            yield pa.RecordBatch.from_pydict(_own(part) | {"n_tokens": pa.array([n for n, _ in found], pa.int64()), "best_score": pa.array([s for _, s in found], pa.float64())})

    return source.mapInArrow(run, f"{kept}, n_tokens long, best_score double")


def encode(docs: DataFrame, model: bytes, columns: list[str]) -> DataFrame:
    """``columns``, ids, n_ids and ``round_trip`` (whether the ids decode to the text) of every text."""
    small_batches(docs)
    source, kept = _source(docs, columns)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(held.value)
        for part in pieces(batches, "__text"):
            flat, bounds, proof = [], [0], []
            for text in part.column("__text").to_pylist():
                ids = own.encode(text or "")
                proof.append(own.decode(ids) == (text or ""))
                flat.extend(ids)
                bounds.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(bounds, np.int32)), pa.array(np.array(flat, np.int32)))
            yield pa.RecordBatch.from_pydict(_own(part) | {"ids": ids, "n_ids": np.diff(bounds).astype(np.int64), "round_trip": proof})

    return source.mapInArrow(run, f"{kept}, ids array<int>, n_ids long, round_trip boolean")


def decode(encoded: DataFrame, model: bytes, columns: list[str]) -> DataFrame:
    """``columns`` and ``decoded`` of every list of ``ids``."""
    small_batches(encoded)
    source = encoded.select(*columns, F.col("ids").alias("__ids"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "__ids")
    held = encoded.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(held.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [own.decode(x if x is not None else []) for x in part.column("__ids").to_pylist()]
                yield pa.RecordBatch.from_pydict({n: part.column(n) for n in part.schema.names if n != "__ids"} | {"decoded": pa.array(texts, pa.string())})

    return source.mapInArrow(run, f"{kept}, decoded string")
