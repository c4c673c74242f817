"""Shared pieces of the operators: shared folder, written tables, batching, folds."""

from __future__ import annotations

import ctypes
import os
import pathlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text of a Python worker's unit of work. Arrow batches are cut at row bounds after about so many bytes.
PIECE_BYTES = 2 << 20


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, for sessions that were started without ``--py-files``."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = pathlib.Path(__file__).resolve().parents[2]
        target = os.path.join(tempfile.mkdtemp(prefix="tabsmith-code-"), "tabsmith_code.zip")
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted((root / "tabsmith").rglob("*.py")):
                z.write(f, f.relative_to(root))
        sc.addPyFile(target)
        _SHIPPED.add(sc.applicationId)


_SHIPPED: set[str] = set()


#: Bytes of an Arrow batch on its way to a Python worker, where the session leaves Spark's default of 64 MB.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> None:
    """Keep Python workers small: batches of ``BATCH_BYTES`` in this session, unless it says otherwise itself."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, "67108864b") in ("67108864b", "67108864", "64m", "64MB"):
        conf.set(name, str(BATCH_BYTES))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset, a local-mode session (tests, one machine) gets a scratch folder of its own; a
    cluster session without the setting is an error, as its executors share no local folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tabsmith-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(partition_by) if partition_by else out).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(key: str, mod: int) -> Column:
    """crc32 of the key as text, modulo ``mod``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % mod


def text_bytes(column: str = "text") -> Column:
    return F.coalesce(F.octet_length(F.col(column).cast("string")), F.lit(0)).cast("long")


def table_count(n_bytes: int, per: int) -> int:
    """Number of parts of about ``per`` bytes that ``n_bytes`` need, 1 at least."""
    return max(1, -(-int(n_bytes or 0) // per))


def bounded_sample(rows: DataFrame, n: int, seed: int, keys: list[str], group: str | None = None) -> DataFrame:
    """The ``n`` distinct rows (of each ``group``) that a seeded hash of ``keys`` puts first.

    A share is cut off by the hash before rows are ranked, so that about 2n rows meet in a task, whatever the
    table's size; repeated keys count once, also in a group's share, which goes by a sketch of its distinct keys.
    Without groups the keys must be distinct for a full sample.
    """
    names = [group] if group else []
    place = F.xxhash64(F.lit(seed), *keys)
    share = F.pmod(place, F.lit(1 << 30)) < (F.lit(float(1 << 30)) * (2 * n + 100) / F.col("__n"))
    if group:
        joined = rows.join(F.broadcast(rows.groupBy(group).agg(F.approx_count_distinct(place).alias("__n"))), group)  # one row a group
    else:
        joined = rows.withColumn("__n", F.lit(rows.count()))
    first = Window.partitionBy(*names, *([] if group else [F.lit(0)])).orderBy(place, *keys)
    picked = joined.where(share).drop("__n").dropDuplicates([*names, *keys])
    return picked.withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") <= n).drop("__rank")


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``limit`` bytes of text each; rows stay whole."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
        give_back()


def give_back() -> None:
    """Hand freed memory back to the system: several Python workers and a JVM share an executor's."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc() -> ctypes.CDLL | None:
    try:
        libc = ctypes.CDLL("libc.so.6")
        return libc if hasattr(libc, "malloc_trim") else None
    except OSError:
        return None


_LIBC = _libc()


def byte_slices(n: int, limit: int) -> Iterator[tuple[int, int]]:
    """[0, n) in slices of ``limit``."""
    for a in range(0, n, limit):
        yield a, min(a + limit, n)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the row bounds (n + 1). Null texts are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    column = pa.concat_arrays([column])  # drops the offset of a slice
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64, len(column) + 1, column.offset * 8)
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each i; 0 for an empty range."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def worker_cache(owner: str) -> dict:
    """A dict for state that every task would build again. It lives as long as the Python worker, or until another
    operator asks for its own: workers serve all operators of a session in turn, and only one's state counts."""
    if _CACHE.get("owner") != owner:
        _CACHE.clear()
        _CACHE["owner"] = owner
        give_back()
    return _CACHE


_CACHE: dict = {}
os.environ.setdefault("OMP_NUM_THREADS", "1")
