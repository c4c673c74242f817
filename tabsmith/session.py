"""Spark session helpers shared by the library, the tests and the bench."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(master: str | None = None, shuffle_partitions: int = 8, app: str = "tabsmith") -> SparkSession:
    """Local session tuned like the cluster profile: AQE on, UTC clock, no UI.

    On a cluster the same settings come from spark-defaults; only the
    partition count is sized to the data there (roughly input bytes / 128 MB).
    """
    builder = (
        SparkSession.builder.master(master or os.environ.get("TABSMITH_MASTER", "local[8]"))
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TABSMITH_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names it. Where it is unset, only a single-machine session
    (``local[...]``) gets a scratch folder; elsewhere that is an error, because
    executors share no machine-local folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tabsmith-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    spark.sparkContext.setCheckpointDir(configured)
    return configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a stored table that one task reads at most, and bytes of its Parquet row groups.
ROWS_A_FILE, ROW_GROUP = 500_000, 16 * 1024 * 1024


class Stored:
    """``df`` written to the shared folder, its rows read anew by every use: nothing of it stays in an executor's memory.
    A task reads one file, ``ROWS_A_FILE`` rows at most, so what it makes of them is bounded too, whatever the table's size."""

    def __init__(self, df: DataFrame):
        spark, schema = df.sparkSession, df.schema
        self.path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/rows-{uuid.uuid4().hex}"
        plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # any names will do
        plain.write.option("maxRecordsPerFile", ROWS_A_FILE).option("parquet.block.size", ROW_GROUP).parquet(self.path)
        reader = spark.newSession()  # only the dealing of files to tasks is its own
        reader.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 40))
        reader.conf.set("spark.sql.files.openCostInBytes", str(1 << 40))
        files = reader.read.schema(plain.schema).parquet(self.path)
        # named like the first side, in the caller's session; the empty side is left out of the plan
        self.rows = spark.createDataFrame([], schema).limit(0).union(files)

    def drop(self) -> None:
        """Give up the files; ``rows`` can't be read any more."""
        spark = self.rows.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(df: DataFrame) -> DataFrame:
    """A frame of few rows (one a column, one a class) computed now, so that its readers share one run.
    The rows come to the driver: for frames whose size the schema bounds, never for data."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def nan_as_null(df: DataFrame) -> DataFrame:
    """A NaN is a missing value. Columns that can't hold one stay as they are."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floats:
        return df
    return df.select(*[F.nanvl(F.col(f"`{c}`"), F.lit(None)).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return nan_as_null(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))
