"""Sources and sinks.

Tables are Parquet directories; registry tables are ordinary append tables whose
retention and upsert rules are window/aggregate expressions, not file rewrites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.functions.scalar import sanitize_label
from tabsmith.operators.ranking import row_number_within
from tabsmith.session import nan_as_null

# Tokens read as missing at CSV ingest.
NA_TOKENS = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "#N/A", "<NA>")


# Spelling of numbers (integers, decimals, exponents, infinities).
_INTEGER = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$|^\s*[+-]?(inf|Infinity)\s*$"


def read_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Header, NA tokens -> null (D10), then a type for each column that holds for every value.

    All columns are read as text; one aggregate over the whole file counts the
    values that parse as integer, number and boolean, and only a column whose
    values all parse is cast. So no value is lost to a guess from a sample.
    ``multi_line`` reads quoted line breaks, at the price of unsplittable files.
    """
    raw = spark.read.option("header", True).option("multiLine", multi_line).csv(path)
    text = raw.select(*[F.when(~F.trim(c).isin(*NA_TOKENS), c).alias(n) for n, c in ((n, F.col(f"`{n}`")) for n in raw.columns)])
    checks = {
        "values": lambda c: c.isNotNull(),
        "integers": lambda c: c.rlike(_INTEGER) & c.try_cast("bigint").isNotNull(),
        "numbers": lambda c: c.rlike(_NUMBER),
        "booleans": lambda c: c.isin("True", "False", "true", "false", "TRUE", "FALSE"),
        "rows": lambda c: F.lit(True),
    }
    aggregates = [F.count_if(check(F.col(f"`{n}`"))).alias(f"{kind}{i}") for i, n in enumerate(raw.columns) for kind, check in checks.items()]
    if not aggregates:
        return text
    counts = text.agg(*aggregates).first()

    def typed(i: int, name: str):
        c, n = F.col(f"`{name}`"), counts[f"values{i}"]
        if n and counts[f"integers{i}"] == n:
            return F.trim(c).cast("bigint").alias(name)
        if n and counts[f"numbers{i}"] == n:
            return F.regexp_replace(F.trim(c), "(?i)^([+-]?)inf(inity)?$", "$1Infinity").cast("double").alias(name)
        if n and counts[f"booleans{i}"] == n == counts[f"rows{i}"]:
            return F.lower(c).cast("boolean").alias(name)
        return c

    return text.select(*[typed(i, name) for i, name in enumerate(raw.columns)])


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
              lower: int | None = None, upper: int | None = None, partitions: int = 8, **props) -> DataFrame:
    """A relational table over JDBC; with a numeric partition column the read
    is split into ``partitions`` parallel range queries."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in props.items():
        reader = reader.option(k, v)
    if partition_column is not None:
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", lower)
                  .option("upperBound", upper).option("numPartitions", partitions))
    return reader.load()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """S3: NaN is read as missing."""
    return nan_as_null(spark.read.parquet(path))


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """S4 (data part): columnar Parquet; registering the dataset row is an append
    to the ``datasets`` table (``append_rows``)."""
    df.write.mode(mode).parquet(path)


def scored_csv(df: DataFrame, path: str, labels: list[str] | None = None) -> None:
    """Input columns + prediction fields + ``probability_<label>`` columns (labels sorted; letters and digits of any
    script and underscores stay, the rest becomes an underscore; labels that end up alike are numbered)."""
    out = df
    if labels and "probabilities" in df.columns:
        names = out.sparkSession.range(1).select(*[sanitize_label(F.lit(x)).alias(str(i)) for i, x in enumerate(sorted(labels))]).first()
        taken = set(out.columns)
        for label, name in zip(sorted(labels), names):
            column = f"probability_{name or 'class'}"
            column = next(c for c in (column, *(f"{column}_{i}" for i in range(2, len(labels) + 2))) if c not in taken)
            taken.add(column)
            out = out.withColumn(column, F.col("probabilities")[label])
        out = out.drop("probabilities")
    out.write.mode("overwrite").option("header", True).csv(path)


def retained(registry: DataFrame, cap: int, order_col: str = "created_at", key: str | None = None, id_col: str | None = None) -> DataFrame:
    """Newest ``cap`` rows (per key when given), skew-safe numbering. Among rows of one time the larger ``id_col``
    counts as newer, or without one the larger hash of the row, so that a second run keeps the same rows."""
    groups = [key] if key else []
    if not groups:
        registry = registry.withColumn("_all", F.lit(1))
        groups = ["_all"]
    tie = F.col(id_col) if id_col else F.xxhash64(*[F.col(f"`{c}`") for c in registry.columns])
    r = row_number_within(registry.withColumn("_tie", tie), groups, [F.desc(order_col), F.desc("_tie")], out="_rn")
    return r.filter(F.col("_rn") <= cap).drop("_rn", "_all", "_tie")


def upsert_by_id(registry: DataFrame, incoming: DataFrame, id_col: str, order_col: str = "created_at") -> DataFrame:
    """Replace rows with the same id by the newest version."""
    both = registry.unionByName(incoming, allowMissingColumns=True)
    newest = both.groupBy(id_col).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in both.columns]), F.col(order_col)).alias("r"))
    return newest.select("r.*")


def dataset_listing(datasets: DataFrame) -> DataFrame:
    """Newest first."""
    return datasets.orderBy(F.desc("created_at"))


def clamp_limit(limit: int | None, default: int, cap: int) -> int:
    """max(1, min(limit or default, cap))."""
    return max(1, min(int(limit or default), cap))
