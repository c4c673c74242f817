"""FREQ: the shared column-statistics pass. Long texts take part as digests, so none is a shuffle key.

One ``unpivot`` of the selected columns to ``(column_name, value)`` followed by one
``groupBy(column_name, value).count()`` yields distinct counts, modes, top-k
values, constant and id-like tests and category shares for every column at
once. The aggregation is partial (map-side) so a hot value is pre-counted in
every task before the shuffle.

``column_stats`` is the companion single-row aggregate (non-null counts,
moments, text length, date-parse share) computed in one scan without a shuffle
beyond the final merge.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.scalar import as_text, is_numeric_type, is_temporal_type, lenient_timestamp
from tabsmith.session import settled


@dataclass(frozen=True)
class ColumnSpec:
    position: int
    name: str
    dtype: T.DataType

    @property
    def numeric(self) -> bool:
        return is_numeric_type(self.dtype)

    @property
    def temporal(self) -> bool:
        return is_temporal_type(self.dtype)

    @property
    def storage(self) -> str:
        if self.numeric:
            return "numeric"
        if self.temporal:
            return "temporal"
        if isinstance(self.dtype, T.StringType):
            return "string"
        return "other"


def column_specs(df: DataFrame, columns: list[str] | None = None) -> list[ColumnSpec]:
    wanted = set(columns) if columns is not None else None
    return [
        ColumnSpec(i, f.name, f.dataType)
        for i, f in enumerate(df.schema.fields)
        if wanted is None or f.name in wanted
    ]


def _q(name: str):
    return F.col(f"`{name}`")


#: Characters up to which a text is its own key where only equality counts.
SHORT_TEXT = 40


#: Stands between the beginning of a long text and its hashes.
MARK = "\u0001"


def digest(c: Column) -> Column:
    """A longer text's first ``SHORT_TEXT`` characters and 128 bits of two independent hashes: equal for equal texts,
    and in the order of the texts but among those that begin alike."""
    both = F.concat(F.left(c, F.lit(SHORT_TEXT)), F.lit(MARK), F.hex(F.xxhash64(c)), F.lit(":"), F.hex(F.xxhash64(F.lit(1), c)))
    return F.when(F.length(c) > SHORT_TEXT, both).otherwise(c)


def with_texts(df: DataFrame, rows: DataFrame, columns: list[str], value: str = "value") -> DataFrame:
    """``rows`` (column_name, ``value``, ..: few a column, such as a top list) with full texts for digests.

    Only if there are any, ``df`` is read once more, for the columns that have them; only their texts are shuffled.
    """
    rows = settled(rows)
    asked = rows.where(F.instr(value, MARK) > 0).select("column_name", F.col(value).alias("_digest")).distinct()
    names = [r["column_name"] for r in asked.select("column_name").distinct().collect()]
    if not names:
        return rows
    cells = [F.struct(F.lit(s.name).alias("column_name"), as_text(_q(s.name), s.dtype).alias("_text")) for s in column_specs(df, names)]
    found = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").withColumn("_digest", digest(F.col("_text")))
    found = found.join(F.broadcast(asked), ["column_name", "_digest"]).groupBy("column_name", "_digest").agg(F.first("_text").alias("_text"))  # few rows a column
    whole = rows.join(found, (rows["column_name"] == found["column_name"]) & (rows[value] == found["_digest"]), "left").drop(found["column_name"])
    return whole.withColumn(value, F.coalesce("_text", value)).select(*rows.columns)


def long_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, value)`` with every value as canonical text, long ones as their digest; nulls dropped."""
    specs = column_specs(df, columns)
    if not specs:
        raise ValueError("no columns to unpivot")
    texts = df.select(*[(digest(as_text(_q(s.name), s.dtype)) if not (s.numeric or s.temporal) else as_text(_q(s.name), s.dtype)).alias(f"c{s.position}") for s in specs])
    names = {f"c{s.position}": s.name for s in specs}
    longf = texts.unpivot([], list(names), "slot", "value").filter(F.col("value").isNotNull())
    mapping = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return longf.select(mapping[F.col("slot")].alias("column_name"), "value")


def frequency_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_name, value, count)`` for every non-null value of every column; see :func:`with_texts`."""
    return long_values(df, columns).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))


def distinct_counts(freq: DataFrame) -> DataFrame:
    return freq.groupBy("column_name").agg(F.count(F.lit(1)).alias("unique_count"))


def unique_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``distinct_counts`` of every column without a frequency table: numbers, days and times are counted as such, not as
    texts, so that a value that moves has eight bytes. The same rows as ``distinct_counts(frequency_table(df))``."""
    specs = column_specs(df, columns)
    groups: dict[str, list] = {"long": [], "double": [], "string": []}
    for s in specs:
        c = _q(s.name)
        if isinstance(s.dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            groups["long"].append((s.position, c.cast("long")))
        elif isinstance(s.dtype, T.DateType):
            groups["long"].append((s.position, F.unix_date(c).cast("long")))
        elif isinstance(s.dtype, T.TimestampType):
            groups["long"].append((s.position, F.unix_micros(c)))
        elif isinstance(s.dtype, (T.DoubleType, T.FloatType)):
            d = c.cast("double")
            groups["double"].append((s.position, F.when(~F.isnan(d), F.when(d == 0, F.lit(0.0)).otherwise(d))))
        else:
            text = as_text(c, s.dtype)
            groups["string"].append((s.position, text if s.numeric or s.temporal else digest(text)))
    parts = []
    for cells in groups.values():
        if cells:
            values = df.select(F.inline(F.array(*[F.struct(F.lit(p).alias("p"), v.alias("v")) for p, v in cells]))).where("v IS NOT NULL")
            parts.append(values.groupBy("p", "v").agg(F.lit(1)).groupBy("p").agg(F.count(F.lit(1)).alias("unique_count")))
    names = F.create_map(*[x for s in specs for x in (F.lit(s.position), F.lit(s.name))])
    return reduce(DataFrame.unionAll, parts).select(names[F.col("p")].alias("column_name"), "unique_count")


def column_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: rows, non_null, numeric moments, text length, date share.

    Computed as a single wide aggregate (one scan) then stacked into rows.
    """
    specs = column_specs(df, columns)
    aggs = [F.count(F.lit(1)).alias("rows")]
    for s in specs:
        c = _q(s.name)
        p = s.position
        aggs.append(F.count(c).alias(f"nn{p}"))
        if s.numeric:
            d = c.cast("double")
            aggs += [F.avg(d).alias(f"mean{p}"), F.min(d).alias(f"min{p}"), F.max(d).alias(f"max{p}")]
        if s.storage in ("string", "other"):
            txt = c.cast("string")
            aggs.append(F.avg(F.length(txt)).alias(f"len{p}"))
            aggs.append(F.avg(F.when(c.isNotNull(), lenient_timestamp(c).isNotNull().cast("int"))).alias(f"ds{p}"))
    wide = df.agg(*aggs)

    def field(name: str, p: int, present: bool):
        return (F.col(f"{name}{p}") if present else F.lit(None)).cast("double")

    rows = [
        F.struct(
            F.lit(s.position).alias("position"),
            F.lit(s.name).alias("column_name"),
            F.lit(s.storage).alias("storage"),
            F.col("rows").alias("rows"),
            F.col(f"nn{s.position}").alias("non_null"),
            field("mean", s.position, s.numeric).alias("mean"),
            field("min", s.position, s.numeric).alias("min_value"),
            field("max", s.position, s.numeric).alias("max_value"),
            field("len", s.position, s.storage in ("string", "other")).alias("avg_length"),
            (F.lit(1.0) if s.temporal else field("ds", s.position, s.storage in ("string", "other"))).alias(
                "date_share"
            ),
        )
        for s in specs
    ]
    return wide.select(F.inline(F.array(*rows)))
