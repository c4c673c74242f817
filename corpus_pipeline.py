"""Corpus pipeline: five stages over ``documents``, each applying one operator of ``tabsmith.llm``.

1. toxicity: learns from the input's labelled documents; documents from the threshold on go.
2. language_id: learns from the input's ``lang``; documents without a letter, or that cost more bits than their
   bytes have (text of no learned language), go.
3. near_duplicates: shingles of five words, similarity of 0.8 or more; one document of each group stays.
4. decontamination: documents that hold a copy of a benchmark item go.
5. sentencepiece: the ids of what is left.

Rows are judged by id and text together, so repeated and null ids do no harm: rows equal in id and text share
a fate, and the near-duplicate stage leaves one of them. Stages 1 to 4 return the columns that they got,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm import langid, toxicity
from tabsmith.llm.common import read_table, ship_code, written
from tabsmith.llm.decontaminate import contaminated
from tabsmith.llm.neardup import Rule, near_duplicates
from tabsmith.llm.tokens import encode, read_model

#: Bits that a text may cost beyond 8 a byte before it counts as no learned language.
SLACK_BITS = 64


def _rows(docs: DataFrame) -> DataFrame:
    """The whole row as one column beside the text, so that no operator's column can clash with it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "text")


def _keyed(docs: DataFrame) -> DataFrame:
    return _rows(docs).select("__row", F.coalesce(F.col("__row.doc_id").cast("string"), F.lit("null")).alias("__id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("__key"))


def _key_columns(found: DataFrame) -> DataFrame:
    return found.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__id"), F.coalesce("text_key", F.lit(0)).alias("__key")).distinct()


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs.select("doc_id", "text", "lang"), read_table(spark, sf_dir, "labels"))
    return toxicity.score(_rows(docs), model, ["__row"]).where(F.col("predicted") == 0).select("__row.*")


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs.select("text", "lang"))
    found = langid.identify(_rows(docs), model, ["__row"])
    size = F.octet_length(F.col("__row.text"))
    known = (F.col("lang_pred") != "und") & (F.col("bits_per_byte") * size <= 8 * size + SLACK_BITS)
    return found.where(known).select("__row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_duplicates(docs, Rule(words=5, num=80, den=100))
    alone = _key_columns(found.where(F.col("representative")))
    return _keyed(docs).join(alone, ["__id", "__key"]).dropDuplicates(["__id", "__key"]).select("__row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = contaminated(docs, read_table(spark, sf_dir, "benchmark"))
    return _keyed(docs).join(_key_columns(found), ["__id", "__key"], "left_anti").select("__row.*")


def encode_rest(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode(docs, read_model(), ["doc_id"])


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_rest),
]

#: Classifiers and alignments have no SQL form; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage reads what its predecessor wrote."""
    ship_code(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
