from __future__ import annotations

from tabsmith.llm import query
from tabsmith.llm.common import read_table
from tabsmith.llm.tokens import count_tokens, encode, read_model


@query("op3_token_counts")
def op3_token_counts(spark, sf_dir):
    """Tokens and best path score of every document."""
    return count_tokens(read_table(spark, sf_dir, "documents"), read_model(), ["doc_id"])


@query("op4_sentencepiece")
def op4_sentencepiece(spark, sf_dir):
    """Ids of every document, and whether they decode to its text."""
    return encode(read_table(spark, sf_dir, "documents"), read_model(), ["doc_id"])
