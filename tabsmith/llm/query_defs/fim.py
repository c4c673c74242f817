from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.llm import query
from tabsmith.llm.common import read_table
from tabsmith.llm.fim import Rule, fill_in_middle, restored

ORACLE = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x,
           regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines
    FROM documents
), h AS (
    SELECT *, CAST(len(lines) AS BIGINT) AS n,
           CAST('0x' || substr(x, 1, 8) AS BIGINT) % (len(lines) + 1) AS c1,
           CAST('0x' || substr(x, 9, 8) AS BIGINT) % (len(lines) + 1) AS c2,
           CAST('0x' || substr(x, 25, 8) AS BIGINT) % 100 AS h4
    FROM d
), p AS (
    SELECT *, array_to_string(lines[1 : least(c1, c2)], '') AS prefix,
           array_to_string(lines[least(c1, c2) + 1 : greatest(c1, c2)], '') AS middle,
           array_to_string(lines[greatest(c1, c2) + 1 : n], '') AS suffix,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
                WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM h
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


@query("op11_fill_in_middle", ORACLE)
def op11_fill_in_middle(spark, sf_dir):
    """Every document cut at two line boundaries and reordered, and the hash of what its output is rebuilt to."""
    found = fill_in_middle(read_table(spark, sf_dir, "documents"), ["doc_id"], Rule(seed=7, cut_percent=100, spm_percent=50))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
