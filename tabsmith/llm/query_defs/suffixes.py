from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.llm import query
from tabsmith.llm.common import read_table
from tabsmith.llm.suffixes import remove_repeats

#: Bytes are pairs of hex digits here.
ORACLE = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), texts AS (
    SELECT x, min(r) AS t, count(*) AS copies FROM d GROUP BY x
), starts AS (
    SELECT t, copies, p, substr(x, 2 * p + 1, 400) AS w FROM texts, LATERAL (SELECT unnest(range(len(x) // 2 - 199)) AS p) WHERE len(x) >= 400
), hashed AS (
    SELECT t, copies, p, md5_number(w) AS w FROM starts
), repeated AS (
    SELECT t, p FROM (SELECT t, p, sum(copies) OVER (PARTITION BY w) AS n FROM hashed) WHERE n > 1
), islands AS (
    SELECT t, p, CASE WHEN p <= lag(p) OVER (PARTITION BY t ORDER BY p) + 200 THEN 0 ELSE 1 END AS opens FROM repeated
), runs AS (
    SELECT t, i, min(p) AS a, max(p) + 200 AS b FROM (SELECT t, p, sum(opens) OVER (PARTITION BY t ORDER BY p) AS i FROM islands) GROUP BY t, i
), cut AS (
    SELECT t, sum(b - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS f, list(b ORDER BY a) AS u FROM runs GROUP BY t
), kept AS (
    SELECT x, n_removed, n_spans,
           CASE WHEN f IS NULL THEN x
                ELSE array_to_string([substr(x, 2 * g[1] + 1, 2 * (g[2] - g[1])) FOR g IN list_zip([0::BIGINT] || u, f || [(len(x) // 2)::BIGINT])], '') END AS rest
    FROM texts LEFT JOIN cut USING (t)
)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(rest)) AS kept_sha256
FROM d JOIN kept USING (x)
"""


@query("op12_suffix_dedup", ORACLE)
def op12_suffix_dedup(spark, sf_dir):
    """Every document without the bytes of its 200-byte strings that start elsewhere, too."""
    found = remove_repeats(read_table(spark, sf_dir, "documents"), ["doc_id"], window=200)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
