from __future__ import annotations

from tabsmith.llm import query
from tabsmith.llm.common import read_table
from tabsmith.llm.trie import Heads, prefix_trie, rebuild

#: Prefixes are lists here, compared as such; the hash of the decimal id comes bit by bit, as DuckDB has no crc32.
ORACLE = r"""
WITH RECURSIVE crc_table AS (
    SELECT i AS byte, i::UBIGINT AS v, 0 AS k FROM range(256) t(i)
    UNION ALL
    SELECT byte, CASE WHEN v % 2 = 1 THEN xor(3988292384::UBIGINT, v // 2) ELSE v // 2 END, k + 1 FROM crc_table WHERE k < 8
), crc_list AS (SELECT list(v ORDER BY byte) AS tab FROM crc_table WHERE k = 8
), turns AS (
    SELECT conv_id AS conv, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), hashing AS (
    SELECT conv, CAST(conv AS VARCHAR) AS s, 0 AS k, 4294967295::UBIGINT AS v FROM turns
    UNION ALL
    SELECT conv, s, k + 1, xor(tab[(xor(v, ascii(substr(s, k + 1, 1))::UBIGINT) % 256)::INT + 1], v // 256)
    FROM hashing, crc_list WHERE k < length(s)
), heads AS (
    SELECT conv, CAST(xor(v, 4294967295::UBIGINT) % 6 AS BIGINT) AS h FROM hashing WHERE k = length(s)
), rebuilt AS (
    SELECT t.conv, list_concat(coalesce(b.own, [])[1 : h], t.own[h + 1 : ]) AS seq
    FROM turns t JOIN heads USING (conv) LEFT JOIN turns b ON b.conv = t.conv - t.conv % 100
), members AS (
    SELECT conv, len(seq) AS length, d AS depth, seq[1 : d] AS prefix FROM rebuilt, LATERAL (SELECT unnest(range(len(seq) + 1)) AS d)
), nodes AS (
    SELECT depth, prefix, min(conv) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (length = depth), '')) AS ends_sha256
    FROM members GROUP BY depth, prefix
), family AS (
    SELECT n.*, p.conv_id AS parent_conv_id, coalesce(c.n, 0) AS n_children,
           (n.n_convs - 1) * coalesce(length(n.prefix[n.depth].text), 0) AS tokens
    FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1 : n.depth - 1]
    LEFT JOIN (SELECT depth - 1 AS depth, prefix[1 : depth - 1] AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL) c
      ON c.depth = n.depth AND c.prefix = n.prefix
), subtree AS (
    SELECT d AS depth, prefix[1 : d] AS prefix, sum(tokens) AS saved, count(*) FILTER (n_children = 0) AS n_leaves
    FROM family, LATERAL (SELECT unnest(range(depth + 1)) AS d) GROUP BY ALL
)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM family JOIN subtree USING (depth, prefix)
"""


@query("op13_prefix_trie", ORACLE)
def op13_prefix_trie(spark, sf_dir):
    """Nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie(*rebuild(read_table(spark, sf_dir, "conversations"), Heads(every=100, lengths=6)))
