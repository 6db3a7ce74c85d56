"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .op01_url_filter import op1_url_filter
from .op02_toxicity import op2_toxicity
from .op03_sharding import op3_sharding
from .op04_pii import op4_pii
from .op05_bpe import op5_bpe
from .op06_decontaminate import op6_decontaminate
from .op07_jaccard_join import op7_jaccard_join
from .op08_quality import op8_quality
from .op09_line_dedup import op9_line_dedup
from .op10_embedding_dedup import op10_embedding_dedup

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_toxicity": op2_toxicity,
    "op3_sharding": op3_sharding,
    "op4_pii": op4_pii,
    "op5_bpe": op5_bpe,
    "op6_decontaminate": op6_decontaminate,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_quality": op8_quality,
    "op9_line_dedup": op9_line_dedup,
    "op10_embedding_dedup": op10_embedding_dedup,
}

ORACLE: dict[str, str] = {
    "op9_line_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (
  SELECT doc_id, i, line, translate(trim(line, E' \t\n\x0b\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(text, E'\n')) AS line, generate_subscripts(string_split(text, E'\n'), 1) AS i FROM d)),
k AS (SELECT key, count(DISTINCT doc_id) AS docs, max(doc_id) AS holder FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT l.doc_id, l.i, l.line, k.key IS NOT NULL AND l.doc_id <> k.holder AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, E'\n' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
""",
}
