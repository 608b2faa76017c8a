"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op2_bpe
from .html import op10_html
from .langid import op8_language
from .mixing import op9_mixing
from .pii import op7_pii
from .search import op4_search
from .simhash import op3_simhash
from .substrings import op6_substrings
from .toxicity import op1_toxicity
from .vectors import op5_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_bpe": op2_bpe,
    "op3_simhash": op3_simhash,
    "op4_search": op4_search,
    "op5_vectors": op5_vectors,
    "op6_substrings": op6_substrings,
    "op7_pii": op7_pii,
    "op8_language": op8_language,
    "op9_mixing": op9_mixing,
    "op10_html": op10_html,
}

ORACLE: dict[str, str] = {}

ORACLE["op5_vectors"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
comp(node, c) USING KEY (node) AS (SELECT vec_id, vec_id FROM v UNION (SELECT l.b, min(p.c) FROM comp p JOIN links l ON l.a = p.node JOIN recurring.comp k ON k.node = l.b WHERE p.c < k.c GROUP BY l.b))
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN comp ON node = vec_id
"""

ORACLE["op6_substrings"] = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 34], ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 33)) AS i)),
hit AS (SELECT doc_id, i FROM win WHERE s IN (SELECT s FROM win GROUP BY s HAVING count(*) > 1)),
gone AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 35)))) AS ks FROM hit GROUP BY doc_id),
kept AS (SELECT w.doc_id, ws, coalesce(len(ks), 0) AS n, list_filter(ws, lambda x, k: ks IS NULL OR NOT list_contains(ks, k)) AS left_over FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(ws) AS n_words, n AS n_removed, sha256(array_to_string(left_over, ' ')) AS kept_sha256 FROM kept
"""

ORACLE["op4_search"] = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
tf AS (SELECT doc_id, dl, t, count(*) AS tf FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS t FROM w) GROUP BY ALL),
n AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM w),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
s AS (SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.tf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * d.tf * 2.2::DOUBLE / (d.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * d.dl / mean))), 6) AS score FROM tf q JOIN df USING (t) JOIN tf d ON d.t = q.t, n WHERE q.doc_id % 20 = 0 GROUP BY 1, 2),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM s)
SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
