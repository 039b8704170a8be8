"""Registered queries of this package.

SQL can't express these operators (64-bit hashes of shingles, tokenizers,
learned models, greedy packing); ``tests/llm`` holds them against brute force, but
the language and secret models, which are tested on small cases.  The exact search is the exception.
"""

from __future__ import annotations

from .chat import op9_chat_format
from .codes import op11_vector_codes
from .covertree import op6_embedding_dedup
from .langid import op7_language_id
from .licenses import op4_license_scan
from .mixing import op3_mix_sources
from .packing import op8_best_fit_packing
from .runs import op13_word_runs
from .secrets import op10_secret_scan
from .simhash import op2_simhash
from .token_counts import op1_token_counts
from .topk import op5_topk_search
from .urls import op12_url_filter

QUERIES = {f.__name__: f for f in (
    op1_token_counts, op2_simhash, op3_mix_sources, op4_license_scan, op5_topk_search, op6_embedding_dedup,
    op7_language_id, op8_best_fit_packing, op9_chat_format, op10_secret_scan,
    op11_vector_codes, op12_url_filter, op13_word_runs)}

ORACLES = {
    "op5_topk_search": """
WITH good AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
parts AS (SELECT vec_id, unnest(range(1, len(v) + 1)) AS term, unnest(v) AS weight FROM good),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.weight * c.weight) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.term = c.term AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0 GROUP BY 1, 2),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
}
