"""DuckDB definitions of the derived tables, prefixed to every oracle query."""

MEMORIES = """memories AS (SELECT d.doc_id, 'd' || d.doc_id AS memory_id, text, TIMESTAMP '2024-01-01 00:00:00' + d.doc_id * INTERVAL 1 MINUTE AS ts,
  CASE WHEN d.doc_id % 10 = 0 THEN 'cognition' WHEN d.doc_id % 10 <= 3 THEN 'understanding' ELSE 'raw' END AS level,
  CASE WHEN source = 'src0' THEN 'library' ELSE '' END AS collection,
  CASE d.doc_id % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'long' ELSE 'core' END AS tier, (d.doc_id % 81) / 10.0::DOUBLE AS activation,
  CASE WHEN toxic = 1 THEN 0.9::DOUBLE WHEN quality = 1 THEN 0.7::DOUBLE WHEN quality = 0 THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END AS emotion,
  ['lang:' || coalesce(lang, 'und'), 'domain:' || coalesce(source, 'none'), CASE d.doc_id % 7 WHEN 0 THEN 'state:current' WHEN 1 THEN 'state:past' WHEN 2 THEN 'state:obsolete' ELSE 'kind:note' END] AS tags,
  d.doc_id % 5 AS usage_count, d.doc_id % 97 = 0 AS pinned, lang, source
  FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, max(quality) AS quality FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id)"""

VECTORS = "vectors AS (SELECT 'd' || vec_id AS memory_id, vec_id, label, embedding::DOUBLE[] AS embedding FROM embeddings)"

FLOW = """flow AS (SELECT 'd' || s AS source_id, 'd' || t AS target_id, least(10.0::DOUBLE, round(count(*) * 0.2::DOUBLE, 6)) AS weight,
  CASE WHEN s % 2 = 0 THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END AS conductance, max(fired) AS last_fired,
  CASE s % 5 WHEN 0 THEN 'manual' WHEN 1 THEN 'cluster' WHEN 2 THEN 'knn_legacy' ELSE 'auto_link' END AS provenance
  FROM (SELECT a.l_partkey % n AS s, b.l_partkey % n AS t, a.l_shipdate AS fired FROM lineitem a JOIN lineitem b
    ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber, (SELECT count(*) AS n FROM documents)) WHERE s <> t GROUP BY s, t)"""

SEMANTIC = """semantic AS (SELECT source_id, target_id, role, created, 0.5 + (doc_id % 5) / 10.0::DOUBLE AS confidence, 1.0 - (doc_id % 3) / 10.0::DOUBLE AS strength,
  CASE doc_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'auto' ELSE 'approved' END AS review_state FROM (
    SELECT memory_id AS source_id, old AS target_id, 'updates' AS role, doc_id, ts AS created FROM (SELECT *, lag(memory_id) OVER (PARTITION BY text ORDER BY doc_id) AS old FROM memories) WHERE old IS NOT NULL
    UNION ALL SELECT u.memory_id, r.memory_id, 'SUPPORTED_BY', u.doc_id, u.ts FROM memories u JOIN memories r ON r.doc_id = u.doc_id + 5 AND r.level = 'raw' WHERE u.level = 'understanding'))"""

MESSAGES = """messages AS (SELECT conv_id * 100 + turn AS id, TIMESTAMP '2024-01-01 00:00:00' + (conv_id * 180 + turn * 7) * INTERVAL 1 MINUTE AS ts,
  CASE WHEN role = 'user' THEN 'in' ELSE 'out' END AS direction, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'reply' ELSE 'system' END AS kind, text, conv_id FROM conversations)"""

BELIEFS = """beliefs AS (SELECT 'b-' || source AS belief_id, 'about ' || source AS statement, CASE WHEN n % 4 = 3 THEN 'candidate' ELSE 'active' END AS status, n % 9 = 0 AS pinned,
  TIMESTAMP '2024-01-01 00:00:00' + n * 600 * INTERVAL 1 MINUTE AS last_touched FROM (SELECT DISTINCT source, substr(source, 4)::INT AS n FROM documents WHERE source IS NOT NULL)),
cases AS (SELECT 'c-' || l.doc_id AS case_id, 'b-' || source AS belief_id, CASE WHEN toxic = 1 THEN 'boundary' WHEN quality = 1 THEN 'support' ELSE 'contradiction' END AS case_kind,
  'd' || l.doc_id AS memory_id, TIMESTAMP '2024-01-01 00:00:00' + l.doc_id * INTERVAL 1 MINUTE AS occurred_at FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE source IS NOT NULL)"""

QUERIES = "queries AS (SELECT item_id AS query_id, text FROM benchmark)"

ALL = (MEMORIES, VECTORS, FLOW, SEMANTIC, MESSAGES, BELIEFS, QUERIES)


def sql(body: str, *more: str) -> str:
    """``body`` over the derived tables; ``more``: further common tables."""
    return "WITH " + ",\n".join([*ALL, *more]) + "\n" + body
