"""Retrieval queries: the benchmark passages against the stored records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import aliases
from ..functions.vector import cosine, dot
from ..operators import graph, search, text_index
from ..session import shared_folder
from ..sources import tables as T
from .oracle import sql
from .registry import query

TOKENS = """words AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda t: length(t) >= 2) AS w FROM memories),
asked AS (SELECT DISTINCT query_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda t: length(t) >= 2)) AS term FROM queries),
corpus AS (SELECT count(*) AS n, avg(length(w)) AS mean FROM words),
held AS (SELECT doc_id, length, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM held GROUP BY 1),
bm AS (SELECT query_id, h.doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
  FROM asked JOIN held h USING (term) JOIN dfs USING (term), corpus GROUP BY 1, 2),
text_rank AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, score FROM bm QUALIFY rank <= 10)"""

ASKED = "asked_v AS (SELECT vec_id // 50 AS query_id, vec_id AS own, embedding AS asked FROM vectors WHERE vec_id % 50 = 0)"
VECTOR_RANK = """vector_rank AS (SELECT query_id, vec_id AS doc_id, round(1 - list_cosine_similarity(embedding, asked), 6) AS distance,
  row_number() OVER (PARTITION BY query_id ORDER BY round(1 - list_cosine_similarity(embedding, asked), 6), vec_id) AS rank FROM vectors, asked_v WHERE vec_id <> own QUALIFY rank <= 10)"""


def _text_rank(spark, sf_dir):
    return search.bm25(T.table(spark, sf_dir, "documents").select("doc_id", "text"), T.search_queries(spark, sf_dir))


def _vector_rank(spark, sf_dir):
    """Every vector whose id is divisible by 50 asks, against all others; the
    questions are numbered on, so that they meet the benchmark's."""
    v = T.vectors(spark, sf_dir)
    asked = v.where("vec_id % 50 = 0").select((F.col("vec_id") / 50).cast("long").alias("query_id"), F.col("vec_id").alias("own"), F.col("embedding").alias("vector"))
    return search.nearest(v, asked, "vec_id", 10, own="own").withColumnRenamed("vec_id", "doc_id")


@query(sql("SELECT query_id, doc_id, rank, score FROM text_rank", TOKENS))
def i01_bm25_search(spark, sf_dir):
    return _text_rank(spark, sf_dir)


@query(sql("SELECT doc_id, term, tf, length FROM (SELECT doc_id, len(w) AS length, term, count(*) AS tf FROM (SELECT doc_id, w, unnest(w) AS term FROM words) GROUP BY ALL)", TOKENS))
def i04_postings(spark, sf_dir):
    return search.postings(T.memories(spark, sf_dir), "doc_id", "text")


CHANGED = """changed AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || ' ' || source || ' ' || text ELSE text END AS text FROM memories WHERE doc_id % 13 <> 0)"""


@query(sql("SELECT query_id, doc_id, rank, score FROM text_rank", CHANGED, TOKENS.replace("FROM memories", "FROM changed")))
def i04_kept_index(spark, sf_dir):
    """An index that takes most records, then the rest with some changed and
    some removed, is merged, and answers."""
    m = T.memories(spark, sf_dir).select("doc_id", "text", "source")
    index = text_index.TextIndex(spark, f"{shared_folder(spark)}/text-index-{uuid.uuid4().hex}")
    index.update(m.where("doc_id % 11 <> 0").select("doc_id", "text"))
    longer = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" "), "source", F.lit(" "), "text")).otherwise(F.col("text")).alias("text")
    index.update(m.where("doc_id % 11 = 0 OR doc_id % 7 = 0").where("doc_id % 13 <> 0").select("doc_id", longer), m.where("doc_id % 13 = 0"))
    index.merge()
    index.store.vacuum()
    return index.search(T.search_queries(spark, sf_dir))


@query(sql("SELECT query_id, doc_id, rank, distance FROM vector_rank", ASKED, VECTOR_RANK))
def i08_vector_search(spark, sf_dir):
    return _vector_rank(spark, sf_dir)


FUSED = """pair AS (SELECT coalesce(v.query_id, t.query_id) AS query_id, coalesce(v.doc_id, t.doc_id) AS doc_id,
  coalesce(1 / (60 + v.rank), 0) + coalesce((CASE WHEN v.rank IS NULL THEN 1.5 ELSE 1 END) / (60 + t.rank), 0) AS rrf
  FROM vector_rank v FULL JOIN text_rank t ON v.query_id = t.query_id AND v.doc_id = t.doc_id),
fusion AS (SELECT query_id, 'd' || doc_id AS memory_id, rrf, CASE WHEN max(rrf) OVER w - min(rrf) OVER w <= 1e-12 THEN 0.5 ELSE (rrf - min(rrf) OVER w) / (max(rrf) OVER w - min(rrf) OVER w) END AS similarity
  FROM pair WINDOW w AS (PARTITION BY query_id))"""


def _fusion(spark, sf_dir):
    name = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("memory_id")
    by_vector = _vector_rank(spark, sf_dir).select("query_id", name, "rank")
    by_text = _text_rank(spark, sf_dir).select("query_id", name, "rank")
    return search.fused(by_vector, by_text, "memory_id")


@query(sql("SELECT query_id, memory_id, round(rrf, 9) AS rrf, round(similarity, 6) AS similarity FROM fusion", TOKENS, ASKED, VECTOR_RANK, FUSED))
def i07_rank_fusion(spark, sf_dir):
    return _fusion(spark, sf_dir)


@query(sql("""SELECT query_id, f.memory_id, round(1 - round(similarity, 6) - (least(0.01 * usage_count, 0.06) + least(0.02 * activation, 0.08)
  + CASE WHEN level <> 'raw' THEN 0.03 ELSE 0 END - CASE WHEN tier = 'short' THEN 0.02 ELSE 0 END), 6) AS score FROM fusion f JOIN memories m USING (memory_id)""", TOKENS, ASKED, VECTOR_RANK, FUSED))
def i05_hybrid_search(spark, sf_dir):
    return search.boosted(_fusion(spark, sf_dir), T.memories(spark, sf_dir))


CONFIDENCE = """conf AS (SELECT memory_id, max(confidence) AS confidence FROM (SELECT source_id AS memory_id, confidence FROM semantic WHERE review_state IN ('approved', 'auto')
  UNION ALL SELECT target_id, confidence FROM semantic WHERE review_state IN ('approved', 'auto')) GROUP BY 1)"""


@query(sql("SELECT memory_id, round(confidence, 6) AS confidence FROM conf", CONFIDENCE))
def d05_edge_confidence(spark, sf_dir):
    return graph.reviewed_confidence(T.semantic_edges(spark, sf_dir)).select("memory_id", F.round("confidence", 6).alias("confidence"))


NEWEST = """hop AS (SELECT target_id AS old, arg_max(source_id, (created, source_id)) AS new FROM semantic WHERE role = 'updates' AND review_state IN ('approved', 'auto') GROUP BY 1),
newest AS (SELECT h0.old AS memory_id, coalesce(h4.new, h3.new, h2.new, h1.new, h0.new) AS newest FROM hop h0 LEFT JOIN hop h1 ON h0.new = h1.old LEFT JOIN hop h2 ON h1.new = h2.old
  LEFT JOIN hop h3 ON h2.new = h3.old LEFT JOIN hop h4 ON h3.new = h4.old)"""


@query(sql("SELECT memory_id, newest FROM newest", NEWEST))
def e04_superseded_by(spark, sf_dir):
    return graph.newest_versions(T.semantic_edges(spark, sf_dir))


#: Edge times of the driver's tables end in 1998.
RECALL_NOW = "1998-06-01 00:00:00"


def diffusion_sql(seeds: str, now: str, depth: int = 3, budget: int = 25) -> str:
    """Common tables of a diffusion from ``seeds (query_id, memory_id,
    similarity)``; the last one is ``diffused (query_id, memory_id, mass, depth)``."""
    parts = [
        f"""eff AS (SELECT source_id, target_id, weight * conductance * CASE WHEN last_fired IS NULL THEN 0.4 WHEN age <= 7 THEN 1.0 WHEN age <= 30 THEN 0.8 WHEN age <= 90 THEN 0.6 ELSE 0.4 END AS eff
  FROM (SELECT *, (epoch(TIMESTAMP '{now}') - epoch(last_fired)) / 86400 AS age FROM flow))""",
        "out_edges AS (SELECT * FROM (SELECT *, sum(eff) OVER (PARTITION BY source_id) AS whole FROM eff) WHERE eff > 0)",
        f"front0 AS (SELECT query_id, memory_id, similarity AS mass, 0 AS depth, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, memory_id) AS place FROM {seeds} QUALIFY place <= {budget})",
        "seen0 AS (SELECT * FROM front0)",
    ]
    for level in range(1, depth + 1):
        was = level - 1
        parts.append(f"""front{level} AS (SELECT query_id, memory_id, mass, {level} AS depth, used + row_number() OVER (PARTITION BY query_id ORDER BY place, e DESC, memory_id) AS place FROM (
  SELECT f.query_id, o.target_id AS memory_id, f.mass * 0.85 * o.eff / o.whole AS mass, f.place, round(o.eff, 9) AS e FROM front{was} f JOIN out_edges o ON f.memory_id = o.source_id
  WHERE NOT EXISTS (FROM seen{was} s WHERE s.query_id = f.query_id AND s.memory_id = o.target_id)
  QUALIFY row_number() OVER (PARTITION BY f.query_id, o.target_id ORDER BY f.place, round(o.eff, 9) DESC) = 1)
  JOIN (SELECT query_id, max(place) AS used FROM seen{was} GROUP BY 1) USING (query_id) QUALIFY used + row_number() OVER (PARTITION BY query_id ORDER BY place, e DESC, memory_id) <= {budget})""")
        parts.append(f"seen{level} AS (SELECT * FROM seen{was} UNION ALL SELECT * FROM front{level})")
    return ",\n".join([*parts, f"diffused AS (SELECT query_id, memory_id, mass, depth FROM seen{depth})"])


RECALL = diffusion_sql("(SELECT query_id, memory_id, round(similarity, 6) AS similarity FROM fusion)", RECALL_NOW) + """,
candidates AS (SELECT query_id, memory_id, round(similarity, 6) AS similarity, 0.0 AS graph FROM fusion
  UNION ALL SELECT query_id, memory_id, 0.0, mass FROM diffused d WHERE depth > 0 AND NOT EXISTS (FROM fusion f WHERE f.query_id = d.query_id AND f.memory_id = d.memory_id)),
scored AS (SELECT query_id, f.memory_id, newest, round(0.45 * similarity + 0.15 * least(activation / 8, 1) + 0.15 * graph + 0.10 * coalesce(confidence, 0) - CASE WHEN newest IS NULL THEN 0 ELSE 0.05 END, 9) AS score
  FROM candidates f JOIN memories m USING (memory_id) LEFT JOIN conf USING (memory_id) LEFT JOIN newest USING (memory_id)),
live AS (SELECT query_id, memory_id, max(score) AS score FROM (SELECT query_id, coalesce(newest, memory_id) AS memory_id, round(score + CASE WHEN newest IS NULL THEN 0 ELSE 0.05 END, 9) AS score FROM scored)
  JOIN memories m USING (memory_id) WHERE NOT list_contains(tags, 'state:obsolete') GROUP BY 1, 2)"""


@query(sql("SELECT query_id, memory_id, round(score, 7) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, memory_id) AS rank FROM live WHERE score >= 0.25 QUALIFY rank <= 5", TOKENS, ASKED, VECTOR_RANK, FUSED, CONFIDENCE, NEWEST, RECALL))
def i06_recall(spark, sf_dir):
    m, s = T.memories(spark, sf_dir), T.semantic_edges(spark, sf_dir)
    candidates = search.with_diffusion(_fusion(spark, sf_dir), T.flow_edges(spark, sf_dir), RECALL_NOW)
    ranked = search.recall_scores(candidates, m, graph.reviewed_confidence(s), graph.newest_versions(s))
    policy = search.POLICIES["conversation"]
    live = search.current_versions(ranked, m).where(F.col("score") >= policy.least)
    return search.top(live, "query_id", [F.desc("score"), F.asc("memory_id")], policy.budget).withColumn("score", F.round("score", 7))


@query(sql("""SELECT query_id, memory_id, round(min(score + 0.003 * rank + 0.001 * topic), 6) AS score FROM (
  SELECT query_id // 4 AS query_id, query_id % 4 AS topic, 'd' || doc_id AS memory_id, distance AS score, rank FROM vector_rank) GROUP BY 1, 2""", ASKED, VECTOR_RANK))
def g07_merged_topics(spark, sf_dir):
    hits = _vector_rank(spark, sf_dir).select(
        F.floor(F.col("query_id") / 4).alias("query_id"), (F.col("query_id") % 4).alias("topic"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("memory_id"),
        F.col("distance").alias("score"), "rank",
    )
    return search.merged_topics(hits)


@query(sql("SELECT vec_id, round(list_cosine_similarity(embedding, (SELECT embedding FROM vectors WHERE vec_id = 0)), 6) AS cosine, round(sqrt(list_inner_product(embedding, embedding)), 6) AS norm FROM vectors"))
def h38_cosine_pairs(spark, sf_dir):
    v = T.vectors(spark, sf_dir)
    one = v.where("vec_id = 0").select(F.col("embedding").alias("asked"))
    return v.crossJoin(F.broadcast(one)).select("vec_id", F.round(cosine("embedding", "asked"), 6).alias("cosine"), F.round(F.sqrt(dot("embedding", "embedding")), 6).alias("norm"))


@query(sql("""SELECT memory_id, list_sort(list(DISTINCT canonical)) AS named FROM memories, (SELECT 'item' || item_id AS canonical,
  lower(array_to_string(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')[1:3], '')) AS alias FROM benchmark) WHERE length(alias) >= 2 AND contains(lower(regexp_replace(text, '[ \t\n\r\f\x0B]+', '', 'g')), alias) GROUP BY 1"""))
def h97_named_in_text(spark, sf_dir):
    """Aliases of three words: how every passage of the benchmark begins."""
    words = F.slice(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0)), 1, 3)
    dictionary = T.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("canonical"), F.lit("passage").alias("kind"), F.array_join(words, " ").alias("alias"))
    found = T.memories(spark, sf_dir).select("memory_id", aliases.matcher(dictionary)("text").alias("found")).where(F.size("found") > 0)
    return found.select("memory_id", F.array_sort(F.array_distinct(F.transform("found", lambda f: f["canonical"]))).alias("named"))
