"""Queries of proposals, chunks, routing, selection and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import router
from ..functions.vector import cosine
from ..operators import chunks, graph, greedy, kept_pairs, lifecycle, maintenance, proposals, ranking, reports
from ..session import settled, shared_folder
from ..sources import tables as T
from ..sources.snapshots import Store
from .oracle import sql
from .registry import query
from .search import CONFIDENCE, TOKENS, _text_rank


def _now():
    return F.expr("timestamp_ntz'2024-01-02 00:00:00'")


ALIKE = """alike AS (SELECT x.memory_id AS a, y.memory_id AS b, round(list_cosine_similarity(x.embedding, y.embedding), 6) AS similarity FROM vectors x JOIN vectors y ON x.memory_id < y.memory_id),
either_way AS (SELECT a, b, similarity FROM alike WHERE similarity >= 0.2 UNION ALL SELECT b, a, similarity FROM alike WHERE similarity >= 0.2)"""


def _alike(spark, sf_dir, least):
    return proposals.alike_pairs(T.vectors(spark, sf_dir), "memory_id", least)


@query(sql("SELECT a, b, similarity FROM alike WHERE similarity >= 0.3", ALIKE))
def c10_semantic_pairs(spark, sf_dir):
    return _alike(spark, sf_dir, 0.3)


@query(sql("""SELECT old, new, similarity, direct, shared FROM (SELECT p.*, EXISTS (FROM around r WHERE r.memory_id = old AND r.other = new) AS direct,
    (SELECT count(*) FROM around r JOIN around q ON r.other = q.other WHERE r.memory_id = old AND q.memory_id = new)::INT AS shared
    FROM (SELECT CASE WHEN m.ts < n.ts THEN a ELSE b END AS old, CASE WHEN m.ts < n.ts THEN b ELSE a END AS new, similarity FROM alike JOIN memories m ON m.memory_id = a JOIN memories n ON n.memory_id = b
      WHERE similarity >= 0.2 AND m.ts <> n.ts AND m.tags[2] = n.tags[2]) p)
  WHERE direct OR shared > 0 OR similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY new ORDER BY direct DESC, similarity DESC, old) <= 2 ORDER BY direct DESC, similarity DESC, new, old LIMIT 80""",
           ALIKE, "around AS (SELECT source_id AS memory_id, target_id AS other FROM flow UNION SELECT target_id, source_id FROM flow)"))
def c08_update_candidates(spark, sf_dir):
    """Records on one edge come before all others, so where they fill the list
    only they are compared; else all records of one domain, as no others are
    candidates."""
    m, v, flow = T.memories(spark, sf_dir), T.vectors(spark, sf_dir), T.flow_edges(spark, sf_dir)
    domains = m.select("memory_id", F.explode(F.array_distinct(F.filter("tags", lambda t: t.startswith("domain:")))).alias("domain"))
    joined = proposals.alike_ends(proposals.within(flow.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")), v, domains, "domain"), v, 0.2)
    direct = settled(proposals.update_candidates(joined, m, flow, least=0.2, high=0.3, most=80))
    if direct.count() == 80:
        return direct.orderBy(F.desc("direct"), F.desc("similarity"), "new", "old")
    pairs = proposals.alike_pairs(v.join(domains, "memory_id"), "memory_id", 0.2, within="domain").dropDuplicates(["a", "b"])
    return proposals.update_candidates(pairs, m, flow, least=0.2, high=0.3)


@query(sql("""SELECT a, b, similarity, 'up_' || substr(sha256('evokes|' || a || '|' || b), 1, 16) AS id FROM either_way JOIN memories m ON m.memory_id = a JOIN memories n ON n.memory_id = b
  WHERE m.collection <> 'library' AND n.collection = 'library' AND NOT EXISTS (FROM semantic WHERE source_id = a AND target_id = b)
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) <= 2 ORDER BY similarity DESC, a, b LIMIT 40""", ALIKE))
def c07_evokes_proposals(spark, sf_dir):
    """Every record outside the library asks every library text."""
    m, v = T.memories(spark, sf_dir), T.vectors(spark, sf_dir)
    of = lambda condition: v.join(m.where(condition).select("memory_id"), "memory_id", "left_semi")
    pairs = proposals.alike_to(of("collection <> 'library'"), of("collection = 'library'"), "memory_id", 0.2)
    return proposals.evokes_proposals(pairs, m, T.semantic_edges(spark, sf_dir), least=0.2)


@query(sql("""SELECT DISTINCT u.memory_id, r.memory_id AS raw FROM memories u JOIN memories r ON r.doc_id IN (u.doc_id + 5, u.doc_id + 6) AND r.level = 'raw' AND r.collection <> 'library' WHERE u.level = 'understanding'
  AND NOT EXISTS (FROM semantic s WHERE s.role = 'SUPPORTED_BY' AND s.source_id = u.memory_id AND s.target_id = r.memory_id)"""))
def c06_evidence_proposals(spark, sf_dir):
    m = T.memories(spark, sf_dir)
    name = lambda k: F.concat(F.lit("d"), (F.col("doc_id") + k).cast("string"))
    return proposals.evidence_proposals(m.select("memory_id", F.array(name(5), name(6)).alias("source_ids")), m, T.semantic_edges(spark, sf_dir))


def _proposals(spark, sf_dir):
    n = F.col("doc_id")
    return T.memories(spark, sf_dir).select(
        F.concat(F.lit("p"), n.cast("string")).alias("id"), F.when(n % 2 == 0, "evokes").otherwise("updates").alias("kind"), F.when(n % 3 == 0, "pending").when(n % 3 == 1, "approved").otherwise("expired").alias("status"),
        F.when(n % 5 == 0, "low").otherwise("normal").alias("priority"), F.col("ts").alias("created_at"),
    )


PROPOSED = """props AS (SELECT 'p' || doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'evokes' ELSE 'updates' END AS kind, CASE doc_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'expired' END AS status,
  CASE WHEN doc_id % 5 = 0 THEN 'low' ELSE 'normal' END AS priority, ts AS created_at FROM memories)"""


@query(sql("SELECT id, kind, priority FROM props WHERE status = 'pending' ORDER BY priority = 'low', created_at DESC, id LIMIT 20", PROPOSED))
def f05_list_proposals(spark, sf_dir):
    return proposals.pending(_proposals(spark, sf_dir)).select("id", "kind", "priority")


@query(sql("SELECT id FROM props WHERE status = 'expired'", PROPOSED))
def g08_suppressed(spark, sf_dir):
    return proposals.suppressed(_proposals(spark, sf_dir))


@query(sql("SELECT kind, count(*) AS pending, count(*) FILTER (w <= 24) AS new, round(max(w), 3) AS oldest_hours FROM (SELECT kind, (epoch(TIMESTAMP '2024-01-02') - epoch(created_at)) / 3600 AS w FROM props WHERE status = 'pending') GROUP BY 1", PROPOSED))
def d15_review_queue(spark, sf_dir):
    return reports.queue_report(_proposals(spark, sf_dir), _now())


@query(sql("""SELECT seed, member, array_to_string(list_sort(list(DISTINCT lane)), '+') AS lanes FROM (SELECT a AS seed, b AS member, 'semantic' AS lane FROM either_way WHERE similarity >= 0.3 UNION ALL SELECT source_id, target_id, 'flow' FROM flow WHERE weight >= 0.4) GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY seed ORDER BY count(DISTINCT lane) DESC, member) <= 24""", ALIKE))
def j18_candidate_pools(spark, sf_dir):
    """Every record is a seed. A pool takes those of two lanes, which are edges,
    and then the smallest ids, so 24 alike ones a seed are enough."""
    v = T.vectors(spark, sf_dir)
    flow = T.flow_edges(spark, sf_dir).where("weight >= 0.4").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    semantic = proposals.first_alike_to(v, v, "memory_id", 0.3, 24).unionByName(proposals.alike_ends(flow, v, 0.3))
    lane = lambda df: df.select(F.col("a").alias("seed"), F.col("b").alias("member"), F.lit(0.0).alias("score"))
    semantic, flow = lane(semantic), lane(flow)
    return proposals.candidate_pools({"semantic": semantic, "flow": flow}).select("seed", "member", F.array_join("lanes", "+").alias("lanes"))


@query()
def j17_bounded_clusters(spark, sf_dir):
    return greedy.bounded_clusters(T.vectors(spark, sf_dir), _alike(spark, sf_dir, 0.3), secondary=0.25)


@query(sql("SELECT memory_id, coalesce(degree, 0) AS degree FROM memories LEFT JOIN (SELECT memory_id, count(DISTINCT other) AS degree FROM (SELECT source_id AS memory_id, target_id AS other FROM semantic UNION ALL SELECT target_id, source_id FROM semantic) GROUP BY 1) USING (memory_id) WHERE coalesce(degree, 0) < 2 ORDER BY degree, ts, memory_id LIMIT 80"))
def j25_repair_targets(spark, sf_dir):
    return proposals.repair_targets(T.memories(spark, sf_dir), T.semantic_edges(spark, sf_dir))


@query()
def j26_removable_pairs(spark, sf_dir):
    e = T.flow_edges(spark, sf_dir)
    weak = graph.machine_pairs(e, F.expr("timestamp_ntz'1998-06-01 00:00:00'"))
    return proposals.removable_pairs(weak.select("a", "b", "weight", "fired"), graph.degree(e))


def _chunks(spark, sf_dir):
    """Documents cut at line ends, as chunks of their parents."""
    d = T.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("parent_id"), "text")
    lines = d.select("parent_id", F.sha2("text", 256).alias("source_hash"), F.posexplode(F.split("text", r"(?<=\n)")).alias("at", "text")).where("text <> ''")
    n = F.col("at")
    return d, lines.select(
        "parent_id", (n + 1).alias("chunk_no"), "text", F.substring("text", 1, 10).alias("index_label"), F.lit("narrative").alias("chunk_role"),
        F.when(n == 0, "root").when(n % 3 == 2, "echo").otherwise("extends").alias("relationship"), F.when(n % 3 == 2, n).alias("echo_of"), (n % 2 == 0).alias("adds_new_insight"), F.lit("index").alias("index_policy"), "source_hash",
    )


@query(sql("""SELECT DISTINCT parent_id, unnest(CASE WHEN i <> 1 THEN [] WHEN doc_id % 11 = 1 THEN (CASE WHEN n > 1 THEN ['tiling', 'length'] ELSE ['tiling', 'length'] END) WHEN doc_id % 11 = 2 THEN ['role'] WHEN doc_id % 11 = 3 THEN ['relation'] WHEN doc_id % 11 = 4 THEN ['label']
    WHEN doc_id % 11 = 5 THEN ['echo'] WHEN doc_id % 11 = 6 THEN ['numbering'] ELSE [] END) AS rule FROM (SELECT doc_id, 'd' || doc_id AS parent_id, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents WHERE text <> '')"""))
def h50_chunk_contract(spark, sf_dir):
    """The first chunk of most parents is spoiled, each in its own way."""
    parents, parts = _chunks(spark, sf_dir)
    kind = F.when(F.col("chunk_no") == 1, F.substring("parent_id", 2, 20).cast("long") % 11)
    spoiled = parts.withColumn("kind", kind).withColumns({
        "text": F.when(F.col("kind") == 1, F.concat(F.lit("\u0001"), "text")).otherwise(F.col("text")),
        "chunk_role": F.when(F.col("kind") == 2, "song").otherwise(F.col("chunk_role")), "relationship": F.when(F.col("kind") == 3, "cousin").when(F.col("kind") == 5, "echo").otherwise(F.col("relationship")),
        "index_label": F.when(F.col("kind") == 4, "much too long a label").otherwise(F.col("index_label")), "echo_of": F.when(F.col("kind") == 5, F.lit(None).cast("int")).otherwise(F.col("echo_of")),
        "chunk_no": F.when(F.col("kind") == 6, 0).otherwise(F.col("chunk_no")),
    })
    # A longer first chunk shifts all that follow: the rule is told once a parent.
    return chunks.violations(parents, spoiled)


@query(sql("""SELECT 'd' || doc_id AS parent_id, sum(CASE WHEN i % 3 = 0 AND i % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS context_only, count(*) AS chunks FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents) WHERE NOT (i = n AND line = '') GROUP BY 1"""))
def h47_chunk_policies(spark, sf_dir):
    p = chunks.policies(_chunks(spark, sf_dir)[1])
    return p.groupBy("parent_id").agg(F.count_if(F.col("index_policy") == "context_only").alias("context_only"), F.count("*").alias("chunks"))


@query()
def i13_hydrated_hits(spark, sf_dir):
    _, parts = _chunks(spark, sf_dir)
    hits = parts.where("chunk_no = 1").select(F.col("parent_id").alias("hit_id"), "parent_id", "chunk_no")
    return chunks.hydrated(hits, parts)


@query(sql("SELECT 'd' || doc_id AS parent_id FROM documents WHERE text <> ''"))
def d19_current_parents(spark, sf_dir):
    parents, parts = _chunks(spark, sf_dir)
    return chunks.current_parents(parts, parents.select("parent_id", F.sha2("text", 256).alias("digest")))


@query(sql(r"""SELECT conv_id, turn, CASE WHEN body = '' OR letters = '' OR length(letters) < 2 THEN 'G' WHEN regexp_matches(body, '(?i)\b(fix|deploy|install|run|write|debug|restart)\b') AND regexp_matches(body, '(?i)\b(code|server|script|query|database|test|config)\b') THEN 'F'
  WHEN regexp_matches(body, '(?i)\b(remember|recall|what did i|last time|did we|you said)\b') THEN 'D' ELSE 'other' END AS class FROM (SELECT *, trim(coalesce(text, '')) AS body, regexp_replace(trim(coalesce(text, '')), '[^\p{L}\p{N}]', '', 'g') AS letters FROM conversations)"""))
def i35_question_router(spark, sf_dir):
    plan = router.routed(T.table(spark, sf_dir, "conversations"))
    known = F.when(F.col("plan.class").isin("G", "F", "D"), F.col("plan.class")).otherwise("other")
    return plan.select("conv_id", "turn", known.alias("class"))


@query(sql("SELECT query_id, CASE WHEN now >= 0.1 AND now - coalesce(rest, 0) >= 0.05 THEN 'none' ELSE 'full' END AS decision FROM (SELECT v.vec_id AS query_id, max(c) FILTER (p.label = 0) AS now, max(c) FILTER (p.label <> 0) AS rest FROM vectors v, LATERAL (SELECT label, round(list_cosine_similarity(v.embedding, embedding), 6) AS c FROM vectors QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1) p GROUP BY 1)"))
def i34_prototype_route(spark, sf_dir):
    v = T.vectors(spark, sf_dir)
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))
    prototypes = first.select(F.when(F.col("label") == 0, "immediate").otherwise("other").alias("class"), F.col("embedding").alias("p"))
    pairs = v.crossJoin(F.broadcast(prototypes)).select(F.col("vec_id").alias("query_id"), "class", F.round(cosine("embedding", "p"), 6).alias("similarity"))
    return router.prototype_route(pairs, 0.1, 0.05)


@query(sql("""SELECT query_id, 'd' || doc_id AS memory_id, round((0.7 * r + 0.12 * 0.5 + 0.05 * emotion + 0.03 * least(1, activation / 5)) * CASE WHEN doc_id % 5 = 0 THEN 0.85 ELSE 1 END, 6) AS final
  FROM (SELECT query_id, doc_id, 1.0 / rank AS r FROM text_rank) JOIN memories USING (doc_id)""", TOKENS))
def i23_final_scores(spark, sf_dir):
    return _features(spark, sf_dir).select("query_id", "memory_id", "final")


def _features(spark, sf_dir):
    m = T.memories(spark, sf_dir)
    rows = _text_rank(spark, sf_dir).join(m, "doc_id").select(
        "query_id", "memory_id", F.col("text").alias("body"), (1.0 / F.col("rank")).alias("rerank"), F.lit(0.5).alias("tag"), "emotion", F.lit(0.0).alias("recency"),
        F.least(F.lit(1.0), F.col("activation") / 5).alias("activation"), F.lit(0.0).alias("tier_level"), F.lit(0.0).alias("evidence"), (F.col("doc_id") % 5 == 0).alias("todo"), F.lit(False).alias("repeated"),
    )
    return ranking.scored_candidates(rows)


@query()
def i23_slots(spark, sf_dir):
    return ranking.slots(_features(spark, sf_dir), second=(0.4, 0.3))


@query(sql("SELECT query_id, memory_id, slot FROM (SELECT query_id, memory_id, row_number() OVER (PARTITION BY query_id ORDER BY lane, rank, memory_id) AS slot FROM (SELECT query_id, memory_id, rank, CASE WHEN NOT auto AND k = 1 THEN 0 WHEN auto AND k <= 2 THEN 1 ELSE 2 END AS lane FROM (SELECT query_id, 'd' || doc_id AS memory_id, rank, doc_id % 2 = 0 AS auto, row_number() OVER (PARTITION BY query_id, doc_id % 2 = 0 ORDER BY rank, 'd' || doc_id) AS k FROM text_rank))) WHERE slot <= 4", TOKENS))
def i21_memory_block(spark, sf_dir):
    rows = _text_rank(spark, sf_dir).select("query_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("memory_id"), "rank", (F.col("doc_id") % 2 == 0).alias("auto"))
    return ranking.memory_block(rows)


@query()
def i17_cold_search(spark, sf_dir):
    """Benchmark passages against the chat log: lexical, literal and starred."""
    from ..operators import search

    messages = T.messages(spark, sf_dir).withColumnRenamed("id", "doc_id").select("doc_id", "text")
    lexical = search.bm25(messages, T.search_queries(spark, sf_dir), limit=80).select("query_id", F.col("doc_id").alias("id"), "rank", F.lit(0.5).alias("coverage"))
    literal = lexical.where("rank <= 2").select("query_id", "id", F.lit(2).alias("terms"))
    starred = lexical.where("rank = 1 AND id % 7 = 0").select("query_id", "id", F.lit(1).alias("terms"))
    return ranking.cold_hits(lexical, literal, starred)


@query(sql("SELECT memories, edges, vectors, pending, islands, memories = vectors + pending AS consistent FROM (SELECT count(*) AS memories FROM memories), (SELECT count(*) AS edges FROM semantic), (SELECT count(*) AS vectors FROM vectors), (SELECT count(*) AS pending FROM memories WHERE memory_id NOT IN (SELECT memory_id FROM vectors)), (SELECT count(*) AS islands FROM memories WHERE memory_id NOT IN (SELECT source_id FROM semantic UNION SELECT target_id FROM semantic))"))
def d21_graph_health(spark, sf_dir):
    m, v = T.memories(spark, sf_dir), T.vectors(spark, sf_dir)
    return reports.graph_health(m, T.semantic_edges(spark, sf_dir), v, lifecycle.pending_vectors(m, v))


@query(sql("SELECT count(*) FILTER (len(tags) = 0) AS untagged, count(*) FILTER (list_contains(tags, 'state:current') AND ts < TIMESTAMP '2024-01-15 08:00:00' - INTERVAL 14 DAY) AS stale_current, count(*) AS memories FROM memories"))
def d10_tag_health(spark, sf_dir):
    return reports.tag_health(T.memories(spark, sf_dir), F.expr("timestamp_ntz'2024-01-15 08:00:00'"))


@query(sql("SELECT coalesce(a.k, b.k) AS k, coalesce(l, 0) AS left, coalesce(r, 0) AS right, CASE WHEN r > 0 THEN round(coalesce(l, 0) / r, 6) END AS ratio, coalesce(abs(1 - round(coalesce(l, 0) / r, 6)) > 0.2, true) AS alert FROM (SELECT c_nationkey AS k, count(*) AS l FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS r FROM supplier GROUP BY 1) b ON a.k = b.k"))
def d14_reconcile(spark, sf_dir):
    return reports.reconciled(T.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), T.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), "k")


@query(sql("SELECT event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1"))
def n12_latest_runs(spark, sf_dir):
    return reports.latest(T.table(spark, sf_dir, "events"), "event_type", "ts").select("event_type", "event_id", F.round("value", 6).alias("value"))


@query(sql("SELECT tags[1] AS shelf, count(*) AS n, array_to_string(list_sort(list(memory_id)), ',') AS items FROM memories WHERE collection = 'library' GROUP BY 1"))
def n04_manifest(spark, sf_dir):
    return reports.manifest(T.memories(spark, sf_dir)).select("shelf", "n", F.array_join("items", ",").alias("items"))


@query(sql("""SELECT place, section, memory_id FROM (SELECT * FROM (SELECT 0 AS place, 'hot' AS section, memory_id FROM live WHERE activation >= 2 ORDER BY activation DESC, memory_id LIMIT 2) UNION ALL SELECT * FROM (SELECT 1, 'warm', memory_id FROM live WHERE activation >= 0.6 AND activation < 2 ORDER BY activation DESC, memory_id LIMIT 1)
  UNION ALL SELECT 2, 'pinned', memory_id FROM memories WHERE pinned UNION ALL SELECT * FROM (SELECT 3, 'newest', memory_id FROM memories ORDER BY ts DESC, memory_id LIMIT 2) UNION ALL SELECT * FROM (SELECT 4, 'old', memory_id FROM memories ORDER BY ts, memory_id LIMIT 1)) QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY place) = 1""",
           "live AS (SELECT * FROM memories WHERE memory_id NOT IN (SELECT target_id FROM semantic WHERE role = 'updates'))"))
def n03_briefing(spark, sf_dir):
    return reports.briefing(T.memories(spark, sf_dir), T.semantic_edges(spark, sf_dir))


@query(sql("SELECT id, CASE WHEN later >= 2 AND kind <> 'user' AND length(text) > 200 THEN '[earlier result removed]' ELSE text END AS text FROM (SELECT *, coalesce(sum(CASE WHEN kind = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS later FROM messages)"))
def h92_trim_rounds(spark, sf_dir):
    return reports.trimmed_rounds(T.messages(spark, sf_dir)).select("id", "text")


@query(sql("SELECT level, n AS now, m AS was, round(coalesce(n, 0) - coalesce(m, 0), 6) AS delta FROM (SELECT level, round(avg(activation), 6) AS n FROM memories GROUP BY 1) FULL JOIN (SELECT level, round(avg(activation), 6) AS m FROM memories WHERE tier = 'short' GROUP BY 1) USING (level)"))
def o70_snapshot_delta(spark, sf_dir):
    m = T.memories(spark, sf_dir)
    mean = lambda df: df.groupBy("level").agg(F.round(F.avg("activation"), 6).alias("mean"))
    return reports.snapshot_delta(mean(m), mean(m.where("tier = 'short'")), "level", "mean")


@query(sql("SELECT a, b, similarity FROM alike JOIN vectors x ON a = x.memory_id JOIN vectors y ON b = y.memory_id WHERE similarity >= 0.3 AND x.vec_id % 10 <> 3 AND y.vec_id % 10 <> 3", ALIKE))
def n18_kept_pairs(spark, sf_dir):
    """Pairs kept over three runs: most vectors, then the rest with some turned
    round, then those as they are and some gone; the same as one whole join."""
    v = T.vectors(spark, sf_dir).select("memory_id", "vec_id", "embedding")
    turned = F.when(F.col("vec_id") % 7 == 2, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding")).alias("embedding")
    kept = kept_pairs.KeptPairs(spark, f"{shared_folder(spark)}/kept-pairs-{uuid.uuid4().hex}")
    kept.update(v.where("vec_id % 4 <> 1").select("memory_id", "embedding"))
    kept.update(v.select("memory_id", turned))
    kept.update(v.where("vec_id % 10 <> 3").select("memory_id", "embedding"))
    kept.store.vacuum()
    return kept.pairs()


@query(sql("""SELECT * FROM (SELECT 'trash' AS task, 'trash' AS "table", count(*) AS before, count(*) FILTER (ts >= TIMESTAMP '2024-01-08 00:00:00' - INTERVAL 7 DAY) AS after FROM memories WHERE doc_id % 9 = 0
  UNION ALL SELECT 'events', 'events', count(*), count(m.memory_id) FROM (SELECT 'd' || (event_id % (2 * n)) AS memory_id FROM events, (SELECT count(*) AS n FROM documents)) e LEFT JOIN memories m USING (memory_id)
  UNION ALL SELECT 'edges', 'edges', (SELECT count(*) FROM flow), count(*) FROM (SELECT w, row_number() OVER (PARTITION BY source_id ORDER BY w DESC, last_fired DESC, target_id) AS rn FROM
    (SELECT source_id, target_id, last_fired, round(weight * 0.9, 9) AS w FROM flow)) WHERE rn = 1 OR w >= 0.1
  UNION ALL SELECT 'tier', 'memories', count(*), count(*) FROM memories)"""))
def l59_maintenance(spark, sf_dir):
    """A dry run, then the run that applies; what the new snapshot holds."""
    m = T.memories(spark, sf_dir).select("doc_id", "memory_id", "ts", F.when(F.col("doc_id") % 17 == 0, "odd").otherwise(F.col("tier")).alias("tier"))
    n = m.agg(F.count("*").alias("n"))
    log = T.table(spark, sf_dir, "events").select("event_id").crossJoin(F.broadcast(n)).select("event_id", F.concat(F.lit("d"), (F.col("event_id") % (2 * F.col("n"))).cast("string")).alias("memory_id"))
    store = Store(spark, f"{shared_folder(spark)}/maintained-{uuid.uuid4().hex}")
    store.commit({"memories": m, "events": log, "edges": T.flow_edges(spark, sf_dir), "trash": m.where("doc_id % 9 = 0").withColumnRenamed("ts", "deleted_at")})
    now = F.expr("timestamp_ntz'2024-01-08 00:00:00'")
    planned = maintenance.run(store, now)
    assert store.snapshot().version == 1
    applied = maintenance.run(store, now, apply=True)
    after = None
    for name in ("trash", "events", "edges", "memories"):
        row = store.read(name).agg(F.lit(name).alias("table"), F.count("*").alias("held"))
        after = row if after is None else after.unionByName(row)
    same = planned.select("task", "table", "before", "after").intersect(applied.select("task", "table", "before", "after"))
    return same.join(after, "table").where("after = held").select("task", "table", "before", "after")
