"""Queries over the relations between records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import graph, proposals, structure
from ..sources import tables as T
from .oracle import sql
from .registry import query

def _now():
    return F.expr("timestamp_ntz'1998-06-01 00:00:00'")

EITHER = "either AS (SELECT source_id AS memory_id, target_id AS other, 'out' AS direction, weight FROM flow UNION ALL SELECT target_id, source_id, 'in', weight FROM flow)"


@query(sql("SELECT source_id, target_id, weight, row_number() OVER (PARTITION BY source_id ORDER BY weight DESC, target_id) AS rank FROM flow WHERE weight >= 0.2 QUALIFY rank <= 5"))
def j08_neighbors(spark, sf_dir):
    return graph.neighbors(T.flow_edges(spark, sf_dir), T.memories(spark, sf_dir), 0.2)


@query(sql("SELECT memory_id, other, direction, round(weight, 6) AS weight FROM either", EITHER))
def j10_flow_neighbors(spark, sf_dir):
    return graph.both_directions(T.flow_edges(spark, sf_dir), "weight").withColumn("weight", F.round("weight", 6))


@query(sql("SELECT memory_id, other, direction, role, strength FROM (SELECT source_id AS memory_id, target_id AS other, 'out' AS direction, role, round(strength, 6) AS strength, created FROM semantic WHERE review_state = 'approved' UNION ALL SELECT target_id, source_id, 'in', role, round(strength, 6), created FROM semantic WHERE review_state = 'approved') QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY strength DESC, created DESC, other) <= 20"))
def j11_semantic_neighbors(spark, sf_dir):
    both = graph.both_directions(T.semantic_edges(spark, sf_dir).where("review_state = 'approved'").withColumn("strength", F.round("strength", 6)), "role", "strength", "created")
    order = Window.partitionBy("memory_id").orderBy(F.desc("strength"), F.desc("created"), "other")
    return both.withColumn("k", F.row_number().over(order)).where("k <= 20").select("memory_id", "other", "direction", "role", "strength")


@query(sql("SELECT memory_id, count(DISTINCT other) AS degree FROM either GROUP BY 1", EITHER))
def d04_degree(spark, sf_dir):
    return graph.degree(T.flow_edges(spark, sf_dir))


@query(sql("""SELECT source_id, target_id, round(w, 6) AS weight FROM (SELECT source_id, target_id, w, row_number() OVER (PARTITION BY source_id ORDER BY w DESC, last_fired DESC, target_id) AS rn FROM
  (SELECT source_id, target_id, last_fired, round(weight * 0.9, 9) AS w FROM flow)) WHERE rn = 1 OR w >= 0.3"""))
def e01_decay_edges(spark, sf_dir):
    return graph.decayed_edges(T.flow_edges(spark, sf_dir), least=0.3).select("source_id", "target_id", F.round("weight", 6).alias("weight"))


@query(sql("SELECT source_id, target_id, round(CASE WHEN weight >= 0.4 THEN weight * 0.95 ELSE weight END, 6) AS weight FROM flow"))
def j04_decay_strong_edges(spark, sf_dir):
    return graph.decayed_strong_edges(T.flow_edges(spark, sf_dir), least=0.4).select("source_id", "target_id", F.round("weight", 6).alias("weight"))


HUB = """strength AS (SELECT source_id, sum(weight * conductance) AS strength FROM flow GROUP BY 1),
hub AS (SELECT strength AS hub FROM (SELECT strength, row_number() OVER (ORDER BY round(strength, 9), source_id) AS k, count(*) OVER () AS n FROM strength) WHERE k = floor(0.9 * (n - 1) + 0.5) + 1),
after AS (SELECT memory_id, activation * least(0.90, 0.82 + 0.05 * least(1.0, coalesce(strength, 0) / hub) + 0.03 * greatest(0.0, least(1.0, (CASE WHEN emotion = 0 THEN 0.5 ELSE emotion END - 0.5) * 2))) AS a
  FROM memories LEFT JOIN strength ON memory_id = source_id, hub)"""


@query(sql("SELECT memory_id, round(CASE WHEN a <= 0.02 THEN 0 ELSE a END, 6) AS activation FROM after", HUB))
def j03_decay_activation(spark, sf_dir):
    return graph.decayed_activation(T.memories(spark, sf_dir), T.flow_edges(spark, sf_dir))


@query(sql("""SELECT o.memory_id, CASE WHEN h.old IS NULL AND newest IS NOT NULL THEN newest END AS newest, h.old IS NULL AND newest IS NOT NULL AS resolved FROM (SELECT old AS memory_id FROM hop) o LEFT JOIN newest USING (memory_id) LEFT JOIN hop h ON h.old = newest""",
           """hop AS (SELECT target_id AS old, arg_max(source_id, (created, source_id)) AS new FROM semantic WHERE role = 'updates' AND review_state IN ('approved', 'auto') GROUP BY 1),
newest AS (SELECT h0.old AS memory_id, coalesce(h4.new, h3.new, h2.new, h1.new, h0.new) AS newest FROM hop h0 LEFT JOIN hop h1 ON h0.new = h1.old LEFT JOIN hop h2 ON h1.new = h2.old
  LEFT JOIN hop h3 ON h2.new = h3.old LEFT JOIN hop h4 ON h3.new = h4.old)"""))
def j05_resolve_updates(spark, sf_dir):
    return graph.resolved_updates(T.semantic_edges(spark, sf_dir))


@query(sql("""SELECT DISTINCT memory_id FROM (WITH RECURSIVE walk AS (SELECT source_id AS memory_id, target_id AS place FROM semantic WHERE role = 'updates'
  UNION SELECT memory_id, s.target_id FROM walk JOIN semantic s ON s.source_id = place WHERE s.role = 'updates') SELECT memory_id, place FROM walk) WHERE memory_id = place"""))
def j06_update_cycles(spark, sf_dir):
    return graph.on_cycle(T.semantic_edges(spark, sf_dir))


@query(sql("""SELECT source_id, target_id, role, CASE WHEN s.memory_id IS NULL OR t.memory_id IS NULL THEN 'missing end' WHEN source_id = target_id THEN 'self edge'
  WHEN role = 'SUPPORTED_BY' AND (s.level <> 'understanding' OR t.level <> 'raw') THEN 'needs understanding to raw' WHEN role = 'SUPPORTED_BY' AND t.collection = 'library' THEN 'library is no evidence' END AS reason
  FROM semantic LEFT JOIN memories s ON source_id = s.memory_id LEFT JOIN memories t ON target_id = t.memory_id WHERE reason IS NOT NULL"""))
def b25_typed_edge_contract(spark, sf_dir):
    return graph.typed_violations(T.semantic_edges(spark, sf_dir), T.memories(spark, sf_dir))


def _roots(spark, sf_dir):
    return T.memories(spark, sf_dir).where("pinned").select("memory_id", F.row_number().over(Window.orderBy("doc_id")).alias("place"))


@query()
def j01_heat_spread(spark, sf_dir):
    return graph.heat_spread(T.memories(spark, sf_dir), T.flow_edges(spark, sf_dir), _roots(spark, sf_dir), 0.4)


@query(sql("""SELECT a, b, round(weight, 6) AS weight, kind FROM (SELECT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b, max(weight) AS weight, max(last_fired) AS fired,
  bool_and(starts_with(provenance, 'auto_') OR provenance IN ('cluster', 'knn_legacy')) AS machine, CASE WHEN max(weight) < 0.08 THEN 'weak' WHEN max(weight) < 0.5 AND max(last_fired) < TIMESTAMP '1998-06-01' - INTERVAL 14 DAY THEN 'stale' END AS kind
  FROM flow GROUP BY 1, 2) WHERE machine AND kind IS NOT NULL"""))
def j26_machine_pairs(spark, sf_dir):
    return graph.machine_pairs(T.flow_edges(spark, sf_dir), _now()).select("a", "b", F.round("weight", 6).alias("weight"), "kind")


@query(sql("""SELECT source_id, target_id, round(least(10.0, CASE WHEN o.weight IS NOT NULL AND n.weight IS NOT NULL THEN o.weight + n.weight ELSE coalesce(n.weight, o.weight) END), 6) AS weight,
  round(coalesce(n.conductance, o.conductance), 6) AS conductance, CASE WHEN n.weight IS NOT NULL THEN 'manual' ELSE o.provenance END AS provenance
  FROM flow o FULL JOIN (SELECT target_id AS source_id, source_id AS target_id, weight, conductance FROM flow) n USING (source_id, target_id)"""))
def l29_write_flow_manual(spark, sf_dir):
    old = T.flow_edges(spark, sf_dir)
    new = old.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "weight", "conductance", "last_fired", "provenance")
    return graph.merged_flow(old, new, "manual").select("source_id", "target_id", F.round("weight", 6).alias("weight"), F.round("conductance", 6).alias("conductance"), "provenance")


@query(sql("""SELECT source_id, target_id, round(CASE WHEN o.weight IS NOT NULL AND n.weight IS NOT NULL THEN greatest(o.weight, n.weight) ELSE coalesce(n.weight, o.weight) END, 6) AS weight,
  round(CASE WHEN o.weight IS NOT NULL AND n.weight IS NOT NULL THEN greatest(o.conductance, n.conductance) ELSE coalesce(n.conductance, o.conductance) END, 6) AS conductance,
  CASE WHEN o.weight IS NOT NULL AND n.weight IS NOT NULL THEN CASE WHEN o.provenance = 'manual' THEN 'manual' ELSE n.provenance END ELSE coalesce(n.provenance, o.provenance) END AS provenance
  FROM flow o FULL JOIN (SELECT target_id AS source_id, source_id AS target_id, weight, conductance, provenance FROM flow) n USING (source_id, target_id)"""))
def l29_write_flow_auto(spark, sf_dir):
    old = T.flow_edges(spark, sf_dir)
    new = old.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "weight", "conductance", "last_fired", "provenance")
    return graph.merged_flow(old, new, "auto").select("source_id", "target_id", F.round("weight", 6).alias("weight"), F.round("conductance", 6).alias("conductance"), "provenance")


@query(sql("""SELECT memory_id, round(CASE WHEN mean IS NOT NULL AND round(abs(mean - emotion), 9) > 0.2 THEN greatest(0.0, least(1.0, emotion + sign(mean - emotion) * 0.05)) ELSE emotion END, 6) AS emotion FROM memories LEFT JOIN
  (SELECT e.memory_id, avg(m.emotion) AS mean FROM (SELECT DISTINCT memory_id, other FROM either WHERE weight >= 0.2) e JOIN memories m ON m.memory_id = other GROUP BY 1) USING (memory_id)""", EITHER))
def c04_equalise_emotion(spark, sf_dir):
    return graph.equalised_emotion(T.memories(spark, sf_dir), T.flow_edges(spark, sf_dir), least=0.2)


@query(sql("SELECT 'flow' AS family, provenance AS kind, count(*) AS edges FROM flow GROUP BY 2 UNION ALL SELECT 'semantic', role || ':' || review_state, count(*) FROM semantic GROUP BY role, review_state"))
def j30_edge_counts(spark, sf_dir):
    f = T.flow_edges(spark, sf_dir).groupBy(F.col("provenance").alias("kind")).agg(F.count("*").alias("edges")).select(F.lit("flow").alias("family"), "kind", "edges")
    s = T.semantic_edges(spark, sf_dir).groupBy(F.concat_ws(":", "role", "review_state").alias("kind")).agg(F.count("*").alias("edges"))
    return f.unionByName(s.select(F.lit("semantic").alias("family"), "kind", "edges"))


@query(sql("SELECT s.level AS source_level, t.level AS target_level, f.provenance, count(*) AS edges FROM flow f JOIN memories s ON source_id = s.memory_id JOIN memories t ON target_id = t.memory_id WHERE s.level <> t.level GROUP BY ALL"))
def c02_cross_level_edges(spark, sf_dir):
    m = T.memories(spark, sf_dir).select("memory_id", "level")
    e = T.flow_edges(spark, sf_dir).select("source_id", "target_id", "provenance")
    both = e.join(m.toDF("source_id", "source_level"), "source_id").join(m.toDF("target_id", "target_level"), "target_id")
    return both.where("source_level <> target_level").groupBy("source_level", "target_level", "provenance").agg(F.count("*").alias("edges"))


@query(sql("""SELECT a, b, similarity, round(0.12 + greatest(0.0, least(1.0, (similarity - 0.82) / 0.18)) * 0.12, 6) AS weight FROM (
  SELECT x.memory_id AS a, y.memory_id AS b, round(list_cosine_similarity(x.embedding, y.embedding), 6) AS similarity FROM vectors x JOIN vectors y ON x.vec_id <> y.vec_id AND x.vec_id % 50 = 0) p
  JOIN memories s ON s.memory_id = a JOIN memories t ON t.memory_id = b WHERE similarity >= 0.1 AND s.collection <> 'library' AND t.collection <> 'library'
  AND ((s.level = t.level AND s.level <> 'cognition') OR (s.level = 'cognition' AND t.level IN ('raw', 'understanding')))
  AND NOT EXISTS (FROM semantic f WHERE least(f.source_id, f.target_id) = least(a, b) AND greatest(f.source_id, f.target_id) = greatest(a, b))
  AND coalesce((SELECT degree FROM deg WHERE deg.memory_id = a), 0) < 12 AND coalesce((SELECT degree FROM deg WHERE deg.memory_id = b), 0) < 12
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) <= 2""",
           "deg AS (SELECT memory_id, count(DISTINCT other) AS degree FROM (SELECT source_id AS memory_id, target_id AS other FROM semantic UNION ALL SELECT target_id, source_id FROM semantic) GROUP BY 1)"))
def j20_link_proposals(spark, sf_dir):
    """Every vector whose id is divisible by 50 asks for links to all others."""
    v = T.vectors(spark, sf_dir)
    pairs = proposals.alike_to(v.where("vec_id % 50 = 0"), v, "memory_id", 0.1)
    return graph.link_proposals(pairs, T.memories(spark, sf_dir), T.semantic_edges(spark, sf_dir), least=0.1).select("a", "b", "similarity", "weight")


#: Links between records that hold cycles: from an order to the part on its first line, where few are bought.
CYCLIC = """cyclic_links AS (SELECT 'd' || s AS source_id, 'd' || t AS target_id, max(l_shipdate) AS created FROM (
  SELECT l_partkey % n AS s, l_orderkey % n AS t, l_shipdate FROM lineitem, (SELECT count(*) AS n FROM documents) WHERE l_linenumber = 1 AND l_quantity <= 8) GROUP BY s, t)"""
REACHED = """reach AS (SELECT target_id AS a, source_id AS b FROM cyclic_links UNION SELECT a, source_id FROM reach JOIN cyclic_links ON b = target_id),
rings AS (SELECT x.a AS memory_id, least(x.a, min(x.b)) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY 1),
ends AS (SELECT source_id AS memory_id FROM cyclic_links UNION SELECT target_id FROM cyclic_links)"""


def _cyclic_links(spark, sf_dir):
    n = T.table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    lines = T.table(spark, sf_dir, "lineitem").where("l_linenumber = 1 AND l_quantity <= 8").crossJoin(F.broadcast(n))
    name = lambda key: F.concat(F.lit("d"), (F.col(key) % F.col("n")).cast("string"))
    return lines.groupBy(name("l_partkey").alias("source_id"), name("l_orderkey").alias("target_id")).agg(F.max("l_shipdate").alias("created"))


def recursive(body: str, *more: str) -> str:
    return sql(body, *more).replace("WITH ", "WITH RECURSIVE ", 1)


@query(recursive("SELECT memory_id, coalesce(component, memory_id) AS component, component IS NOT NULL AS cyclic FROM ends LEFT JOIN rings USING (memory_id)", CYCLIC, REACHED))
def j13_strong_components(spark, sf_dir):
    return structure.strong_components(_cyclic_links(spark, sf_dir).select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")))


@query(recursive("""SELECT 'up_' || substr(sha256(kind || '|' || source_id || '|' || target_id), 1, 16) AS proposal_id, * FROM (
  SELECT 'structure_cycle' AS kind, e.source_id, e.target_id, size, component FROM (
    SELECT s.component, arg_max({'source_id': source_id, 'target_id': target_id}, (strftime(created, '%Y-%m-%d %H:%M:%S'), source_id, target_id)) AS e
    FROM cyclic_links JOIN rings s ON source_id = s.memory_id JOIN rings t ON target_id = t.memory_id WHERE s.component = t.component GROUP BY 1)
    JOIN (SELECT component, count(*) AS size FROM rings GROUP BY 1) USING (component)
  UNION ALL SELECT 'structure_overlong', latest, start, hops, NULL FROM (SELECT start, tip AS latest, hops FROM walk QUALIFY row_number() OVER (PARTITION BY start ORDER BY hops DESC) = 1)
    WHERE hops > 5 AND start NOT IN (SELECT memory_id FROM rings) AND NOT EXISTS (FROM cyclic_links WHERE source_id = latest AND target_id = start))""", CYCLIC, REACHED,
    "steps AS (SELECT target_id AS memory_id, arg_min(source_id, (-epoch(coalesce(ts, TIMESTAMP '1900-01-01')), source_id)) AS next FROM cyclic_links LEFT JOIN memories ON memory_id = source_id GROUP BY 1)",
    "walk AS (SELECT memory_id AS start, next AS tip, 1::BIGINT AS hops, [memory_id, next] AS path FROM steps WHERE next <> memory_id UNION ALL SELECT start, next, hops + 1, list_append(path, next) FROM walk JOIN steps ON memory_id = tip WHERE NOT list_contains(path, next))"))
def j14_structure_proposals(spark, sf_dir):
    return structure.structure_proposals(_cyclic_links(spark, sf_dir), T.memories(spark, sf_dir))
