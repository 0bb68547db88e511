"""Queries on the final state of merges, deletes and change feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle
from ..sources import tables as T
from .oracle import sql
from .registry import query


def _small(spark, sf_dir):
    return T.memories(spark, sf_dir).select("memory_id", "doc_id", "tier", "level", "activation", "emotion", "usage_count")


@query(sql("""SELECT coalesce(o.memory_id, n.memory_id) AS memory_id, coalesce(n.level, o.level) AS level, round(coalesce(o.emotion, n.emotion), 6) AS emotion, o.tier
  FROM memories o FULL JOIN (SELECT 'd' || (doc_id + 5) AS memory_id, 'raw' AS level, 0.1 AS emotion FROM labels) n USING (memory_id)"""))
def l01_upsert(spark, sf_dir):
    new = T.table(spark, sf_dir, "labels").select(F.concat(F.lit("d"), (F.col("doc_id") + 5).cast("string")).alias("memory_id"), F.lit("raw").alias("level"), F.lit(0.1).alias("emotion"))
    return lifecycle.upserted(_small(spark, sf_dir), new, "memory_id", keep=("emotion",)).select("memory_id", "level", F.round("emotion", 6).alias("emotion"), "tier")


def _toxic(spark, sf_dir):
    return T.table(spark, sf_dir, "labels").where("toxic = 1").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("memory_id"))


GONE = "gone AS (SELECT DISTINCT 'd' || doc_id AS memory_id FROM labels WHERE toxic = 1)"


@query(sql("""SELECT 'memories' AS tab, count(*) AS n FROM memories WHERE memory_id NOT IN (FROM gone) UNION ALL SELECT 'trash', count(*) FROM memories WHERE memory_id IN (FROM gone)
  UNION ALL SELECT 'flow', count(*) FROM flow WHERE source_id NOT IN (FROM gone) AND target_id NOT IN (FROM gone)""", GONE))
def l02_soft_delete(spark, sf_dir):
    kept, trash, left = lifecycle.soft_deleted(_small(spark, sf_dir), {"flow": (T.flow_edges(spark, sf_dir), ("source_id", "target_id"))}, _toxic(spark, sf_dir), F.current_timestamp(), "job")
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tab"), "n")
    return count("memories", kept).unionByName(count("trash", trash)).unionByName(count("flow", left["flow"]))


@query(sql("SELECT memory_id, tier FROM memories"))
def l03_restore(spark, sf_dir):
    m = _small(spark, sf_dir)
    kept, trash, _ = lifecycle.soft_deleted(m, {}, _toxic(spark, sf_dir), F.current_timestamp(), "job")
    return lifecycle.restored(kept, trash, _toxic(spark, sf_dir))[0].select("memory_id", "tier")


@query(sql("SELECT memory_id FROM memories WHERE NOT (tier = 'short' AND ts < TIMESTAMP '2024-01-02' - INTERVAL 1 DAY + INTERVAL 200 MINUTE)"))
def l05_decay_short(spark, sf_dir):
    m, now = T.memories(spark, sf_dir), F.expr("timestamp_ntz'2024-01-02 03:20:00'")
    fresh = lifecycle.purged(m.where("tier = 'short'"), "ts", now, 1)
    return m.where("tier <> 'short'").select("memory_id").union(fresh.select("memory_id"))


@query(sql("""SELECT memory_id, usage_count + coalesce(n, 0) AS usage_count, round(CASE WHEN memory_id IN (FROM gone) THEN greatest(0, least(20, activation - 2)) ELSE activation END, 6) AS activation
  FROM memories LEFT JOIN (SELECT 'd' || (event_id % 500) AS memory_id, count(*) AS n FROM events GROUP BY 1) USING (memory_id)""", GONE))
def l13_cite_and_cool(spark, sf_dir):
    hits = T.table(spark, sf_dir, "events").select(F.concat(F.lit("d"), (F.col("event_id") % 500).cast("string")).alias("memory_id"))
    m = lifecycle.cited(_small(spark, sf_dir), hits, F.current_timestamp())
    return lifecycle.cooled(m, _toxic(spark, sf_dir)).select("memory_id", "usage_count", F.round("activation", 6).alias("activation"))


FEED = """feed AS (SELECT user_id AS k, event_type, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS op, event_id AS revision, value FROM events),
latest AS (SELECT * FROM feed QUALIFY row_number() OVER (PARTITION BY k ORDER BY revision DESC) = 1)"""


@query(sql("""SELECT k, event_type, round(value, 6) AS value FROM latest WHERE op <> 'delete' UNION ALL SELECT c_custkey, 'seed', round(c_acctbal, 6) FROM customer WHERE c_custkey NOT IN (SELECT k FROM latest)""", FEED))
def k03_change_feed(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), "event_type", F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"), F.col("event_id").alias("revision"), F.round("value", 6).alias("value"))
    state = T.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit("seed").alias("event_type"), F.round("c_acctbal", 6).alias("value"))
    return lifecycle.folded_changes(state, e, "k")


@query(sql("SELECT k, arg_max(event_type, revision) AS op, count(*) AS revision FROM feed GROUP BY 1", FEED))
def k06_outbox(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").withColumnRenamed("user_id", "k")
    return lifecycle.outbox(e, "k", "event_type", "event_id")


@query(sql("SELECT memory_id FROM memories WHERE memory_id NOT IN (SELECT memory_id FROM vectors)"))
def k07_pending_vectors(spark, sf_dir):
    return lifecycle.pending_vectors(_small(spark, sf_dir), T.vectors(spark, sf_dir)).select("memory_id")


@query(sql("""SELECT memory_id, round(greatest(0, least(8, activation + coalesce(b, 0))), 6) AS activation FROM memories LEFT JOIN (SELECT memory_id, sum(b) AS b FROM (
  SELECT DISTINCT source_id, target_id, source_id AS memory_id, 0.05 AS b FROM semantic WHERE role = 'updates' UNION ALL SELECT DISTINCT source_id, target_id, target_id, -0.05 FROM semantic WHERE role = 'updates') GROUP BY 1) USING (memory_id)"""))
def l17_update_bias(spark, sf_dir):
    u = T.semantic_edges(spark, sf_dir).where("role = 'updates'")
    return lifecycle.bias_once(_small(spark, sf_dir), u, u.select("source_id", "target_id").where("false")).select("memory_id", F.round("activation", 6).alias("activation"))


@query(sql("SELECT memory_id, array_to_string(CASE WHEN memory_id IN (SELECT target_id FROM semantic WHERE role = 'updates') THEN list_transform(tags, lambda t: CASE WHEN t = 'state:current' THEN 'state:past' ELSE t END) ELSE tags END, ',') AS tags FROM memories"))
def g09_sync_states(spark, sf_dir):
    return lifecycle.states_synced(T.memories(spark, sf_dir), T.semantic_edges(spark, sf_dir)).select("memory_id", F.array_join("tags", ",").alias("tags"))


@query(sql("SELECT id, CASE WHEN status = 'pending' AND d.toxic IS NOT NULL THEN CASE d.toxic WHEN 0 THEN 'approved' ELSE 'rejected' END ELSE status END AS status FROM (SELECT doc_id, 'p' || doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'expired' END AS status FROM documents) p LEFT JOIN labels d USING (doc_id)"))
def l41_review_decisions(spark, sf_dir):
    n = F.col("doc_id")
    proposals = T.table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), n.cast("string")).alias("id"), F.when(n % 3 == 0, "pending").when(n % 3 == 1, "approved").otherwise("expired").alias("status"))
    decisions = T.table(spark, sf_dir, "labels").select(F.concat(F.lit("p"), n.cast("string")).alias("id"), F.when(F.col("toxic") == 0, "approve").otherwise("reject").alias("decision"))
    return lifecycle.transitioned(proposals, decisions)


@query(sql("""SELECT doc_id, CASE WHEN n IS NULL THEN 'delete' WHEN o IS NULL THEN 'insert' ELSE 'update' END AS change FROM (SELECT doc_id, n_chars AS o FROM documents) FULL JOIN (SELECT doc_id + 5 AS doc_id, n_chars AS n FROM documents) USING (doc_id) WHERE o IS DISTINCT FROM n"""))
def l35_document_diff(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return lifecycle.document_diff(d, d.select((F.col("doc_id") + 5).alias("doc_id"), "n_chars"), "doc_id", ["n_chars"])


@query(sql("""SELECT a.m AS source_id, b.m AS target_id, 0.15::DOUBLE AS weight FROM best a JOIN best b ON a.m < b.m""", "best AS (SELECT 'd' || (event_id % 200) AS m, round(sum(value), 6) AS s FROM events GROUP BY 1 ORDER BY s DESC, m LIMIT 30)"))
def l51_consolidate(spark, sf_dir):
    hits = T.table(spark, sf_dir, "events").groupBy(F.concat(F.lit("d"), (F.col("event_id") % 200).cast("string")).alias("memory_id")).agg(F.round(F.sum("value"), 6).alias("score"))
    return lifecycle.consolidated_pairs(hits)


@query(sql("SELECT source_id, target_id, CASE role WHEN 'updates' THEN 'updates' ELSE 'SUPPORTED_BY' END AS canonical FROM semantic"))
def l25_canonical_roles(spark, sf_dir):
    return T.semantic_edges(spark, sf_dir).select("source_id", "target_id", lifecycle.canonical_role(F.lower("role")).alias("canonical"))
