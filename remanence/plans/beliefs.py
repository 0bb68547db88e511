"""Queries of the belief ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import beliefs
from ..sources import tables as T
from .oracle import sql
from .registry import query

WEIGHTED = """weighted AS (SELECT c.*, CASE WHEN m.memory_id IS NULL THEN 0.15 ELSE CASE WHEN emotion = 0 THEN 0.5 ELSE emotion END * greatest(0.3, pow(0.5, greatest(0, (epoch(TIMESTAMP '2024-06-01') - epoch(occurred_at)) / 86400) / 90)) END AS weight
  FROM cases c LEFT JOIN memories m USING (memory_id)),
scored AS (SELECT b.*, coalesce(s, 0) / (coalesce(s, 0) + coalesce(c, 0) + 2.0) AS confidence FROM beliefs b LEFT JOIN (SELECT belief_id, sum(weight) FILTER (case_kind = 'support') AS s, sum(weight) FILTER (case_kind = 'contradiction') AS c FROM weighted GROUP BY 1) USING (belief_id))"""


def _now():
    return F.expr("timestamp_ntz'2024-06-01 00:00:00'")


def _scored(spark, sf_dir):
    weighted = beliefs.case_weights(T.belief_cases(spark, sf_dir), T.memories(spark, sf_dir), _now())
    return beliefs.confidence(T.beliefs(spark, sf_dir), weighted)


@query(sql("SELECT case_id, belief_id, case_kind, round(weight, 6) AS weight FROM weighted", WEIGHTED))
def d07_case_weights(spark, sf_dir):
    return beliefs.case_weights(T.belief_cases(spark, sf_dir), T.memories(spark, sf_dir), _now()).select("case_id", "belief_id", "case_kind", F.round("weight", 6).alias("weight"))


@query(sql("SELECT belief_id, status, pinned, round(confidence, 6) AS confidence FROM scored", WEIGHTED))
def d06_confidence(spark, sf_dir):
    return _scored(spark, sf_dir).select("belief_id", "status", "pinned", F.round("confidence", 6).alias("confidence"))


@query(sql("SELECT belief_id FROM scored WHERE status = 'active' AND (pinned OR confidence >= 0.40)", WEIGHTED))
def n02_routing_set(spark, sf_dir):
    return beliefs.routed(_scored(spark, sf_dir)).select("belief_id")


@query(sql("SELECT belief_id, CASE WHEN status = 'candidate' AND confidence >= 0.4 THEN 'active' WHEN status = 'active' AND NOT pinned AND confidence < 0.4 THEN 'candidate' ELSE status END AS status FROM scored", WEIGHTED))
def l39_promote_demote(spark, sf_dir):
    return beliefs.promoted(_scored(spark, sf_dir)).select("belief_id", "status")


@query(sql("""SELECT belief_id, tier, row_number() OVER (ORDER BY tier, pinned DESC, round(confidence, 6) DESC, belief_id) AS place FROM (
  SELECT s.*, CASE WHEN f.belief_id IS NOT NULL THEN 1 WHEN last_touched >= TIMESTAMP '2024-01-03' - INTERVAL 7 DAY THEN 2 ELSE 3 END AS tier FROM scored s
  LEFT JOIN (SELECT DISTINCT belief_id FROM cases WHERE occurred_at >= TIMESTAMP '2024-01-03' - INTERVAL 7 DAY) f USING (belief_id) WHERE status = 'active') QUALIFY place <= 3""", WEIGHTED))
def n01_brief(spark, sf_dir):
    return beliefs.brief(_scored(spark, sf_dir), T.belief_cases(spark, sf_dir), F.expr("timestamp_ntz'2024-01-03 00:00:00'")).select("belief_id", "tier", "place")


@query(sql("SELECT printf('b-%04d', max(regexp_extract(belief_id, '(\\d+)$', 1)::INT) + 1) AS belief_id FROM beliefs"))
def n10_next_belief_id(spark, sf_dir):
    return beliefs.next_id(T.beliefs(spark, sf_dir))


@query(sql("SELECT belief_id, case_kind, case_id FROM cases"))
def a22_export_import(spark, sf_dir):
    return beliefs.imported(beliefs.exported(T.beliefs(spark, sf_dir), T.belief_cases(spark, sf_dir))).select("belief_id", "case_kind", "case_id")


@query(sql("SELECT belief_id, count(*) AS cases, count(*) FILTER (occurred_at >= TIMESTAMP '2024-01-01 05:00:00') AS recent, count(*) FILTER (m.memory_id IS NULL) AS orphans FROM cases c LEFT JOIN memories m USING (memory_id) GROUP BY 1"))
def c15_belief_health(spark, sf_dir):
    m = T.memories(spark, sf_dir).select("memory_id", F.lit(True).alias("there"))
    c = T.belief_cases(spark, sf_dir).join(m, "memory_id", "left")
    return c.groupBy("belief_id").agg(F.count("*").alias("cases"), F.count_if(F.col("occurred_at") >= F.expr("timestamp_ntz'2024-01-01 05:00:00'")).alias("recent"), F.count_if(F.col("there").isNull()).alias("orphans"))
