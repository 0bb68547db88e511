"""The belief ledger: case weights, confidence, routing, life cycle, briefing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRIOR, HALF_LIFE, LEAST_DECAY, PROMOTE = 2.0, 90, 0.3, 0.40


def case_weights(cases: DataFrame, memories: DataFrame, now: Column) -> DataFrame:
    """Cases with ``weight``: emotion times a decay by age that never falls
    below 0.3; a case whose record is gone weighs 0.5 x 0.3; an emotion of 0
    counts as 0.5."""
    m = memories.select("memory_id", F.when(F.coalesce("emotion", F.lit(0.0)) == 0, 0.5).otherwise(F.col("emotion")).alias("emotion"), F.lit(True).alias("there"))
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("occurred_at").cast("timestamp"))) / 86400)
    decay = F.greatest(F.lit(LEAST_DECAY), F.pow(F.lit(0.5), F.coalesce(age, F.lit(0.0)) / HALF_LIFE))
    return cases.join(m, "memory_id", "left").withColumn("weight", F.when(F.col("there"), F.col("emotion") * decay).otherwise(0.5 * LEAST_DECAY)).drop("emotion", "there")


def confidence(beliefs: DataFrame, weighted: DataFrame) -> DataFrame:
    """Support over support plus contradiction plus a prior of 2; boundary
    cases do not count."""
    sums = weighted.groupBy("belief_id").agg(
        F.sum(F.when(F.col("case_kind") == "support", F.col("weight")).otherwise(0.0)).alias("s"),
        F.sum(F.when(F.col("case_kind") == "contradiction", F.col("weight")).otherwise(0.0)).alias("c"),
    )
    s, c = F.coalesce("s", F.lit(0.0)), F.coalesce("c", F.lit(0.0))
    return beliefs.join(sums, "belief_id", "left").withColumn("confidence", s / (s + c + PRIOR)).drop("s", "c")


def routed(scored: DataFrame) -> DataFrame:
    return scored.where((F.col("status") == "active") & (F.col("pinned") | (F.col("confidence") >= PROMOTE)))


def promoted(scored: DataFrame) -> DataFrame:
    """Status after promoting candidates with enough confidence and demoting
    unpinned active beliefs without it."""
    enough = F.col("confidence") >= PROMOTE
    return scored.withColumn("status", F.when((F.col("status") == "candidate") & enough, "active").when((F.col("status") == "active") & ~F.col("pinned") & ~enough, "candidate").otherwise(F.col("status")))


def brief(scored: DataFrame, cases: DataFrame, now: Column, most: int = 3) -> DataFrame:
    """Active beliefs by tier (a case in 7 days, touched in 7 days, others),
    pin and confidence; the first ``most``."""
    week = now - F.expr("interval 7 days")
    fresh = cases.where(F.col("occurred_at") >= week).select("belief_id").distinct().withColumn("fresh", F.lit(True))
    tier = F.when(F.col("fresh"), 1).when(F.col("last_touched") >= week, 2).otherwise(3)
    ranked = scored.where("status = 'active'").join(fresh, "belief_id", "left").withColumn("tier", tier)
    order = Window.orderBy("tier", F.desc("pinned"), F.desc(F.round("confidence", 6)), "belief_id")
    # Beliefs are few, statements written by hand; one window orders them.
    return ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def next_id(beliefs: DataFrame) -> DataFrame:
    """The next name of the form b-NNNN."""
    n = F.max(F.regexp_extract("belief_id", r"(\d+)$", 1).cast("int"))
    return beliefs.agg(F.format_string("b-%04d", F.coalesce(n, F.lit(0)) + 1).alias("belief_id"))


def exported(beliefs: DataFrame, cases: DataFrame) -> DataFrame:
    """One nested row a belief: its cases by kind, ordered."""
    kinds = ("support", "contradiction", "boundary")
    lists = cases.groupBy("belief_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("case_kind") == k, F.col("case_id")))).alias(k) for k in kinds])
    return beliefs.join(lists, "belief_id", "left")


def imported(nested: DataFrame) -> DataFrame:
    """Flat cases of nested belief rows: the inverse of :func:`exported`."""
    parts = [nested.select("belief_id", F.lit(k).alias("case_kind"), F.explode(k).alias("case_id")) for k in ("support", "contradiction", "boundary")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
