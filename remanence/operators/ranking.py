"""Selection of what to show: slots, cold lanes, gates, fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signals, text


def scored_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates with their final score, from feature columns ``rerank, tag,
    emotion, recency, activation, tier_level, evidence, todo, repeated``."""
    return candidates.withColumn("final", F.round(signals.rerank_score(*[F.col(c) for c in ("rerank", "tag", "emotion", "recency", "activation", "tier_level", "evidence", "todo", "repeated")]), 6))


def slots(scored: DataFrame, first: tuple[float, float] = (0.50, 0.50), second: tuple[float, float] = (0.72, 0.65)) -> DataFrame:
    """The one or two records to show for each question, with the reject reason
    of the rest: the best that passes its gates, then a second that passes
    higher ones and says something else (bigram overlap below 0.72). Whole
    bodies are compared; those that no gate lets through are not sorted along."""
    gate = lambda g: (F.col("rerank") >= g[0]) & (F.col("final") >= g[1])
    order = Window.partitionBy("query_id").orderBy(F.desc("final"), "memory_id")
    passed = scored.withColumns({"gate": gate(first), "body": F.when(gate(first) | gate(second), F.col("body"))})
    ranked = passed.withColumn("place", F.sum(F.col("gate").cast("int")).over(order))
    top = ranked.where("gate AND place = 1").select("query_id", F.col("body").alias("top_body"), F.col("memory_id").alias("top_id"))
    rest = ranked.join(top, "query_id", "left")
    fits = gate(second) & text.independent(F.col("body"), F.col("top_body"))
    marked = rest.withColumn("fits", fits & (F.col("memory_id") != F.col("top_id")))
    next_ = F.row_number().over(Window.partitionBy("query_id", "fits").orderBy(F.desc("final"), "memory_id"))
    slot = F.when(F.col("memory_id") == F.col("top_id"), 1).when(F.col("fits") & (next_ == 1), 2)
    reason = F.when(slot.isNull(), F.when(~F.col("gate"), "gate").when(~F.coalesce("fits", F.lit(False)), "second gate").otherwise("no slot"))
    return marked.select("query_id", "memory_id", "final", slot.alias("slot"), reason.alias("reason"))


def cold_hits(lexical: DataFrame, literal: DataFrame, starred: DataFrame, limit: int = 3) -> DataFrame:
    """Hits of three lanes ``(query_id, id, ...)`` merged by best score: starred
    2.0 and up, literal .92 and up, lexical .62 to .84 by rank and coverage."""
    lanes = (
        starred.select("query_id", "id", (2.0 + F.least(F.lit(0.5), 0.05 * F.col("terms"))).alias("score"), F.lit("starred").alias("lane"))
        .unionByName(literal.select("query_id", "id", F.least(F.lit(0.98), 0.92 + 0.02 * F.col("terms")).alias("score"), F.lit("literal").alias("lane")))
        .unionByName(lexical.select("query_id", "id", F.least(F.lit(0.84), 0.62 + 0.16 * (1 - (F.col("rank") - 1) / 80) + 0.04 * F.col("coverage")).alias("score"), F.lit("lexical").alias("lane")))
    )
    best = lanes.groupBy("query_id", "id").agg(F.round(F.max("score"), 6).alias("score"), F.array_join(F.array_sort(F.collect_set("lane")), "+").alias("lanes"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("id"))
    near = F.col("id") - F.lag("id").over(Window.partitionBy("query_id").orderBy("id"))
    spaced = best.withColumn("close", F.coalesce(near <= 2, F.lit(False)))
    return spaced.where("NOT close").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "id", "score", "lanes", "rank")


def repeat_penalised(results: DataFrame, shown: DataFrame, now: Column) -> DataFrame:
    """Results (lower score is better) with the penalty of records shown lately
    ``(memory_id, at, count)`` and of sticky ones."""
    minutes = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("at").cast("timestamp"))) / 60
    joined = results.join(shown, "memory_id", "left")
    penalty = F.when(F.col("at").isNotNull(), signals.step_penalty(minutes, F.col("count"))).otherwise(0.0) + F.when(F.col("sticky"), 0.12).otherwise(0.0)
    return joined.withColumn("score", F.round(F.col("score") + penalty, 6)).select(*results.columns)


def association(candidates: DataFrame, cooled: DataFrame, least: float = 0.35) -> DataFrame:
    """The best associated record of each question that is not cooling down."""
    open_ = candidates.join(cooled, "memory_id", "left_anti").where(F.col("score") >= least)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "memory_id")
    return open_.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def memory_block(rows: DataFrame, most: int = 4) -> DataFrame:
    """Slots of a prompt block: one record that is not automatic, automatic ones
    up to three in all, then others; by class and rank."""
    w = Window.partitionBy("query_id", "auto").orderBy("rank", "memory_id")
    k = F.row_number().over(w)
    lane = F.when(~F.col("auto") & (k == 1), 0).when(F.col("auto") & (k <= 2), 1).otherwise(2)
    order = Window.partitionBy("query_id").orderBy("lane", "rank", "memory_id")
    return rows.withColumn("lane", lane).withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= most).select("query_id", "memory_id", "slot")


def near_misses(dropped: DataFrame, low: float = 0.45, high: float = 0.68, most: int = 8) -> DataFrame:
    """What a gate dropped narrowly: no distance, or one just beyond it."""
    near = dropped.where(F.col("distance").isNull() | F.col("distance").between(low, high))
    order = Window.partitionBy("query_id").orderBy(F.asc_nulls_last("distance"), "memory_id")
    return near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).drop("k")
