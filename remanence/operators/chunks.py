"""Long texts in chunks: contract, hydration around a hit, search keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signals

#: Fixed values of the chunk contract.
ROLES = ("narrative", "insight", "meta", "quote")
RELATIONS = ("root", "extends", "insight", "echo", "contrast")
LABEL = 10


def policies(chunks: DataFrame) -> DataFrame:
    """Chunks with their effective index policy and label cut to its length;
    ``repaired`` says whether something was changed."""
    policy = signals.chunk_policy(F.col("chunk_role"), F.col("relationship"), F.col("adds_new_insight"))
    label = F.substring("index_label", 1, LABEL)
    changed = (label != F.col("index_label")) | ~policy.eqNullSafe(F.col("index_policy"))
    return chunks.withColumn("repaired", changed).withColumn("index_policy", policy).withColumn("index_label", label)


def violations(parents: DataFrame, chunks: DataFrame) -> DataFrame:
    """``parent_id, rule`` of every broken rule; a parent with any is refused
    whole. Chunks must be numbered from 1 without gaps, tile the text exactly,
    use known roles and relations, and echo only earlier chunks."""
    w = Window.partitionBy("parent_id").orderBy("chunk_no")
    placed = chunks.join(parents.select("parent_id", F.col("text").alias("whole")), "parent_id").withColumns({
        "expected": F.row_number().over(w), "offset": F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    rules = F.array_compact(F.array(
        F.when(F.col("chunk_no") != F.col("expected"), "numbering"),
        F.when(~F.substring(F.col("whole"), (F.col("offset") + 1).cast("int"), F.length("text")).eqNullSafe(F.col("text")), "tiling"),
        F.when(~F.col("chunk_role").isin(*ROLES), "role"), F.when(~F.col("relationship").isin(*RELATIONS), "relation"),
        F.when(F.length("index_label") > LABEL, "label"), F.when((F.col("relationship") == "echo") & (F.col("echo_of").isNull() | (F.col("echo_of") >= F.col("chunk_no"))), "echo"),
    ))
    each = placed.select("parent_id", F.explode(rules).alias("rule"))
    sizes = chunks.groupBy("parent_id").agg(F.sum(F.length("text")).alias("n"))
    short = parents.join(sizes, "parent_id", "left").where(F.coalesce("n", F.lit(0)) != F.length("text")).select("parent_id", F.lit("length").alias("rule"))
    return each.unionByName(short).distinct()


def hydrated(hits: DataFrame, chunks: DataFrame, budget: int = 1200) -> DataFrame:
    """``hit_id, text``: each hit ``(hit_id, parent_id, chunk_no)`` with the
    chunks that extend it, while they follow on and fit the budget."""
    asked = hits.select("hit_id", "parent_id", F.col("chunk_no").alias("first"))
    after = asked.join(chunks.select("parent_id", F.col("chunk_no").alias("no"), "relationship", "text"), "parent_id").where("no >= first")
    w = Window.partitionBy("hit_id").orderBy("no")
    breaks = F.sum(((F.col("no") != F.col("first")) & ~F.col("relationship").isin("extends", "insight")).cast("int")).over(w)
    kept = after.withColumn("breaks", breaks).withColumn("used", F.sum(F.length("text")).over(w)).where((F.col("breaks") == 0) & ((F.col("used") <= budget) | (F.col("no") == F.col("first"))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda s: s["text"]), "")
    return kept.groupBy("hit_id").agg(F.substring(body, 1, budget).alias("text"), F.count("*").alias("chunks"))


def current_parents(chunks: DataFrame, expected: DataFrame) -> DataFrame:
    """Parents whose chunks all carry the expected hash ``(parent_id, digest)``."""
    state = chunks.groupBy("parent_id").agg(F.count_distinct("source_hash").alias("kinds"), F.min("source_hash").alias("digest"))
    return state.where("kinds = 1").join(expected, ["parent_id", "digest"], "left_semi").select("parent_id")


def replaced(old: DataFrame, new: DataFrame, parent: str = "parent_id") -> DataFrame:
    """All rows of the parents in ``new`` replaced by ``new``."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def key_hits(distances: DataFrame) -> DataFrame:
    """The nearest key of each parent, with its span."""
    return distances.groupBy("query_id", "parent_id").agg(F.min(F.struct("distance", "key_id", "span")).alias("best")).select("query_id", "parent_id", "best.*")
