"""Row lifecycle on immutable snapshots: merges, deletes, change feeds, queues.

Each function takes the present snapshot and a batch of changes and returns the
next snapshot; writing it is the caller's choice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLES = {"supports": "SUPPORTED_BY", "supported_by": "SUPPORTED_BY", "evokes": "EVOKES", "updates": "updates", "update": "updates", "derived_from": "derived_from"}


def upserted(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with ``new`` merged by key: new values win, but for the ``keep``
    columns, where an old non-null value stays. One new row a key is expected."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    fresh = F.col(f"n.{key}").isNotNull()
    columns = []
    for c in old.columns:
        if c not in new.columns:
            columns.append(F.col(f"o.{c}").alias(c))
        elif c == key or c in keep:
            columns.append(F.coalesce(f"o.{c}", f"n.{c}").alias(c))
        else:
            columns.append(F.when(fresh, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    return joined.select(*columns)


def added_if_absent(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys)), allowMissingColumns=True)


def soft_deleted(memories: DataFrame, children: dict[str, tuple[DataFrame, tuple[str, ...]]], ids: DataFrame, now: Column, by: str) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Remaining records, their trash rows, and the child tables without rows
    that name a deleted record in any of their columns."""
    gone = ids.select("memory_id").distinct()
    trash = memories.join(gone, "memory_id", "left_semi").withColumns({"deleted_at": now, "deleted_by": F.lit(by)})
    kept = memories.join(gone, "memory_id", "left_anti")
    left = {}
    for name, (table, columns) in children.items():
        for c in columns:
            table = table.join(gone.withColumnRenamed("memory_id", c), c, "left_anti")
        left[name] = table
    return kept, trash, left


def restored(memories: DataFrame, trash: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    back = trash.join(ids, "memory_id", "left_semi").join(memories.select("memory_id"), "memory_id", "left_anti")
    return memories.unionByName(back.select(*[c for c in memories.columns if c in back.columns]), allowMissingColumns=True), trash.join(back.select("memory_id"), "memory_id", "left_anti")


def purged(rows: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    return rows.where(F.col(at) >= now - F.make_dt_interval(F.lit(days)))


def updated(rows: DataFrame, changes: DataFrame, key: str, column: str, value: Column | None = None) -> DataFrame:
    """``column`` set from ``changes (key, value)`` where there is one."""
    c = changes.select(F.col(key), (value if value is not None else F.col("value")).alias("__value"), F.lit(True).alias("__set"))
    joined = rows.join(c, key, "left")
    return joined.withColumn(column, F.when(F.col("__set"), F.col("__value")).otherwise(F.col(column))).select(*rows.columns)


def cited(memories: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """Usage counts raised by each record's hits, last use stamped."""
    n = hits.groupBy("memory_id").agg(F.count("*").alias("__n"))
    out = memories.join(n, "memory_id", "left").withColumn("usage_count", F.col("usage_count") + F.coalesce("__n", F.lit(0)))
    if "last_used" in memories.columns:
        out = out.withColumn("last_used", F.when(F.col("__n").isNotNull(), now).otherwise(F.col("last_used")))
    return out.select(*memories.columns)


def cooled(memories: DataFrame, ids: DataFrame, amount: float = 2.0) -> DataFrame:
    mark = ids.select("memory_id", F.lit(True).alias("__cool")).distinct()
    after = F.greatest(F.lit(0.0), F.least(F.lit(20.0), F.col("activation") - amount))
    return memories.join(mark, "memory_id", "left").withColumn("activation", F.when(F.col("__cool"), after).otherwise(F.col("activation"))).select(*memories.columns)


def folded_changes(state: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """A change feed ``(key, op, revision, columns)`` applied: the latest
    revision of each key decides, 'delete' removes, others replace."""
    order = Window.partitionBy(key).orderBy(F.desc("revision"))
    last = changes.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k", "revision")
    rest = state.join(last.select(key), key, "left_anti")
    return rest.unionByName(last.where("op <> 'delete'").drop("op"))


def outbox(events: DataFrame, key: str, op: str, at: str) -> DataFrame:
    """The last operation of each key and how many there were (its revision)."""
    return events.groupBy(key).agg(F.max_by(op, at).alias("op"), F.count("*").alias("revision"))


def drained(pending: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """What stays pending after a drain: keys whose revision has moved on."""
    return pending.join(taken.select(key, "revision"), [key, "revision"], "left_anti")


def pending_vectors(memories: DataFrame, vectors: DataFrame) -> DataFrame:
    return memories.join(vectors.select("memory_id"), "memory_id", "left_anti")


def bias_once(memories: DataFrame, updates: DataFrame, applied: DataFrame, step: float = 0.05) -> DataFrame:
    """New versions gain and old ones lose a little activation, once a pair."""
    fresh = updates.select("source_id", "target_id").distinct().join(applied, ["source_id", "target_id"], "left_anti")
    moves = fresh.select(F.col("source_id").alias("memory_id"), F.lit(step).alias("__by")).unionByName(fresh.select(F.col("target_id").alias("memory_id"), F.lit(-step).alias("__by")))
    total = moves.groupBy("memory_id").agg(F.sum("__by").alias("__by"))
    after = F.greatest(F.lit(0.0), F.least(F.lit(8.0), F.col("activation") + F.coalesce("__by", F.lit(0.0))))
    return memories.join(total, "memory_id", "left").withColumn("activation", F.round(after, 9)).select(*memories.columns)


def states_synced(memories: DataFrame, semantic: DataFrame) -> DataFrame:
    """Targets of updates that are tagged current become past."""
    old = semantic.where("role = 'updates'").select(F.col("target_id").alias("memory_id")).distinct().withColumn("__old", F.lit(True))
    past = F.transform("tags", lambda t: F.when(t == "state:current", "state:past").otherwise(t))
    return memories.join(old, "memory_id", "left").withColumn("tags", F.when(F.col("__old"), past).otherwise(F.col("tags"))).select(*memories.columns)


def transitioned(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Proposals after decisions ``(id, decision)``: only pending ones move."""
    to = F.when(F.col("__d") == "approve", "approved").when(F.col("__d") == "reject", "rejected")
    joined = proposals.join(decisions.select("id", F.col("decision").alias("__d")), "id", "left")
    return joined.withColumn("status", F.when((F.col("status") == "pending") & to.isNotNull(), to).otherwise(F.col("status"))).select(*proposals.columns)


def document_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key, change``: rows to delete, insert or update to turn old into new."""
    digest = lambda: F.xxhash64(*columns)
    o, n = old.select(key, digest().alias("o")), new.select(key, digest().alias("n"))
    change = F.when(F.col("n").isNull(), "delete").when(F.col("o").isNull(), "insert").when(F.col("o") != F.col("n"), "update")
    return o.join(n, key, "full").withColumn("change", change).where("change IS NOT NULL").select(key, "change")


def canonical_role(role: Column) -> Column:
    """The stored name of an edge role; null if it is unknown."""
    table = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.try_element_at(table, F.lower(F.trim(role)))


def consolidated_pairs(hits: DataFrame, weight: float = 0.15, most: int = 30) -> DataFrame:
    """Links among the ``most`` records that a conversation touches most
    ``(memory_id, score)``: every pair, each with ``weight``."""
    best = hits.groupBy("memory_id").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "memory_id").limit(most)
    a, b = best.select(F.col("memory_id").alias("source_id")), best.select(F.col("memory_id").alias("target_id"))
    return a.join(b, F.col("source_id") < F.col("target_id")).withColumn("weight", F.lit(weight))


def classified_legacy(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges of one old table split into flow and semantic ones, and those that
    neither family takes (which must be none)."""
    role = canonical_role("edge_type")
    flow = edges.where(F.col("edge_type").isin("lateral", "temporal"))
    semantic = edges.withColumn("role", role).where(F.col("role").isNotNull())
    rest = edges.where(~F.col("edge_type").isin("lateral", "temporal") & role.isNull())
    return flow, semantic, rest


def failures_recorded(old: DataFrame, new: DataFrame) -> DataFrame:
    """Failure rows by parent with attempts added up and the last error kept."""
    both = old.select("parent_id", "attempts", "error", "failed_at").unionByName(new.select("parent_id", "attempts", "error", "failed_at"))
    return both.groupBy("parent_id").agg(F.sum("attempts").alias("attempts"), F.max_by("error", "failed_at").alias("error"), F.max("failed_at").alias("failed_at"))


def untagged(memories: DataFrame, limit: int = 200) -> DataFrame:
    return memories.where(F.size("tags") == 0).orderBy(F.desc("ts"), "memory_id").limit(limit)


def tags_valid(tags: Column, vocabulary: Column) -> Column:
    """3 to 5 known tags that cover the axes state, domain and kind."""
    axes = F.array_distinct(F.transform(tags, lambda t: F.substring_index(t, ":", 1)))
    needed = F.array(F.lit("state"), F.lit("domain"), F.lit("kind"))
    return F.size(tags).between(3, 5) & (F.size(F.array_except(tags, vocabulary)) == 0) & (F.size(F.array_except(needed, axes)) == 0)


def run_marked(runs: DataFrame, run_id: str, status: str, count: int, now: Column) -> DataFrame:
    row = runs.sparkSession.range(1).select(F.lit(run_id).alias("run_id"), F.lit(status).alias("status"), F.lit(count).alias("count"), now.alias("at"))
    return upserted(runs, row, "run_id")


def tiers_repaired(memories: DataFrame) -> DataFrame:
    return memories.withColumn("tier", F.when(F.col("tier").isin("core", "long", "short"), F.col("tier")).otherwise("long"))
