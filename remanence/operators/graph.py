"""Relations between records: neighbours, heat, decay, version chains, cycles,
link proposals and edge maintenance, as bounded joins over edge tables.

Iteration is bounded by depth, never by data on the driver. Every level ranks
its contenders in a total order, so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settled

#: Edge kinds that decay leaves alone.
STEADY = ("updates", "backfill")


def neighbors(edges: DataFrame, seeds: DataFrame, least: float = 0.5, limit: int = 5) -> DataFrame:
    """Strongest out-neighbours of each seed ``memory_id``."""
    out = edges.where(F.col("weight") >= least).join(seeds.select(F.col("memory_id").alias("source_id")), "source_id", "left_semi")
    order = Window.partitionBy("source_id").orderBy(F.desc("weight"), "target_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("source_id", "target_id", "weight", "rank")


def both_directions(edges: DataFrame, *extra: str) -> DataFrame:
    """Every edge seen from both ends: ``memory_id, other, direction, extra``."""
    out = edges.select(F.col("source_id").alias("memory_id"), F.col("target_id").alias("other"), F.lit("out").alias("direction"), *extra)
    return out.unionByName(edges.select(F.col("target_id").alias("memory_id"), F.col("source_id").alias("other"), F.lit("in").alias("direction"), *extra))


def degree(edges: DataFrame) -> DataFrame:
    """Distinct neighbours, either direction."""
    return both_directions(edges).groupBy("memory_id").agg(F.countDistinct("other").alias("degree"))


def reviewed_confidence(semantic: DataFrame) -> DataFrame:
    """Best confidence of the reviewed edges at each record."""
    good = semantic.where(F.col("review_state").isin("approved", "auto"))
    return both_directions(good, "confidence").groupBy("memory_id").agg(F.max("confidence").alias("confidence"))


def successors(semantic: DataFrame) -> DataFrame:
    """The newest reviewed update of each record: ``memory_id, next``."""
    good = semantic.where((F.col("role") == "updates") & F.col("review_state").isin("approved", "auto"))
    return good.groupBy(F.col("target_id").alias("memory_id")).agg(F.max(F.struct("created", "source_id")).alias("n")).select("memory_id", F.col("n.source_id").alias("next"))


def newest_versions(semantic: DataFrame, hops: int = 5) -> DataFrame:
    """``memory_id, newest``: the end of each update chain, at most ``hops``
    steps on; chains that return to where they began are left out."""
    step = successors(semantic)
    chain = step.select("memory_id", F.col("next").alias("newest"), F.array("memory_id", "next").alias("path"))
    for _ in range(hops - 1):
        chain = chain.join(step.select(F.col("memory_id").alias("newest"), "next"), "newest", "left").select(
            "memory_id", F.coalesce("next", "newest").alias("newest"),
            F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("path", F.array("next"))).alias("path"),
        )
    return chain.where(F.size(F.array_distinct("path")) == F.size("path")).select("memory_id", "newest")


def resolved_updates(semantic: DataFrame, hops: int = 5) -> DataFrame:
    """``memory_id, newest, resolved``: unresolved if the chain is longer than
    ``hops`` or returns to itself."""
    step = successors(semantic)
    ends = newest_versions(semantic, hops)
    more = ends.join(step.select(F.col("memory_id").alias("newest"), "next"), "newest", "left")
    every = step.select("memory_id").join(more, "memory_id", "left")
    done = F.col("newest").isNotNull() & F.col("next").isNull()
    return every.select("memory_id", F.when(done, F.col("newest")).alias("newest"), done.alias("resolved"))


def on_cycle(semantic: DataFrame) -> DataFrame:
    """Records that reach themselves along ``updates``, over cycles of any length."""
    from .structure import strong_components

    return strong_components(semantic.where("role = 'updates'")).where("cyclic").select("memory_id")


def typed_violations(semantic: DataFrame, memories: DataFrame) -> DataFrame:
    """Edges whose ends break the contract of their role, with the reason."""
    m = memories.select("memory_id", "level", "collection")
    s, t = m.select(*[F.col(c).alias(f"s_{c}") for c in m.columns]), m.select(*[F.col(c).alias(f"t_{c}") for c in m.columns])
    both = semantic.join(s, F.col("source_id") == F.col("s_memory_id"), "left").join(t, F.col("target_id") == F.col("t_memory_id"), "left")
    reason = (
        F.when(F.col("s_memory_id").isNull() | F.col("t_memory_id").isNull(), "missing end")
        .when(F.col("source_id") == F.col("target_id"), "self edge")
        .when((F.col("role") == "SUPPORTED_BY") & ((F.col("s_level") != "understanding") | (F.col("t_level") != "raw")), "needs understanding to raw")
        .when((F.col("role") == "SUPPORTED_BY") & (F.col("t_collection") == "library"), "library is no evidence")
        .when((F.col("role") == "EVOKES") & ((F.col("s_collection") == "library") | (F.col("t_collection") != "library")), "needs record to library")
        .when(~F.col("role").isin("updates", "derived_from", "SUPPORTED_BY", "EVOKES"), "unknown role")
    )
    return both.withColumn("reason", reason).where("reason IS NOT NULL").select("source_id", "target_id", "role", "reason")


def heat_spread(memories: DataFrame, edges: DataFrame, roots: DataFrame, boost: float, spread: float = 0.5, depth: int = 3, fan: int = 8, nodes: int = 64, fires: int = 128, most: float = 8.0) -> DataFrame:
    """Heat from ordered ``roots (memory_id, place)``: ``memory_id, amount,
    activation, depth`` of every record reached.

    A node passes amount x spread x min(weight / 1.5, 1) x conductance along its
    ``fan`` strongest edges; the first visit in queue order wins, and the
    budgets of nodes and fired edges cut the queue.
    """
    known = memories.select("memory_id", "activation")
    strength = F.col("weight") * F.col("conductance")
    best = Window.partitionBy("source_id").orderBy(F.desc(F.round(strength, 9)), "target_id")
    open_ = edges.where("weight > 0 AND conductance > 0")
    first = roots.dropDuplicates(["memory_id"]).join(known.select("memory_id"), "memory_id", "left_semi")
    frontier = first.select("memory_id", F.lit(float(boost)).alias("amount"), F.row_number().over(Window.orderBy("place", "memory_id")).alias("place"), F.lit(0).alias("depth")).where(F.col("place") <= 32)
    frontier = seen = settled(frontier)
    for level in range(1, depth + 1):
        # Only edges of the frontier, a few dozen records, are ranked.
        out = open_.join(F.broadcast(frontier.select(F.col("memory_id").alias("source_id"))), "source_id", "left_semi").withColumn("line", F.row_number().over(best)).where(F.col("line") <= fan)
        reached = (
            frontier.join(out.select("source_id", "target_id", "weight", "conductance", "line"), F.col("memory_id") == F.col("source_id"))
            .select(F.col("target_id").alias("memory_id"), (F.col("amount") * spread * F.least(F.col("weight") / 1.5, F.lit(1.0)) * F.col("conductance")).alias("amount"), "place", "line")
            .join(seen.select("memory_id"), "memory_id", "left_anti").join(known.select("memory_id"), "memory_id", "left_semi")
        )
        one = Window.partitionBy("memory_id").orderBy("place", "line")
        # At most nodes x fan rows reach this ordering: the budgets bound it.
        queue = Window.orderBy("place", "line", "memory_id")
        used = seen.agg(F.count("*").alias("used"))
        frontier = (
            reached.withColumn("k", F.row_number().over(one)).where("k = 1").crossJoin(used)
            .withColumn("new", F.row_number().over(queue) + F.col("used")).where((F.col("new") <= nodes) & (F.col("new") - F.col("used") <= fires))
            .select("memory_id", "amount", F.col("new").alias("place"), F.lit(level).alias("depth"))
        )
        frontier = settled(frontier)
        seen = seen.unionByName(frontier)
    return seen.join(known, "memory_id").select("memory_id", "depth", F.round("amount", 9).alias("amount"), F.round(F.least(F.lit(most), F.col("activation") + F.col("amount")), 9).alias("activation"))


def decayed_activation(memories: DataFrame, edges: DataFrame, factor: float = 0.82, quantile: float = 0.9) -> DataFrame:
    """Activation after one decay; hubs and emotional records keep a little
    more, at most 0.90 of it; at or below 0.02 it is gone.

    The hub reference is the nearest-rank quantile of out-strength.
    """
    strength = edges.groupBy("source_id").agg(F.sum(F.col("weight") * F.col("conductance")).alias("strength"))
    hub = ranked_value(strength.withColumn("strength", F.round("strength", 9)), "strength", int(quantile * (strength.count() - 1) + 0.5))
    emotion = F.when(F.coalesce("emotion", F.lit(0.0)) == 0, 0.5).otherwise(F.col("emotion"))
    keep = F.least(F.lit(0.90), factor + 0.05 * F.least(F.lit(1.0), F.coalesce("strength", F.lit(0.0)) / F.lit(hub)) + 0.03 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (emotion - 0.5) * 2)))
    after = F.col("activation") * keep
    return memories.select("memory_id", "activation", "emotion").join(strength, F.col("memory_id") == F.col("source_id"), "left").select(
        "memory_id", F.round(F.when(after <= 0.02, 0.0).otherwise(after), 6).alias("activation")
    )


def decayed_edges(edges: DataFrame, least: float = 0.1, factor: float = 0.9) -> DataFrame:
    """Weights after decay, without those below ``least``, but for each
    source's best edge."""
    after = edges.withColumn("weight", F.when(F.col("provenance").isin(*STEADY), F.col("weight")).otherwise(F.round(F.col("weight") * factor, 9)))
    best = Window.partitionBy("source_id").orderBy(F.desc("weight"), F.desc("last_fired"), F.asc("target_id"))
    return after.withColumn("rn", F.row_number().over(best)).where((F.col("rn") == 1) | (F.col("weight") >= least)).drop("rn")


def decayed_strong_edges(edges: DataFrame, least: float = 1.5, factor: float = 0.95) -> DataFrame:
    strong = (F.col("weight") >= least) & ~F.col("provenance").isin(*STEADY)
    return edges.withColumn("weight", F.when(strong, F.round(F.col("weight") * factor, 9)).otherwise(F.col("weight")))


def merged_flow(old: DataFrame, new: DataFrame, mode: str) -> DataFrame:
    """Flow edges after writing ``new`` over ``old``.

    manual: weights add up to at most 10, conductance is replaced, provenance
    becomes manual. auto: the larger weight and conductance stay; the time
    changes only for a strictly larger weight; manual provenance is kept.
    """
    new = new.where("source_id <> target_id").groupBy("source_id", "target_id").agg(
        F.max("weight").alias("weight"), F.max("conductance").alias("conductance"), F.max("last_fired").alias("last_fired"), F.max("provenance").alias("provenance")
    )
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, (F.col("o.source_id") == F.col("n.source_id")) & (F.col("o.target_id") == F.col("n.target_id")), "full")
    had, has = F.col("o.weight").isNotNull(), F.col("n.weight").isNotNull()
    pick = lambda both_: lambda c: F.when(had & has, both_(c)).otherwise(F.coalesce(f"n.{c}", f"o.{c}")).alias(c)
    if mode == "manual":
        weight = pick(lambda c: F.least(F.lit(10.0), F.round(F.col(f"o.{c}") + F.col(f"n.{c}"), 9)))("weight")
        rest = [F.coalesce("n.conductance", "o.conductance").alias("conductance"), F.coalesce("n.last_fired", "o.last_fired").alias("last_fired"),
                F.when(has, "manual").otherwise(F.col("o.provenance")).alias("provenance")]
    else:
        weight = pick(lambda c: F.greatest(f"o.{c}", f"n.{c}"))("weight")
        rest = [pick(lambda c: F.greatest(f"o.{c}", f"n.{c}"))("conductance"),
                pick(lambda c: F.when(F.col("n.weight") > F.col("o.weight"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")))("last_fired"),
                pick(lambda c: F.when(F.col(f"o.{c}") == "manual", "manual").otherwise(F.col(f"n.{c}")))("provenance")]
    return both.select(F.coalesce("o.source_id", "n.source_id").alias("source_id"), F.coalesce("o.target_id", "n.target_id").alias("target_id"), weight, *rest)


def machine_pairs(edges: DataFrame, now: Column, weak: float = 0.08, stale: float = 0.5, days: int = 14) -> DataFrame:
    """Undirected pairs of machine-made edges that maintenance may remove:
    weak, or weak enough and long unused, with no other edge on the pair."""
    machine = F.col("provenance").startswith("auto_") | F.col("provenance").isin("cluster", "knn_legacy")
    pair = edges.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b"), "weight", "last_fired", machine.alias("machine"))
    grouped = pair.groupBy("a", "b").agg(F.max("weight").alias("weight"), F.max("last_fired").alias("fired"), F.bool_and("machine").alias("machine"))
    old = F.col("fired") < now - F.make_dt_interval(F.lit(days))
    kind = F.when(F.col("weight") < weak, "weak").when((F.col("weight") < stale) & old, "stale")
    return grouped.where("machine").withColumn("kind", kind).where("kind IS NOT NULL").select("a", "b", "weight", "fired", "kind")


def hot_neighbors(memories: DataFrame, edges: DataFrame, seeds: DataFrame, least: float = 2.0, limit: int = 5, seed: int = 1) -> DataFrame:
    """Active records next to the seeds, each once, by activation, weight and a
    seeded draw; with the seed that bridges to it."""
    reach = edges.join(seeds.select(F.col("memory_id").alias("source_id")), "source_id", "left_semi").join(seeds.select(F.col("memory_id").alias("target_id")), "target_id", "left_anti")
    hot = reach.join(memories.where(F.col("activation") >= least).select(F.col("memory_id").alias("target_id"), "activation"), "target_id")
    one = Window.partitionBy("target_id").orderBy(F.desc("weight"), "source_id")
    return hot.withColumn("k", F.row_number().over(one)).where("k = 1").orderBy(F.desc("activation"), F.desc("weight"), F.md5(F.concat_ws("|", "target_id", F.lit(str(seed)))), "target_id").limit(limit).select("target_id", F.col("source_id").alias("bridge"), "activation", "weight")


def equalised_emotion(memories: DataFrame, edges: DataFrame, nudge: float = 0.05, threshold: float = 0.2, least: float = 0.5) -> DataFrame:
    """Emotion moved a step towards the neighbours' mean where they differ by
    more than ``threshold``; all records at once."""
    emotion = memories.select("memory_id", F.when(F.coalesce("emotion", F.lit(0.0)) == 0, 0.5).otherwise(F.col("emotion")).alias("emotion"))
    near = both_directions(edges.where(F.col("weight") >= least)).select("memory_id", "other").distinct()
    mean = near.join(emotion.withColumnRenamed("memory_id", "other"), "other").groupBy("memory_id").agg(F.avg("emotion").alias("mean"))
    gap = F.col("mean") - F.col("emotion")
    moved = F.when(F.round(F.abs(gap), 9) > threshold, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("emotion") + F.signum(gap) * nudge))).otherwise(F.col("emotion"))
    return emotion.join(mean, "memory_id", "left").select("memory_id", F.round(F.coalesce(moved, "emotion"), 6).alias("emotion"))


def components_of(edges: DataFrame) -> DataFrame:
    """``memory_id, label`` of every record on an edge: the least id it reaches.

    A round takes the least label among neighbours and then the label's own
    label, so a chain shortens by half; rounds go on until nothing moves.
    """
    both = settled(both_directions(edges).select("memory_id", "other").distinct())
    labels = settled(both.groupBy("memory_id").agg(F.least("memory_id", F.min("other")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("memory_id").alias("other"), F.col("label").alias("theirs")), "other").groupBy("memory_id").agg(F.min("theirs").alias("theirs"))
        lower = settled(labels.join(near, "memory_id").select("memory_id", F.least("label", "theirs").alias("label"), F.col("label").alias("old")))
        jump = lower.select(F.col("memory_id").alias("label"), F.col("label").alias("further"))
        after = settled(lower.join(jump, "label", "left").select("memory_id", F.coalesce("further", "label").alias("label"), "old"))
        labels = after.select("memory_id", "label")
        if after.where("label <> old").limit(1).count() == 0:
            return labels


def ranked_value(rows: DataFrame, column: str, place: int, buckets: int = 8192) -> float | None:
    """The value at ``place`` (from 0) in ascending order, without ordering all
    rows: buckets of the value range are counted first, and only the one that
    holds the place is ordered."""
    seen = rows.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    if seen["low"] is None:
        return None
    width = (seen["high"] - seen["low"]) / buckets
    bucket = F.floor((F.col(column) - seen["low"]) / width) if width > 0 else F.lit(0)
    counts = sorted((r["b"], r["n"]) for r in rows.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect())
    for b, n in counts:
        if place < n:
            return rows.where(bucket == b).select(column).orderBy(column).offset(place).limit(1).first()[0]
        place -= n
    return None


def link_proposals(pairs: DataFrame, memories: DataFrame, edges: DataFrame, least: float = 0.82, degree_cap: int = 12, per_source: int = 2) -> DataFrame:
    """New flow links between alike records ``(a, b, similarity)``: enough
    similarity, levels that may flow, no library, no existing edge, degrees
    below the cap, at most ``per_source`` a source."""
    m = memories.select("memory_id", "level", "collection")
    s, t = m.toDF("a", "s_level", "s_collection"), m.toDF("b", "t_level", "t_collection")
    may = ((F.col("s_level") == F.col("t_level")) & (F.col("s_level") != "cognition")) | ((F.col("s_level") == "cognition") & F.col("t_level").isin("raw", "understanding"))
    known = edges.select(F.least("source_id", "target_id").alias("x"), F.greatest("source_id", "target_id").alias("y")).distinct()
    deg = degree(edges)
    open_ = (
        pairs.where(F.col("similarity") >= least).join(s, "a").join(t, "b").where(may & (F.col("s_collection") != "library") & (F.col("t_collection") != "library"))
        .withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b")).join(known, ["x", "y"], "left_anti")
        .join(deg.toDF("a", "da"), "a", "left").join(deg.toDF("b", "db"), "b", "left")
        .where((F.coalesce("da", F.lit(0)) < degree_cap) & (F.coalesce("db", F.lit(0)) < degree_cap))
    )
    order = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
    weight = F.round(0.12 + F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("similarity") - 0.82) / 0.18)) * 0.12, 6)
    return open_.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_source).select("a", "b", "similarity", weight.alias("weight"), F.lit(0.25).alias("conductance"))
