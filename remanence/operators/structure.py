"""Cycles and long chains of a directed graph, whatever their length.

Strongly connected components are found in rounds of joins. A round rakes off
records that nothing reaches or that reach nothing, and contracts records with
one edge in and one out, an independent set of them at a time: chains, rings and
trees vanish in a number of rounds that grows with the logarithm of their
length. What is left is dense; there the least record that reaches each one is
spread forwards, and back within its colour. Chains of a successor relation are
followed by pointer doubling. The driver holds counts alone: every join goes
through exchange, as a broadcast a round would pass each round's tables through it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import proposal_id
from ..session import settled, workspace

Settle = Callable[[DataFrame], DataFrame]


def _apart(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is never broadcast."""
    return df.hint("merge")


def strong_components(edges: DataFrame) -> DataFrame:
    """``memory_id, component, cyclic`` of every record on an edge: the least
    record of its strongly connected component, and whether it lies on a cycle
    (self edges included). Edges with a null end are left out; repeated ones
    count once."""
    with workspace(edges.sparkSession) as settle:
        every = settle(edges.select("source_id", "target_id").where("source_id IS NOT NULL AND target_id IS NOT NULL").distinct())
        left = settle(every.where("source_id <> target_id"))
        contracted: list[DataFrame] = []
        known = settle(every.select(F.col("source_id").alias("memory_id"), F.col("source_id").alias("component")).limit(0))
        while left.limit(1).count():
            left = _reduced(left, settle, contracted)
            if left.limit(1).count():
                found = _core(left, settle)
                known = settle(known.union(found))
                inside = _apart(found.select("memory_id"))
                left = settle(left.join(inside, left["source_id"] == inside["memory_id"], "left_anti").join(inside, left["target_id"] == inside["memory_id"], "left_anti"))
        for chosen in reversed(contracted):
            before, after = _apart(known.toDF("before", "cb")), _apart(known.toDF("after", "ca"))
            both = chosen.join(before, "before", "left").join(after, "after", "left")
            one, two = F.coalesce("cb", "before"), F.coalesce("ca", "after")
            known = settle(known.union(both.where(one == two).select("memory_id", one)).union(both.where(one == two).select("before", one)).distinct())
        least = known.groupBy("component").agg(F.min("memory_id").alias("least"), F.count("*").alias("n")).where("n > 1")
        ends = every.select(F.col("source_id").alias("memory_id")).union(every.select("target_id")).distinct()
        loops = every.where("source_id = target_id").select(F.col("source_id").alias("memory_id"), F.lit(True).alias("loop"))
        placed = ends.join(_apart(known.join(_apart(least), "component").select("memory_id", "least")), "memory_id", "left").join(_apart(loops), "memory_id", "left")
        return settled(placed.select("memory_id", F.coalesce("least", "memory_id").alias("component"), (F.col("least").isNotNull() | F.col("loop").isNotNull()).alias("cyclic")))


def _reduced(left: DataFrame, settle: Settle, contracted: list[DataFrame]) -> DataFrame:
    """Rakes and contracts until neither finds a record; what was contracted is
    appended as ``memory_id, before, after``."""
    size = left.count()
    while size:
        heads, tails = left.select(F.col("target_id").alias("source_id")).distinct(), left.select(F.col("source_id").alias("target_id")).distinct()
        raked = settle(left.join(_apart(heads), "source_id", "left_semi").join(_apart(tails), "target_id", "left_semi").select("source_id", "target_id"))
        one_in = raked.groupBy(F.col("target_id").alias("memory_id")).agg(F.count("*").alias("i"), F.min("source_id").alias("before")).where("i = 1")
        one_out = raked.groupBy(F.col("source_id").alias("memory_id")).agg(F.count("*").alias("o"), F.min("target_id").alias("after")).where("o = 1")
        thin = settle(one_in.join(_apart(one_out), "memory_id").select("memory_id", "before", "after", F.struct(F.xxhash64("memory_id", F.lit(len(contracted))), "memory_id").alias("turn")))
        turns = thin.select("memory_id", "turn")
        around = thin.join(_apart(turns.toDF("before", "tb")), "before", "left").join(_apart(turns.toDF("after", "ta")), "after", "left")
        first = (F.col("tb").isNull() | (F.col("turn") < F.col("tb"))) & (F.col("ta").isNull() | (F.col("turn") < F.col("ta")))
        chosen = settle(around.where(first).select("memory_id", "before", "after"))
        gone = _apart(chosen.select("memory_id"))
        rest = raked.join(gone, raked["source_id"] == gone["memory_id"], "left_anti").join(gone, raked["target_id"] == gone["memory_id"], "left_anti")
        left = settle(rest.union(chosen.where("before <> after").select("before", "after")).distinct())
        now = left.count()
        contracted.append(chosen)
        if now == size:
            return left
        size = now
    return left


def _least_reaching(edges: DataFrame, settle: Settle) -> DataFrame:
    """``memory_id, label``: the least record from which edges lead to each one.
    A label's own label is as good, so paths shorten by half a round."""
    labels = settle(edges.select(F.col("source_id").alias("memory_id")).union(edges.select("target_id")).distinct().withColumn("label", F.col("memory_id")))
    while True:
        near = edges.join(_apart(labels.toDF("source_id", "theirs")), "source_id").groupBy(F.col("target_id").alias("memory_id")).agg(F.min("theirs").alias("theirs"))
        lower = settle(labels.join(_apart(near), "memory_id", "left").select("memory_id", F.least("label", "theirs").alias("label"), F.col("label").alias("old")))
        jump = lower.select(F.col("memory_id").alias("label"), F.col("label").alias("further"))
        after = settle(lower.join(_apart(jump), "label", "left").select("memory_id", F.least("further", "label").alias("label"), "old"))
        labels = after.select("memory_id", "label")
        if after.where("label <> old").limit(1).count() == 0:
            return labels


def _core(edges: DataFrame, settle: Settle) -> DataFrame:
    """Some whole components: of every colour, the records that reach back to
    the one that gave it."""
    colours = _least_reaching(edges, settle)
    one, two = colours.toDF("source_id", "cs"), colours.toDF("target_id", "ct")
    within = settle(edges.join(_apart(one), "source_id").join(_apart(two), "target_id").where("cs = ct").select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")))
    back = _least_reaching(within, settle).withColumnRenamed("label", "back")
    return settle(colours.join(_apart(back), "memory_id", "left").where("label = coalesce(back, memory_id)").select("memory_id", F.col("label").alias("component")))


def chain_ends(steps: DataFrame) -> DataFrame:
    """``memory_id, last, hops`` of every record with a step: where the steps
    ``(memory_id, next)``, one a record and without a cycle, lead in the end.
    Every round doubles the steps that are known."""
    with workspace(steps.sparkSession) as settle:
        ahead = settle(steps.select("memory_id", F.col("next").alias("at"), F.lit(1).cast("long").alias("hops")))
        done = settle(ahead.limit(0))
        while ahead.limit(1).count():
            further = ahead.select(F.col("memory_id").alias("at"), F.col("at").alias("on"), F.col("hops").alias("more"))
            both = ahead.join(_apart(further), "at", "left")
            # Records that have arrived leave the rounds; their own pointers stay with those behind them.
            arrived = done.select(F.col("memory_id").alias("at"), F.col("at").alias("end"), F.col("hops").alias("rest"))
            moved = settle(both.join(_apart(arrived), "at", "left").select(
                "memory_id", F.coalesce("end", "on", "at").alias("at"), (F.col("hops") + F.coalesce("rest", "more", F.lit(0))).alias("hops"), (F.col("end").isNotNull() | F.col("on").isNull()).alias("there"),
            ))
            done = settle(done.union(moved.where("there").select("memory_id", "at", "hops")))
            ahead = settle(moved.where("NOT there").select("memory_id", "at", "hops"))
        return settled(done.select("memory_id", F.col("at").alias("last"), "hops"))


def newest_successors(updates: DataFrame, memories: DataFrame) -> DataFrame:
    """``memory_id, next``: of the records that update one, the newest; of equally
    new ones the smaller id."""
    times = memories.select(F.col("memory_id").alias("source_id"), F.col("ts").alias("at"))
    order = Window.partitionBy("target_id").orderBy(F.desc_nulls_last("at"), "source_id")
    ranked = updates.select("source_id", "target_id").distinct().join(_apart(times), "source_id", "left").withColumn("k", F.row_number().over(order))
    return ranked.where("k = 1").select(F.col("target_id").alias("memory_id"), F.col("source_id").alias("next"))


def structure_proposals(updates: DataFrame, memories: DataFrame, most: int = 5) -> DataFrame:
    """Repairs of the ``updates (source_id, target_id, created)``, each for review:
    ``proposal_id, kind, source_id, target_id, size, component``.

    ``structure_cycle``: of every component with a cycle, its newest inner edge
    should go; ``size`` counts its records, ``component`` is the least of them.
    ``structure_overlong``: from a record on no cycle, the newest updates lead
    ``size`` hops on, more than ``most``, before a record would be seen again;
    an edge from the last to it is proposed unless there is one.
    """
    with workspace(updates.sparkSession) as settle:
        # Against the edges: from the old record to the one that updates it.
        members = strong_components(updates.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")))
        on_cycle = settle(members.where("cyclic"))
        sizes = on_cycle.groupBy("component").agg(F.count("*").alias("size"))
        inner = updates.join(_apart(on_cycle.select(F.col("memory_id").alias("source_id"), "component")), "source_id").join(
            _apart(on_cycle.select(F.col("memory_id").alias("target_id"), F.col("component").alias("other"))), "target_id").where("component = other")
        newest = inner.groupBy("component").agg(F.max(F.struct(F.coalesce(F.col("created").cast("string"), F.lit("")).alias("at"), "source_id", "target_id")).alias("e"))
        kind = F.lit("structure_cycle")
        cycles = newest.join(_apart(sizes), "component").select(
            proposal_id(kind, F.col("e.source_id"), F.col("e.target_id")).alias("proposal_id"), kind.alias("kind"), F.col("e.source_id").alias("source_id"), F.col("e.target_id").alias("target_id"), "size", "component",
        )
        steps = settle(newest_successors(updates, memories))
        # Rings of the newest steps alone: a chain that runs into one goes round it once.
        ring = strong_components(steps.select(F.col("memory_id").alias("source_id"), F.col("next").alias("target_id"))).where("cyclic").select("memory_id", "component")
        ring = settle(ring)
        length = ring.groupBy("component").agg(F.count("*").alias("round"))
        closing = steps.join(_apart(ring), "memory_id").join(_apart(length), "component").select(F.col("next").alias("last"), F.col("memory_id").alias("before"), "round")
        ends = chain_ends(steps.join(_apart(ring.select("memory_id")), "memory_id", "left_anti")).join(_apart(closing), "last", "left")
        whole = ends.select("memory_id", F.coalesce("before", "last").alias("latest"), (F.col("hops") + F.coalesce(F.col("round") - 1, F.lit(0))).alias("size"))
        kind = F.lit("structure_overlong")
        there = updates.select(F.col("source_id").alias("latest"), F.col("target_id").alias("memory_id")).distinct()
        overlong = whole.where(F.col("size") > most).join(_apart(on_cycle.select("memory_id")), "memory_id", "left_anti").join(_apart(there), ["latest", "memory_id"], "left_anti").select(
            proposal_id(kind, F.col("latest"), F.col("memory_id")).alias("proposal_id"), kind.alias("kind"), F.col("latest").alias("source_id"), F.col("memory_id").alias("target_id"), "size", F.lit(None).cast("string").alias("component"),
        )
        return settled(cycles.unionByName(overlong))
