"""Mixing overlapping sources to target weights (operator 2) by min-cost flow.

Documents are aggregated by membership pattern, the set of sources that they
belong to. A flow network sends each pattern's words to the quotas of its
sources; using a pattern's words a second or third time costs more each time
(convex), so repetition is spread before it is stacked. The flow fixes how many
words each pattern gives to each source; documents are then taken in a seeded
order until those words are reached.

Scale: the driver sees one row per pattern, never per document. The seeded
order needs no global sort: sizes are summed by the leading bits of the draw,
and only the narrow range per pattern in which a quota ends is ordered document
by document. Texts are counted where they lie and never shuffled.

Defined results: a null or empty text has size 0 and takes 0; a null source is
a source of its own and comes last; repeated rows are documents of their own;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, removed, written

def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def target_shares(sizes: Sequence[int], weights: Sequence[float], share: float, most: float) -> list[float]:
    """``share`` of all sizes, dealt by weight; no target above ``most`` times
    its size, the excess dealt again to the others by weight."""
    left, open_ = share * sum(sizes), set(range(len(sizes)))
    targets = [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * unit > most * sizes[i]}
        if not full:
            for i in open_:
                targets[i] = weights[i] * unit
            break
        for i in full:
            targets[i] = most * sizes[i]
        left -= sum(targets[i] for i in full)
        open_ -= full
    return targets


@dataclass
class _Arc:
    head: int
    room: int
    cost: int
    back: int


class FlowNetwork:
    """Successive shortest augmenting paths on a small integer network."""

    def __init__(self, nodes: int):
        self.arcs: list[list[_Arc]] = [[] for _ in range(nodes)]

    def arc(self, tail: int, head: int, room: int, cost: int) -> _Arc:
        forward = _Arc(head, room, cost, len(self.arcs[head]))
        self.arcs[tail].append(forward)
        self.arcs[head].append(_Arc(tail, 0, -cost, len(self.arcs[tail]) - 1))
        return forward

    def _shortest(self, start: int) -> tuple[list[float], list[tuple[int, int] | None]]:
        far: list[float] = [float("inf")] * len(self.arcs)
        via: list[tuple[int, int] | None] = [None] * len(self.arcs)
        far[start], queue, queued = 0, deque([start]), {start}
        while queue:
            node = queue.popleft()
            queued.discard(node)
            for k, a in enumerate(self.arcs[node]):
                if a.room > 0 and far[node] + a.cost < far[a.head]:
                    far[a.head], via[a.head] = far[node] + a.cost, (node, k)
                    if a.head not in queued:
                        queued.add(a.head)
                        queue.append(a.head)
        return far, via

    def run(self, start: int, end: int) -> int:
        """Sends the most flow at the least cost; returns the cost."""
        total = 0
        while True:
            far, via = self._shortest(start)
            if via[end] is None:
                return total
            path, node = [], end
            while node != start:
                tail, k = via[node]
                path.append(self.arcs[tail][k])
                node = tail
            push = min(a.room for a in path)
            for a in path:
                a.room -= push
                self.arcs[a.head][a.back].room += push
            total += push * int(far[end])


def route(patterns: dict[tuple, int], targets: dict, repeats: int) -> dict[tuple, dict]:
    """Words that each pattern gives to each of its sources.

    ``patterns``: members -> words there are. The r-th use of a word costs r - 1
    squared, so the flow uses fresh words first, then second uses, and so on.
    """
    names = sorted(targets, key=lambda s: (s is None, s))
    at = {s: 1 + len(patterns) + i for i, s in enumerate(names)}
    end = 1 + len(patterns) + len(names)
    net, given = FlowNetwork(end + 1), {}
    for i, (members, size) in enumerate(patterns.items(), 1):
        for r in range(repeats):
            net.arc(0, i, size, r * r)
        given[members] = {s: (net.arc(i, at[s], repeats * size, 0), repeats * size) for s in members}
    for s in names:
        net.arc(at[s], end, round(targets[s]), 0)
    net.run(0, end)
    return {m: {s: room - a.room for s, (a, room) in arcs.items()} for m, arcs in given.items()}


def mix(docs: DataFrame, key: str, members: str, size: str, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 20240607) -> DataFrame:
    """Adds to each row of ``docs`` what the mix takes of it.

    ``members``: array of the sources a document belongs to, in any order and
    with repeats; ``size``: its words. Returns ``row`` (a struct of all of
    ``docs``' columns, so no name can clash), ``source_size`` and ``target`` (of the
    first member by code point) and ``taken``, the words taken with repeats
    counted; the document in which a quota ends gives only the words still
    wanted. Rows with one draw and size that meet a quota's end share what is
    wanted evenly. Sources, ordered by code point with null last, weigh
    ``weights``, repeating. Reruns with one seed agree.

    Only ids, sizes and patterns are aggregated: whole rows are never shuffled
    or sorted, the last step adds a column to each where it is. The driver holds
    one row per pattern, the overlaps of sources in metadata, and the same rows
    are what is broadcast.
    """
    spark, kind = docs.sparkSession, docs.schema[members].dataType
    pattern = F.array_sort(F.array_distinct(F.coalesce(F.col(members), F.array().cast(kind))))
    draw = F.xxhash64(F.lit(seed), F.col(key), F.col(size))
    slim = written(docs.select(pattern.alias("m"), draw.alias("draw"), F.col(size).alias("size")), "mix-sizes")
    patterns = {tuple(r["m"]): r["words"] for r in slim.groupBy("m").agg(F.sum("size").alias("words")).collect()}
    sizes: dict = {}
    for m, words in patterns.items():
        for s in m:
            sizes[s] = sizes.get(s, 0) + words
    names = sorted(sizes, key=lambda s: (s is None, s))
    whole = sum(patterns.values())
    shares = target_shares([sizes[s] for s in names], [weights[i % len(weights)] for i in range(len(names))], share * whole / max(1, sum(sizes.values())), repeats)
    targets = dict(zip(names, shares))
    routed = route(patterns, targets, repeats)
    plan = {}
    for m, words in patterns.items():
        given = sum(routed[m].values())
        turns, rest = divmod(given, words) if words else (0, 0)
        plan[m] = (int(turns), int(rest), int(sizes.get(m[0], 0)) if m else 0, float(targets.get(m[0], 0.0)) if m else 0.0)
    ends = _quota_ends(slim, {m: p[1] for m, p in plan.items()}, kind)
    removed(spark, slim)
    rows = [(list(m), *p, *ends.get(m, (None, None, None))) for m, p in plan.items()]
    table = spark.createDataFrame(rows, T.StructType([
        T.StructField("__m", kind), T.StructField("turns", T.LongType()), T.StructField("rest", T.LongType()), T.StructField("source_size", T.LongType()),
        T.StructField("target", T.DoubleType()), T.StructField("end_draw", T.LongType()), T.StructField("end_size", T.LongType()), T.StructField("end_gives", T.LongType()),
    ]))
    base = docs.select(F.struct(*docs.columns).alias("row"), pattern.alias("__m"), draw.alias("__draw"), F.col(size).alias("__size"))
    before = (F.col("__draw") < F.col("end_draw")) | ((F.col("__draw") == F.col("end_draw")) & (F.col("__size") < F.col("end_size")))
    at_end = (F.col("__draw") == F.col("end_draw")) & (F.col("__size") == F.col("end_size"))
    extra = F.when(before, F.col("__size")).when(at_end, F.col("end_gives")).otherwise(F.lit(0))
    return base.join(F.broadcast(table), "__m").select("row", "source_size", "target", (F.col("__size") * F.col("turns") + extra).cast("long").alias("taken"))


def _quota_ends(slim: DataFrame, rest: dict[tuple, int], kind: T.DataType) -> dict[tuple, tuple]:
    """Where each pattern's quota ends in the seeded order: draw, size, and the
    words that each row there gives.

    The order is searched in three steps, each summing what is left by the next
    bits of the draw, so the last one orders a 2^26th part of the documents.
    """
    schema = T.StructType([T.StructField("m", kind), T.StructField("wanted", T.LongType())])
    edge = slim.sparkSession.createDataFrame([(list(m), n) for m, n in rest.items() if n > 0], schema)
    left, known = slim, ["m"]
    for step in (1, 2):
        left = left.join(F.broadcast(edge.drop("wanted")), known) if step > 1 else left
        left = left.withColumn(f"p{step}", F.shiftright("draw", 64 - 13 * step))
        sums = left.groupBy(*known, f"p{step}").agg(F.sum("size").alias("words"))
        edge = _crossed(sums, edge, known, [f"p{step}"]).select(*known, f"p{step}", "wanted")
        known = [*known, f"p{step}"]
    last = left.join(F.broadcast(edge.drop("wanted")), known).groupBy(*known, "draw", "size").agg(F.sum("size").alias("words"), F.count("*").alias("ties"))
    found = _crossed(last, edge, known, ["draw", "size"])
    return {tuple(r["m"]): (r["draw"], r["size"], r["wanted"] // r["ties"]) for r in found.collect()}


def _crossed(sums: DataFrame, edge: DataFrame, known: list[str], order: list[str]) -> DataFrame:
    """The one row of ``sums`` in each group in which ``edge``'s wanted words are
    reached; ``wanted`` becomes what is still wanted there."""
    running = Window.partitionBy(*known).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        sums.withColumn("before", F.sum("words").over(running) - F.col("words")).join(F.broadcast(edge), known)
        .where((F.col("before") < F.col("wanted")) & (F.col("wanted") <= F.col("before") + F.col("words")))
        .withColumn("wanted", F.col("wanted") - F.col("before"))
    )


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every document,
    each belonging to the one source that its row names."""
    sized = docs.select("doc_id", F.array("source").alias("members"), word_count(F.col("text")).alias("size"))
    return mix(sized, "doc_id", "members", "size", **options).select(
        "row.doc_id", F.col("row.members")[0].alias("source"), "row.size", "source_size", "target", "taken"
    )


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, each as often as the mix
    takes it; the document in which a quota ends counts as whole from half on.
    A document without words adds nothing to a mix and is not in it."""
    columns = docs.columns
    sized = docs.select(
        F.struct(*columns).alias("doc"), F.col("doc_id").alias("id"), F.array("source").alias("members"), word_count(F.col("text")).alias("size")
    )
    copies = F.floor(F.col("taken") / F.col("row.size") + 0.5).cast("int")
    return (
        mix(sized, "id", "members", "size", **options).where("row.size > 0").withColumn("copies", copies).where("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.doc.*")
    )
