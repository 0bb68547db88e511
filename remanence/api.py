"""The engine as one object: reads are queries, writes return next snapshots.

``Engine`` binds the operators to a set of tables. Nothing it returns has run:
results are lazy DataFrames, and a write is published by the caller through
:func:`remanence.sources.snapshots.publish`. Reads change nothing; heat and counts
are separate, idempotent writes.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hashing, router, text, vector
from .operators import beliefs, chunks, graph, lifecycle, proposals, ranking, records, reports, search
from .sources import tables

#: Shelves of the library that a new long text may name.
SHELVES = ("essay", "poem", "note", "letter", "thread")


@dataclass(frozen=True)
class Engine:
    """Tables of the engine; missing ones are empty frames of their schema."""

    spark: SparkSession
    memories: DataFrame
    flow: DataFrame
    semantic: DataFrame
    vectors: DataFrame
    messages: DataFrame
    extra: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def over(cls, spark: SparkSession, sf_dir: str) -> Engine:
        """An engine over the driver's tables."""
        return cls(
            spark, tables.memories(spark, sf_dir), tables.flow_edges(spark, sf_dir), tables.semantic_edges(spark, sf_dir), tables.vectors(spark, sf_dir),
            tables.messages(spark, sf_dir), {"beliefs": tables.beliefs(spark, sf_dir), "cases": tables.belief_cases(spark, sf_dir)},
        )

    # --- reads ---------------------------------------------------------------
    def get(self, memory_id: str) -> DataFrame:
        return self.memories.where(F.col("memory_id") == memory_id)

    def count(self) -> DataFrame:
        return self.memories.agg(F.count("*").alias("n"))

    def recent(self, limit: int = 30, without_tags: tuple[str, ...] = ()) -> DataFrame:
        keep = ~F.arrays_overlap("tags", F.array(*[F.lit(t) for t in without_tags])) if without_tags else None
        return records.newest(self.memories, limit, where=keep)

    def recent_raw(self, now: Column, hours: int = 48, level: str = "raw") -> DataFrame:
        return self.memories.where((F.col("level") == level) & (F.col("ts") >= now - F.expr(f"interval {hours} hours"))).orderBy("ts", "memory_id")

    def by_level(self, level: str) -> DataFrame:
        return self.memories.where(F.col("level") == level).orderBy(F.desc("ts"), "memory_id")

    def by_date(self, day: str) -> DataFrame:
        return records.local_day(self.memories, day).orderBy("ts", "memory_id")

    def calendar(self) -> DataFrame:
        return records.day_counts(self.memories)

    def search(self, queries: DataFrame, limit: int = 5, level: str | None = None, collection: str = "exclude") -> DataFrame:
        """Full-text hits of ``queries (query_id, text)``; ``collection`` is
        exclude, only or all, about the library."""
        pool = self.memories if level is None else self.memories.where(F.col("level") == level)
        if collection != "all":
            pool = pool.where((F.col("collection") == "library") == (collection == "only"))
        return search.bm25(pool, queries, key="memory_id", limit=limit)

    def nearest(self, asked: DataFrame, limit: int = 10, most: float | None = 0.8) -> DataFrame:
        """Vector hits of ``asked (query_id, vector)``."""
        return search.nearest(self.vectors, asked, "memory_id", limit, most)

    def recall(self, queries: DataFrame, asked: DataFrame, now: str, policy: str = "conversation", depth: int = 3) -> DataFrame:
        """Ranked recall: seeds of both kinds, diffusion, scores, current
        versions; at most the policy's budget a question."""
        rules = search.POLICIES[policy]
        n = 3 * rules.budget
        seeds = search.fused(self.nearest(asked, n), search.bm25(self.memories, queries, key="memory_id", limit=n), "memory_id")
        spread = search.diffused(seeds, self.flow, now, depth, 5 * rules.budget)
        both = spread.join(seeds.select("query_id", "memory_id", "similarity"), ["query_id", "memory_id"], "left").select(
            "query_id", "memory_id", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.when(F.col("depth") > 0, F.col("mass")).otherwise(0.0).alias("graph")
        )
        scored = search.recall_scores(both, self.memories, graph.reviewed_confidence(self.semantic), graph.newest_versions(self.semantic))
        live = search.current_versions(scored, self.memories).where(F.col("score") >= rules.least)
        return search.top(live, "query_id", [F.desc("score"), F.asc("memory_id")], rules.budget)

    def chat_history(self, queries: DataFrame, limit: int = 3) -> DataFrame:
        """Messages that answer, each with its dialogue window."""
        hits = search.bm25(self.messages.withColumnRenamed("id", "doc_id"), queries, limit=limit)
        placed = records.dialogue_sessions(self.messages).select(F.col("id").alias("hit_id"), "conv_id", "session")
        windows = records.dialogue_windows(self.messages, placed.join(hits.select(F.col("doc_id").alias("hit_id")).distinct(), "hit_id", "left_semi"))
        return hits.withColumnRenamed("doc_id", "hit_id").join(windows, "hit_id").select("query_id", "hit_id", "rank", "score", "window")

    def route(self, questions: DataFrame) -> DataFrame:
        return router.routed(questions)

    def neighbors(self, seeds: DataFrame, least: float = 0.1, limit: int = 20) -> DataFrame:
        near = graph.neighbors(self.flow, seeds, least, limit)
        return near.join(self.memories.select(F.col("memory_id").alias("target_id"), "text"), "target_id")

    def hot(self, limit: int = 5, least: float = 2.0) -> DataFrame:
        return self.memories.where(F.col("activation") >= least).orderBy(F.desc("activation"), "memory_id").limit(limit)

    def hot_neighbors(self, seeds: DataFrame, least: float = 2.0, limit: int = 5) -> DataFrame:
        return graph.hot_neighbors(self.memories, self.flow, seeds, least, limit)

    def manifest(self) -> DataFrame:
        return reports.manifest(self.memories)

    def unfurl(self, memory_id: str) -> DataFrame:
        return self.get(memory_id).where("collection = 'library'")

    def briefing(self) -> DataFrame:
        return reports.briefing(self.memories, self.semantic)

    def health(self) -> DataFrame:
        return reports.graph_health(self.memories, self.semantic, self.vectors, lifecycle.pending_vectors(self.memories, self.vectors))

    def belief_list(self, now: Column) -> DataFrame:
        weighted = beliefs.case_weights(self.extra["cases"], self.memories, now)
        return beliefs.confidence(self.extra["beliefs"], weighted)

    def touched_belief(self, asked: DataFrame, statements: DataFrame, excluded: DataFrame, least: float = 0.45) -> DataFrame:
        """The routed belief nearest to each question, if near enough."""
        pairs = asked.join(statements.join(excluded, "belief_id", "left_anti")).withColumn("similarity", F.round(vector.cosine("vector", "embedding"), 6))
        return search.top(pairs.where(F.col("similarity") >= least), "query_id", [F.desc("similarity"), F.asc("belief_id")], 1).select("query_id", "belief_id", "similarity")

    # --- writes: each returns the next engine ------------------------------------
    def integrate(self, rows: DataFrame, supported_by: DataFrame | None = None) -> Engine:
        """New records merged in; old time and emotion stay. Evidence edges
        ``(source_id, target_id)`` are added if their ends keep the contract."""
        merged = lifecycle.upserted(self.memories, rows, "memory_id", keep=("ts", "emotion"))
        if supported_by is None:
            return replace(self, memories=merged)
        edges = supported_by.select("source_id", "target_id", F.lit("SUPPORTED_BY").alias("role"))
        broken = graph.typed_violations(edges, merged)
        good = edges.join(broken, ["source_id", "target_id", "role"], "left_anti").withColumns({"confidence": F.lit(1.0), "strength": F.lit(1.0), "review_state": F.lit("approved")})
        return replace(self, memories=merged, semantic=lifecycle.added_if_absent(self.semantic, good, "source_id", "target_id", "role"))

    def heated(self, roots: DataFrame, boost: float, event_id: str, events: DataFrame) -> Engine:
        """Activation after one heat event; nothing changes if ``events`` already
        holds its id."""
        fresh = roots.join(events.where(F.col("event_id") == event_id).select(F.lit(True).alias("__done")), how="left").where("__done IS NULL").drop("__done")
        hot = graph.heat_spread(self.memories, self.flow, fresh, boost).select("memory_id", F.col("activation").alias("value"))
        return replace(self, memories=lifecycle.updated(self.memories, hot, "memory_id", "activation"))

    def cooled(self, ids: DataFrame, amount: float = 2.0) -> Engine:
        return replace(self, memories=lifecycle.cooled(self.memories, ids, amount))

    def connected(self, pairs: DataFrame, weight: float = 1.0, mode: str = "manual") -> Engine:
        """Flow edges both ways between ``pairs (source_id, target_id)``."""
        both = pairs.select("source_id", "target_id").union(pairs.select("target_id", "source_id"))
        new = both.withColumns({"weight": F.lit(weight), "conductance": F.lit(1.0), "last_fired": F.lit(None).cast("timestamp_ntz"), "provenance": F.lit(mode)})
        return replace(self, flow=graph.merged_flow(self.flow, new, mode))

    def removed(self, ids: DataFrame, now: Column, by: str) -> tuple[Engine, DataFrame]:
        kept, trash, left = lifecycle.soft_deleted(self.memories, {"flow": (self.flow, ("source_id", "target_id")), "semantic": (self.semantic, ("source_id", "target_id"))}, ids, now, by)
        return replace(self, memories=kept, flow=left["flow"], semantic=left["semantic"]), trash

    def threaded(self, shelf: str, memory_id: str, title: str, body: str) -> Engine:
        """A long text put on a shelf of the library."""
        if shelf not in SHELVES:
            raise ValueError(f"shelf must be one of {SHELVES}")
        row = self.spark.range(1).select(F.lit(memory_id).alias("memory_id"), F.lit(f"《{title}》\n{body}").alias("text"), F.lit("core").alias("tier"), F.lit("library").alias("collection"), F.array(F.lit(shelf)).alias("tags"))
        return self.integrate(row)

    def slept(self, decay: float = 0.96, strong: float = 0.98) -> Engine:
        """One night: edges decay and are pruned, activation decays."""
        edges = graph.decayed_strong_edges(graph.decayed_edges(self.flow, factor=decay), factor=strong)
        after = graph.decayed_activation(self.memories, edges).select("memory_id", F.col("activation").alias("value"))
        return replace(self, flow=edges, memories=lifecycle.updated(self.memories, after, "memory_id", "activation"))

    def proposed_links(self, seeds: DataFrame, least: float = 0.82) -> DataFrame:
        """Flow links that the seeds' vectors suggest."""
        x = self.vectors.join(seeds, "memory_id", "left_semi").select(F.col("memory_id").alias("a"), F.col("embedding").alias("x"))
        y = self.vectors.select(F.col("memory_id").alias("b"), F.col("embedding").alias("y"))
        pairs = x.join(y, F.col("a") != F.col("b")).select("a", "b", F.round(vector.cosine("x", "y"), 6).alias("similarity"))
        return graph.link_proposals(pairs, self.memories, self.flow, least)


__all__ = ["Engine", "SHELVES", "beliefs", "chunks", "hashing", "proposals", "ranking", "text"]
