"""Composite reports: health audits, job status, queue, briefing, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signals


def graph_health(memories: DataFrame, edges: DataFrame, vectors: DataFrame, pending: DataFrame) -> DataFrame:
    """One row: sizes of store and projections, islands, pending, agreement."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    ends = edges.select(F.col("source_id").alias("memory_id")).union(edges.select("target_id")).distinct()
    row = n(memories, "memories").crossJoin(n(edges, "edges")).crossJoin(n(vectors, "vectors")).crossJoin(n(pending, "pending")).crossJoin(n(memories.join(ends, "memory_id", "left_anti"), "islands"))
    return row.withColumn("consistent", F.col("memories") == F.col("vectors") + F.col("pending"))


def queue_report(proposals: DataFrame, now: Column) -> DataFrame:
    """Pending proposals by kind: how many, new in a day, oldest wait in hours."""
    waiting = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp"))) / 3600
    return proposals.where("status = 'pending'").groupBy("kind").agg(
        F.count("*").alias("pending"), F.count_if(waiting <= 24).alias("new"), F.round(F.max(waiting), 3).alias("oldest_hours")
    )


def tag_health(memories: DataFrame, now: Column, days: int = 14) -> DataFrame:
    """Untagged records, stale current states, and the tags in use."""
    stale = F.array_contains("tags", "state:current") & (F.col("ts") < now - F.make_dt_interval(F.lit(days)))
    return memories.agg(F.count_if(F.size("tags") == 0).alias("untagged"), F.count_if(stale).alias("stale_current"), F.count("*").alias("memories"))


def reconciled(one: DataFrame, two: DataFrame, by: str, most: float = 0.2) -> DataFrame:
    """Two sources' counts by ``by``, their ratio, and an alert beyond ``most``."""
    both = one.groupBy(by).agg(F.count("*").alias("left")).join(two.groupBy(by).agg(F.count("*").alias("right")), by, "full").na.fill(0, ["left", "right"])
    ratio = F.when(F.col("right") > 0, F.round(F.col("left") / F.col("right"), 6))
    return both.withColumn("ratio", ratio).withColumn("alert", F.coalesce(F.abs(1 - F.col("ratio")) > most, F.lit(True)))


def snapshot_delta(today: DataFrame, before: DataFrame, key: str, value: str) -> DataFrame:
    """Values of two daily snapshots with their difference."""
    t, b = today.select(key, F.col(value).alias("now")), before.select(key, F.col(value).alias("was"))
    return t.join(b, key, "full").withColumn("delta", F.round(F.coalesce("now", F.lit(0)) - F.coalesce("was", F.lit(0)), 6))


def latest(rows: DataFrame, by: str, at: str) -> DataFrame:
    """The last row of each ``by``."""
    order = Window.partitionBy(by).orderBy(F.desc(at), F.desc("event_id"))
    return rows.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def manifest(memories: DataFrame, collection: str = "library") -> DataFrame:
    """The table of contents of a collection: first tag, size, titles in order."""
    return memories.where(F.col("collection") == collection).groupBy(F.col("tags")[0].alias("shelf")).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list("memory_id")).alias("items")
    )


def briefing(memories: DataFrame, semantic: DataFrame, hot: float = 2.0, warm: float = 0.6) -> DataFrame:
    """Sections in order, each record once: two hot and one warm record that no
    update supersedes, pinned ones, two newest, one old."""
    old = semantic.where("role = 'updates'").select(F.col("target_id").alias("memory_id")).distinct()
    live = memories.join(old, "memory_id", "left_anti")
    a = F.col("activation")
    parts = (
        (0, "hot", live.where(a >= hot).orderBy(F.desc("activation"), "memory_id").limit(2)), (1, "warm", live.where((a >= warm) & (a < hot)).orderBy(F.desc("activation"), "memory_id").limit(1)),
        (2, "pinned", memories.where("pinned")), (3, "newest", memories.orderBy(F.desc("ts"), "memory_id").limit(2)), (4, "old", memories.orderBy("ts", "memory_id").limit(1)),
    )
    every = None
    for place, name, rows in parts:
        part = rows.select(F.lit(place).alias("place"), F.lit(name).alias("section"), "memory_id")
        every = part if every is None else every.unionByName(part)
    first = Window.partitionBy("memory_id").orderBy("place")
    return every.withColumn("k", F.row_number().over(first)).where("k = 1").select("place", "section", "memory_id")


def trimmed_rounds(messages: DataFrame, keep: int = 2, most: int = 200) -> DataFrame:
    """Messages of each conversation with long assistant texts outside its last
    ``keep`` user turns replaced by a note."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    later = F.coalesce(F.sum((F.col("kind") == "user").cast("int")).over(w), F.lit(0))
    old = (later >= keep) & (F.col("kind") != "user") & (F.length("text") > most)
    return messages.withColumn("text", F.when(old, "[earlier result removed]").otherwise(F.col("text")))


def rendered(rows: DataFrame, title: str, *columns: str) -> str:
    """A Markdown table of a small report frame, rendered on the driver; a
    report is bounded by its own limits."""
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns)
    body = "\n".join("| " + " | ".join(str(r[c]) for c in columns) + " |" for r in rows.limit(500).collect())
    return f"## {title}\n\n{head}\n{body}\n"


def sizes(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("human", signals.human_bytes(F.col(column)))


def job_status(runs: DataFrame, expected: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Every expected job with its last run, and whether that is recent and
    good; ``all_recent`` is the same on every row."""
    last = runs.groupBy("job").agg(F.max(F.struct("at", "ok")).alias("last"))
    joined = expected.select("job").join(last, "job", "left")
    good = F.coalesce((F.col("last.at") >= now - F.expr(f"interval {hours} hours")) & F.col("last.ok"), F.lit(False))
    return joined.select("job", F.col("last.at").alias("at"), good.alias("recent")).withColumn("all_recent", F.bool_and("recent").over(Window.partitionBy(F.lit(0))))


def group_payloads(groups: DataFrame, memories: DataFrame, prior: DataFrame) -> DataFrame:
    """Nested rows of candidate groups ``(group_id, members)``: their records in
    time order, the days they span, and what a review said before."""
    each = groups.select("group_id", F.explode("members").alias("memory_id")).join(memories.select("memory_id", "ts", "level"), "memory_id")
    built = each.groupBy("group_id").agg(
        F.array_sort(F.collect_list(F.struct("ts", "memory_id", "level"))).alias("records"), F.date_diff(F.max("ts"), F.min("ts")).alias("span_days")
    )
    return built.join(prior.select("group_id", "status"), "group_id", "left")


def seeds(memories: DataFrame, since=None, ids: DataFrame | None = None) -> DataFrame:
    """Records to start a run from: those named, else those since a mark."""
    if ids is not None:
        return memories.join(ids, "memory_id", "left_semi")
    return memories if since is None else memories.where(F.col("ts") >= since)


def day_differences(labels: Column, today: Column) -> Column:
    """Days since each date of a map label -> ISO date."""
    return F.transform_values(labels, lambda _, d: F.date_diff(today, d.cast("date")))
