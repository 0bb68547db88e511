"""Lookups, ranges, samples, set operations and histograms over records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timefn
from ..session import settled, workspace


def newest(rows: DataFrame, limit: int, at: str = "ts", key: str = "memory_id", where: Column | None = None, offset: int = 0) -> DataFrame:
    """A page of rows, newest first; filters come before the limit."""
    rows = rows if where is None else rows.where(where)
    return rows.orderBy(F.desc(at), F.asc(key)).offset(offset).limit(limit)


def with_all_words(rows: DataFrame, words: list[str], text: str = "text") -> DataFrame:
    """Rows whose text holds every word, ASCII case aside."""
    for word in words:
        rows = rows.where(F.contains(F.lower(text), F.lit(word.lower())))
    return rows


def keyword_search(memories: DataFrame, annotations: DataFrame, word: str, limit: int) -> DataFrame:
    """Records holding ``word``, then those whose annotations hold it; each once."""
    direct = memories.where(F.col("text").ilike(f"%{word}%")).select("memory_id", F.lit(0).alias("lane"))
    noted = annotations.where(F.col("note").ilike(f"%{word}%")).select("memory_id", F.lit(1).alias("lane")).distinct()
    best = direct.unionByName(noted).groupBy("memory_id").agg(F.min("lane").alias("lane"))
    return best.orderBy("lane", "memory_id").limit(limit)


def local_day(rows: DataFrame, day: str, at: str = "ts") -> DataFrame:
    d = F.lit(day).cast("date")
    return rows.where(timefn.in_local_days(F.col(at).cast("timestamp"), d, d))


def day_counts(rows: DataFrame, at: str = "ts") -> DataFrame:
    return rows.groupBy(timefn.local_day(F.col(at).cast("timestamp")).cast("string").alias("day")).agg(F.count("*").alias("n"))


def wakeup(memories: DataFrame, seed: int = 3) -> DataFrame:
    """Sections of a start-of-day digest: pinned, emotional, latest, and a
    seeded draw of old records."""
    def section(name: str, rows: DataFrame, limit: int | None, *order) -> DataFrame:
        rows = rows.orderBy(*order).limit(limit) if limit else rows
        return rows.select(F.lit(name).alias("section"), "memory_id")

    return (
        section("pinned", memories.where("pinned"), None)
        .unionByName(section("emotional", memories.where("emotion >= 0.7"), 5, F.desc("ts"), "memory_id"))
        .unionByName(section("latest", memories, 3, F.desc("ts"), "memory_id"))
        .unionByName(section("old", memories.where("ts < timestamp_ntz'2024-01-01 04:00:00'"), 3, F.md5(F.concat_ws("|", "memory_id", F.lit(str(seed)))), "memory_id"))
    )


def islands(memories: DataFrame, edges: DataFrame) -> DataFrame:
    """Records that no edge touches."""
    ends = edges.select(F.col("source_id").alias("memory_id")).union(edges.select("target_id"))
    return memories.join(ends, "memory_id", "left_anti")


def index_gaps(docs: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """``key, gap``: 'missing' from the index, or 'orphan' in it."""
    return docs.join(index, key, "left_anti").select(key, F.lit("missing").alias("gap")).unionByName(index.join(docs, key, "left_anti").select(key, F.lit("orphan").alias("gap")))


def back_index(links: DataFrame, source: str, targets: str) -> DataFrame:
    """``target -> sorted sources`` from an array column of targets."""
    return links.select(source, F.explode(targets).alias("target")).groupBy("target").agg(F.array_sort(F.collect_set(source)).alias("sources"))


def temporal_neighbors(items: DataFrame, hours: float, k: int, key: str = "id", at: str = "ts") -> DataFrame:
    """The ``k`` items nearest in time to each, within ``hours``.

    Items meet in buckets as wide as the window, each also offered to the next
    one, so the range join is an equality join.
    """
    seconds = int(hours * 3600)
    t = F.unix_timestamp(F.col(at).cast("timestamp"))
    base = items.select(key, t.alias("t"), F.floor(t / seconds).alias("bucket"))
    other = base.select(F.col(key).alias("other"), F.col("t").alias("u"), F.explode(F.array(F.col("bucket") - 1, F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    near = base.join(other, "bucket").where((F.col(key) != F.col("other")) & (F.abs(F.col("t") - F.col("u")) <= seconds))
    order = Window.partitionBy(key).orderBy(F.abs(F.col("t") - F.col("u")), "other")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(key, "other", "rank")


def dialogue_sessions(messages: DataFrame, minutes: int = 20) -> DataFrame:
    """Sessions by gaps of more than ``minutes`` within a conversation."""
    w = Window.partitionBy("conv_id").orderBy("ts", "id")
    gap = F.unix_timestamp(F.col("ts").cast("timestamp")) - F.lag(F.unix_timestamp(F.col("ts").cast("timestamp"))).over(w)
    return messages.withColumn("new", F.coalesce((gap > minutes * 60).cast("int"), F.lit(1))).withColumn("session", F.sum("new").over(w)).drop("new")


def dialogue_windows(messages: DataFrame, hits: DataFrame, most: int = 6, minutes: int = 20, clip: int = 1000) -> DataFrame:
    """Around each hit ``(hit_id, conv_id, session)``: the messages of its
    session nearest by id, at most ``most``, as one clipped text."""
    lines = dialogue_sessions(messages, minutes).select("conv_id", "session", "id", F.concat_ws(": ", "kind", "text").alias("line"))
    both = hits.join(lines, ["conv_id", "session"])
    order = Window.partitionBy("hit_id").orderBy(F.abs(F.col("id") - F.col("hit_id")), "id")
    near = both.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda s: s["line"]), "\n")
    return near.groupBy("hit_id").agg(F.substring(body, 1, clip).alias("window"), F.count("*").alias("lines"))


#: Events of an island that are folded in one row; longer ones are followed by pointers.
FOLDED = 4096
DAY = 86_400_000_000


def first_accepted(events: DataFrame, key: str, at: str, minutes: int, folded: int = FOLDED) -> DataFrame:
    """Events at least ``minutes`` after the last accepted one of their key, by
    time and ``event_id``; those without a time are left out.

    An event that follows a gap of ``minutes`` is accepted whatever came before,
    so each key falls into islands. Short ones are folded; in longer ones every
    event points to the first that is ``minutes`` later, and what the first
    event reaches is found by doubling. Windows are cut by day, so that no task
    orders all events of a busy key.
    """
    gap = minutes * 60_000_000
    rows = events.select(F.struct("*").alias("row"), F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.col("event_id").alias("id")).where("t IS NOT NULL")
    with workspace(events.sparkSession) as settle:
        islands = settle(_islands(rows.withColumn("day", F.floor(F.col("t") / DAY)), gap))
        sizes = islands.groupBy("key", "island").agg(F.count("*").alias("n"))
        large = settle(sizes.where(F.col("n") > folded).select("key", "island"))
        members = islands
        parts = []
        if large.limit(1).count():
            same = lambda left: left["key"].eqNullSafe(large["key"]) & (left["island"] == large["island"])
            members = islands.join(large, same(islands), "left_anti")
            parts.append(_reached(islands.join(large, same(islands), "left_semi"), gap, settle).select("row"))
        line = F.array_sort(F.collect_list(F.struct("t", "id", "row")))
        start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast(f"array<{events.schema.simpleString()}>").alias("kept"))
        step = lambda seen, x: F.when(
            seen["last"].isNull() | (x["t"] - seen["last"] >= gap), F.struct(x["t"].alias("last"), F.concat(seen["kept"], F.array(x["row"])).alias("kept"))
        ).otherwise(seen)
        parts.append(members.groupBy("key", "island").agg(line.alias("line")).select(F.explode(F.aggregate("line", start, step)["kept"]).alias("row")))
        return settled(reduce(DataFrame.union, parts).select("row.*"))


def _islands(rows: DataFrame, gap: int) -> DataFrame:
    """``rows (key, t, id, day)`` with ``island``, the time of the last event
    before or at theirs that follows a gap."""
    line = Window.partitionBy("key", "day").orderBy("t", "id")
    later = rows.withColumn("before", F.lag("t").over(line)).withColumn("start", F.when(F.col("t") - F.col("before") >= gap, F.col("t")))
    within = later.withColumn("inner", F.max("start").over(line))
    days = Window.partitionBy("key").orderBy("day")
    by_day = later.groupBy("key", "day").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.max("start").alias("inner"))
    opens = F.col("yesterday").isNull() | (F.col("low") - F.col("yesterday") >= gap)
    by_day = by_day.withColumn("yesterday", F.lag("high").over(days)).withColumn("first", F.when(opens, F.col("low")))
    earlier = F.last(F.coalesce("inner", "first"), ignorenulls=True).over(days.rowsBetween(Window.unboundedPreceding, -1))
    by_day = by_day.select(F.col("key").alias("k"), F.col("day").alias("d"), F.coalesce("first", earlier).alias("carried"))
    both = within.join(by_day, within["key"].eqNullSafe(by_day["k"]) & (within["day"] == by_day["d"]))
    return both.select("row", "key", "t", "id", "day", F.coalesce("inner", "carried").alias("island"))


def _reached(rows: DataFrame, gap: int, settle) -> DataFrame:
    """Of every island the events that its first one leads to, when each points
    to the first event that is ``gap`` later."""
    me = F.struct("t", "id")
    group = F.struct("key", "island")
    marks = rows.select(group.alias("g"), "day", "t", "id", F.lit(0).alias("asks"), me.alias("me"))
    asking = rows.select(group.alias("g"), F.floor((F.col("t") + gap) / DAY).alias("day"), (F.col("t") + gap).alias("t"), "id", F.lit(1).alias("asks"), me.alias("me"))
    both = marks.union(asking)
    back = Window.partitionBy("g", "day").orderBy(F.desc("t"), "asks", F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    event = F.when(F.col("asks") == 0, F.col("me"))
    days = Window.partitionBy("g").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    first = both.groupBy("g", "day").agg(F.min(event).alias("first")).withColumn("later", F.last("first", ignorenulls=True).over(days)).select("g", "day", "later")
    pointed = both.withColumn("next", F.last(event, ignorenulls=True).over(back)).where("asks = 1").join(first, ["g", "day"])
    jump = settle(pointed.select("g", "me", F.coalesce("next", "later").alias("next")).where("next IS NOT NULL").distinct())
    found = settle(rows.groupBy(group.alias("g")).agg(F.min(me).alias("me")))
    while True:
        fresh = settle(found.join(jump, ["g", "me"]).select("g", F.col("next").alias("me")))
        if fresh.limit(1).count() == 0:
            break
        found = settle(found.union(fresh).distinct())
        on = jump.select("g", F.col("me").alias("next"), F.col("next").alias("further"))
        jump = settle(jump.join(on, ["g", "next"]).select("g", "me", F.col("further").alias("next")))
    named = rows.withColumn("g", group).withColumn("me", me).dropDuplicates(["g", "me"])
    return named.join(found, ["g", "me"], "left_semi")


def every_nth(events: DataFrame, key: str, at: str, n: int) -> DataFrame:
    """Events with their place in the cadence of ``n``: 1 to n, then again."""
    w = Window.partitionBy(key).orderBy(at, "event_id")
    return events.withColumn("position", (F.row_number().over(w) - 1) % n + 1)


def cooling(events: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """Whether an event's key was seen in the ``seconds`` before it."""
    t = F.unix_timestamp(F.col(at).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at, "event_id")
    return events.withColumn("cooled", F.coalesce(t - F.lag(t).over(w) < seconds, F.lit(False)))


def sliding_counts(events: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    t = F.unix_timestamp(F.col(at).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(t).rangeBetween(-seconds, 0)
    return events.withColumn("recent", F.count("*").over(w))
