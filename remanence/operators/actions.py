"""Single actions on records and their queues: appends behind a check, reviews
asked for, tags written back, queue items claimed, and what a reply shows.

Each takes snapshots and a batch of requests, and returns the next snapshot or
the rows to show. A request that breaks its rule is left out, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing, text, timefn
from .graph import both_directions
from .lifecycle import tags_valid


def appended(rows: DataFrame, new: DataFrame) -> DataFrame:
    """``rows`` and after them ``new``; columns that either lacks are null."""
    return rows.unionByName(new, allowMissingColumns=True)


def appended_to_known(rows: DataFrame, new: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """``rows`` and those of ``new`` whose parent ``key`` exists."""
    return appended(rows, new.join(parents.select(key).distinct(), key, "left_semi"))


def without_edges(edges: DataFrame, gone: DataFrame, *columns: str) -> DataFrame:
    """Edges less those that ``gone`` names in all of ``columns``."""
    return edges.join(gone.select(*columns).distinct(), list(columns), "left_anti")


def marked_read(comments: DataFrame, ids: DataFrame, key: str, reader: str) -> DataFrame:
    """Comments with ``reader`` among the readers of those asked for, once."""
    mark = ids.select(key).distinct().withColumn("__read", F.lit(True))
    readers = F.array_union(F.col("read_by"), F.array(F.lit(reader)))
    return comments.join(mark, key, "left").withColumn("read_by", F.when(F.col("__read"), readers).otherwise(F.col("read_by"))).select(*comments.columns)


def level_proposals(requests: DataFrame, memories: DataFrame, flow: DataFrame, semantic: DataFrame) -> DataFrame:
    """Proposals to change levels ``(memory_id, new_level)``: of known records
    that have another level, with the number of edges that touch each."""
    ends = both_directions(flow).select("memory_id").unionByName(both_directions(semantic).select("memory_id"))
    touched = ends.groupBy("memory_id").agg(F.count("*").alias("edges"))
    asked = requests.join(memories.select("memory_id", "level"), "memory_id").where(F.col("level") != F.col("new_level"))
    return asked.join(touched, "memory_id", "left").select(
        hashing.proposal_id(F.lit("level"), F.col("memory_id"), F.col("new_level")).alias("id"), "memory_id", "level", "new_level", F.coalesce("edges", F.lit(0)).alias("edges")
    )


def evokes_requests(requests: DataFrame, memories: DataFrame, semantic: DataFrame) -> DataFrame:
    """Proposals ``(source_id, target_id)`` that keep the contract of evoking:
    from outside the library into it, between known records, not linked yet."""
    m = memories.select("memory_id", "collection")
    good = requests.join(m.toDF("source_id", "__s"), "source_id").join(m.toDF("target_id", "__t"), "target_id").where("__s <> 'library' AND __t = 'library'")
    return good.join(semantic.select("source_id", "target_id").distinct(), ["source_id", "target_id"], "left_anti").select(
        hashing.proposal_id(F.lit("evokes"), F.col("source_id"), F.col("target_id")).alias("id"), "source_id", "target_id"
    )


def routed_to_review(links: DataFrame, reviewed: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Links whose role needs a review, and the rest."""
    return links.where(F.col("role").isin(*reviewed)), links.where(~F.col("role").isin(*reviewed))


def tags_written_back(memories: DataFrame, verdicts: DataFrame, vocabulary: Column) -> DataFrame:
    """Records with the tags that an outside tagger gave ``(memory_id, tags)``,
    where these keep the tag contract; other verdicts change nothing."""
    good = verdicts.where(tags_valid(F.col("tags"), vocabulary)).select("memory_id", F.col("tags").alias("__tags"))
    return memories.join(good, "memory_id", "left").withColumn("tags", F.coalesce("__tags", "tags")).select(*memories.columns)


def claimed(queue: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The queue with every pending item consumed ``now``, and those items."""
    pending = F.col("consumed_at").isNull()
    return queue.withColumn("consumed_at", F.coalesce("consumed_at", now)), queue.where(pending)


def swept(queue: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """The queue without items consumed more than ``days`` ago."""
    return queue.where(F.col("consumed_at").isNull() | (F.col("consumed_at") >= now - F.make_dt_interval(F.lit(days))))


def still_cached(entries: DataFrame, key: str, at: str, now: Column, seconds: int) -> DataFrame:
    """The last entry of each key, if it is younger than its time to live."""
    last = Window.partitionBy(key).orderBy(F.desc(at), *[F.desc(c) for c in entries.columns if c not in (key, at)])
    fresh = F.col(at) > now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(seconds))
    return entries.withColumn("__k", F.row_number().over(last)).where((F.col("__k") == 1) & fresh).drop("__k")


def index_document(label: Column, insight: Column, body: Column) -> Column:
    """What is indexed for a chunk: label, insight if there is one, text."""
    return F.concat_ws("\n", label, F.when(insight != "", insight), body)


def clean_keys(keys: Column, most: int = 5) -> Column:
    """Search keys (structs of key and quote) that hold both, once each."""
    return F.slice(F.array_distinct(F.filter(keys, lambda k: (F.trim(k["key"]) != "") & (F.trim(k["quote"]) != ""))), 1, most)


def person_rewrite(body: Column, terms: Column) -> Column:
    """A question about people with the terms that stand for them."""
    return F.concat_ws(" ", F.array_distinct(F.concat(F.array(body), terms)))


def identity_surface(body: Column, most: int = 24) -> Column:
    """The name in a question about someone: its end, less the question."""
    bare = F.regexp_replace(F.trim(body), r"(?i)(\s+(is|are|was)\s+who)?[\s?？!.]*$", "")
    return F.substring(bare, F.greatest(F.lit(1), F.length(bare) - most + 1), F.lit(most))


def searched_body(tag: Column, snippet: Column, body: Column, matched: Column, shadow: Column, context: Column) -> Column:
    """All that a candidate is searched in: its six fields joined by blanks, a
    missing one as an empty string."""
    return F.array_join(F.array(*[F.coalesce(c, F.lit("")) for c in (tag, snippet, body, matched, shadow, context)]), " ")


def candidate_body(snippet: Column, body: Column) -> Column:
    """What is shown of a candidate."""
    return F.coalesce(F.when(snippet != "", snippet), body)


def association_metadata(mode: Column) -> Column:
    """How an associated record may be used, by the mode of the answer."""
    role = F.when(mode == "evidence", "background").when(mode == "support", "companion").otherwise("association")
    return F.struct(role.alias("role"), (mode != "evidence").alias("may_lead"))


def main_metadata(source: Column, mode: Column) -> Column:
    """What a main record is evidence of, by where it comes from."""
    return F.when(source == "cold", "quotation").when(mode == "evidence", "direct").otherwise("context")


def shown_memory(body: Column, quote: Column, label: Column) -> Column:
    """A record as a reply shows it: the sentences around the quote, behind the
    label of past facts."""
    place = text.span(body, quote)
    around = text.sentence_span(body, place["start"], place["end"])
    part = F.when(place.isNotNull(), F.substring(body, around["start"] + 1, around["end"] - around["start"])).otherwise(body)
    return F.concat(F.when(label == "past", "[past] ").otherwise(""), F.trim(part))


def daily_recap(rows: DataFrame, day: str, diary: Column, at: str = "ts") -> DataFrame:
    """Rows of a local day; on a Sunday also the diary rows of the 7 days before."""
    last = F.lit(day).cast("date")
    t = F.col(at).cast("timestamp")
    today = timefn.in_local_days(t, last, last)
    week = timefn.in_local_days(t, F.date_sub(last, 7), F.date_sub(last, 1)) & diary & (F.dayofweek(last) == 1)
    return rows.withColumn("part", F.when(today, "day").when(week, "week")).where("part IS NOT NULL")


def merged_results(*lists: DataFrame) -> DataFrame:
    """Result lists ``(query_id, memory_id, score)`` as one; scores turn into
    distances, of which a record keeps its least."""
    every = lists[0]
    for more in lists[1:]:
        every = every.unionByName(more)
    return every.groupBy("query_id", "memory_id").agg(F.round(1 - F.max("score"), 6).alias("distance"))


def fetched_association(candidates: DataFrame, excluded: DataFrame, least: float = 0.3) -> DataFrame:
    """``query_id, memory_id, reason`` of candidates ``(query_id, memory_id,
    score, bridge)``: the best one that is neither excluded nor weak and has a
    bridge has no reason, all others tell why they are not shown."""
    out = candidates.join(excluded.select("memory_id").distinct().withColumn("__out", F.lit(True)), "memory_id", "left")
    why = F.when(F.col("__out"), "excluded").when(F.col("bridge").isNull(), "no bridge").when(F.col("score") < least, "weak")
    order = Window.partitionBy("query_id", F.col("why").isNull()).orderBy(F.desc("score"), "memory_id")
    placed = out.withColumn("why", why).withColumn("k", F.row_number().over(order))
    return placed.select("query_id", "memory_id", F.when(F.col("why").isNull() & (F.col("k") > 1), "not first").otherwise(F.col("why")).alias("reason"))


def person_lines(named: DataFrame, memories: DataFrame, most: int = 3) -> DataFrame:
    """``query_id, canonical, line``: of at most ``most`` people named in a
    question ``(query_id, canonical)``, each with the newest record on them
    ``(canonical, memory_id, ts)``."""
    order = Window.partitionBy("query_id").orderBy("canonical")
    few = named.distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    last = memories.groupBy("canonical").agg(F.max(F.struct("ts", "memory_id")).alias("last"))
    return few.join(last, "canonical").select("query_id", "canonical", F.format_string("%s: %s", "canonical", "last.memory_id").alias("line"))


def person_seeds(hits: DataFrame, aliases: DataFrame, most: int = 2) -> DataFrame:
    """At most ``most`` hits ``(query_id, memory_id, rank, text)`` a question
    that name one of its people ``(query_id, alias)``."""
    named = hits.join(aliases, "query_id").where(F.contains(F.lower("text"), F.lower("alias"))).select("query_id", "memory_id", "rank").distinct()
    order = Window.partitionBy("query_id").orderBy("rank", "memory_id")
    return named.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("query_id", "memory_id", F.col("k").alias("place"))


def link_times(links: DataFrame, memories: DataFrame) -> DataFrame:
    """Links ``(source_id, target_id)`` with the time of their later end."""
    m = memories.select("memory_id", "ts")
    return links.join(m.toDF("source_id", "__a"), "source_id").join(m.toDF("target_id", "__b"), "target_id").withColumn("created_at", F.greatest("__a", "__b")).drop("__a", "__b")
