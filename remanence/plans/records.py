"""Queries of lookups, joins, aggregates, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import segments
from ..operators import records, search
from ..sources import tables as T
from .oracle import sql
from .registry import query


@query(sql("SELECT memory_id, ts, level FROM memories ORDER BY ts DESC, memory_id LIMIT 50 OFFSET 10"))
def b08_list_all(spark, sf_dir):
    return records.newest(T.memories(spark, sf_dir), 50, offset=10).select("memory_id", "ts", "level")


@query(sql("SELECT memory_id, ts FROM memories WHERE collection = 'library' AND tags[1] = 'lang:en' ORDER BY ts, memory_id LIMIT 1000"))
def b09_list_collection(spark, sf_dir):
    m = T.memories(spark, sf_dir).where((F.col("collection") == "library") & (F.col("tags")[0] == "lang:en"))
    return m.orderBy("ts", "memory_id").limit(1000).select("memory_id", "ts")


@query(sql("""SELECT memory_id, min(lane) AS lane FROM (SELECT memory_id, 0 AS lane FROM memories WHERE text ILIKE '%threat%' UNION ALL
  SELECT 'd' || doc_id, 1 FROM labels WHERE toxic = 1) GROUP BY 1 ORDER BY 2, 1 LIMIT 100"""))
def b10_keyword_search(spark, sf_dir):
    notes = T.table(spark, sf_dir, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("memory_id"), F.when(F.col("toxic") == 1, "a Threat").otherwise("fine").alias("note"))
    return records.keyword_search(T.memories(spark, sf_dir), notes, "threat", 100)


@query(sql("SELECT memory_id FROM memories WHERE contains(lower(text), 'the') AND contains(lower(text), 'tion')"))
def b05_all_words(spark, sf_dir):
    return records.with_all_words(T.memories(spark, sf_dir), ["The", "tion"]).select("memory_id")


@query(sql("SELECT memory_id, pinned, usage_count, round(activation, 6) AS activation, round(emotion, 6) AS emotion, tier FROM memories WHERE pinned OR activation >= 2.0"))
def b12_pinned_and_hot(spark, sf_dir):
    m = T.memories(spark, sf_dir).where((F.col("activation") >= 2.0) | F.col("pinned"))
    return m.select("memory_id", "pinned", "usage_count", F.round("activation", 6).alias("activation"), F.round("emotion", 6).alias("emotion"), "tier")


@query(sql("SELECT event_id, event_type FROM events WHERE event_type = 'purchase' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR"))
def b21_recent_events(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    last = e.agg(F.max("ts").alias("last"))
    return e.crossJoin(F.broadcast(last)).where((F.col("event_type") == "purchase") & (F.col("ts") >= F.col("last") - F.expr("interval 48 hours"))).select("event_id", "event_type")


@query(sql("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-09 15:00:00' AND ts < TIMESTAMP '2024-01-10 15:00:00'"))
def b24_local_day(spark, sf_dir):
    return records.local_day(T.table(spark, sf_dir, "events"), "2024-01-10").select("event_id", "user_id")


@query(sql("SELECT level, tier, count(*) AS n FROM memories GROUP BY 1, 2"))
def b23_by_level(spark, sf_dir):
    return T.memories(spark, sf_dir).groupBy("level", "tier").agg(F.count("*").alias("n"))


@query(sql("SELECT strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1"))
def d01_calendar_density(spark, sf_dir):
    return records.day_counts(T.table(spark, sf_dir, "events"))


@query(sql("SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM memories) GROUP BY 1 ORDER BY n DESC, tag LIMIT 20"))
def d02_tag_histogram(spark, sf_dir):
    return T.memories(spark, sf_dir).select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(20)


@query(sql("""SELECT round(quantile_cont(activation, 0.25), 6) AS p25, round(quantile_cont(activation, 0.5), 6) AS p50, round(quantile_cont(activation, 0.75), 6) AS p75, round(max(activation), 6) AS top,
  count(*) FILTER (activation < 0.6) AS cold, count(*) FILTER (activation >= 0.6 AND activation < 2) AS warm, count(*) FILTER (activation >= 2 AND activation < 5) AS hot, count(*) FILTER (activation >= 5) AS blazing FROM memories"""))
def d09_activation_distribution(spark, sf_dir):
    a = F.col("activation")
    return T.memories(spark, sf_dir).agg(
        *[F.round(F.percentile("activation", F.lit(q)), 6).alias(n) for q, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))], F.round(F.max("activation"), 6).alias("top"),
        F.count_if(a < 0.6).alias("cold"), F.count_if((a >= 0.6) & (a < 2)).alias("warm"), F.count_if((a >= 2) & (a < 5)).alias("hot"), F.count_if(a >= 5).alias("blazing"),
    )


@query(sql("""SELECT event_type AS gate, count(*) AS calls, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS share, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1"""))
def d11_trace_latencies(spark, sf_dir):
    by = T.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("gate")).agg(F.count("*").alias("calls"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))
    total = by.agg(F.sum("calls").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("gate", "calls", F.round(100 * F.col("calls") / F.col("total"), 1).alias("share"), "p50", "p95")


@query(sql("SELECT c_custkey AS customer FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"))
def g03_orphans(spark, sf_dir):
    return T.table(spark, sf_dir, "customer").join(T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select(F.col("c_custkey").alias("customer"))


@query(sql("SELECT doc_id, 'missing' AS gap FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT vec_id, 'orphan' FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)"))
def g04_index_gaps(spark, sf_dir):
    return records.index_gaps(T.table(spark, sf_dir, "documents").select("doc_id"), T.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query(sql("SELECT memory_id FROM memories WHERE memory_id NOT IN (SELECT source_id FROM semantic UNION SELECT target_id FROM semantic)"))
def d12_islands(spark, sf_dir):
    return records.islands(T.memories(spark, sf_dir), T.semantic_edges(spark, sf_dir)).select("memory_id")


@query(sql("SELECT l_orderkey AS a, round(count(DISTINCT l_partkey) / count(*), 6) AS ratio FROM lineitem GROUP BY 1"))
def d19_distinct_ratio(spark, sf_dir):
    return T.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("a")).agg(F.round(F.countDistinct("l_partkey") / F.count("*"), 6).alias("ratio"))


@query(sql("""SELECT doc_id, round(-sum(n / total * log2(n / total)), 6) AS entropy FROM (SELECT doc_id, ch, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY doc_id)::DOUBLE AS total FROM
  (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY 1, 2) GROUP BY 1"""))
def d20_entropy(spark, sf_dir):
    chars = T.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "")).alias("ch")).where("ch <> ''").groupBy("doc_id", "ch").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("doc_id"))
    return chars.withColumn("part", p * F.log2(p)).groupBy("doc_id").agg(F.round(-F.sum("part"), 6).alias("entropy"))


@query(sql("""SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY gap, other) AS rank FROM (SELECT a.id, b.id AS other, abs(epoch(a.ts) - epoch(b.ts)) AS gap FROM messages a JOIN messages b ON a.id <> b.id AND abs(epoch(a.ts) - epoch(b.ts)) <= 7200) QUALIFY rank <= 8"""))
def c09_temporal_neighbors(spark, sf_dir):
    return records.temporal_neighbors(T.messages(spark, sf_dir), 2, 8)


@query(sql("""SELECT target, array_to_string(list_sort(list(DISTINCT doc_id)), ',') AS sources FROM (SELECT doc_id, unnest([doc_id % 100, doc_id % 77]) AS target FROM documents) GROUP BY 1"""))
def c05_back_index(spark, sf_dir):
    links = T.table(spark, sf_dir, "documents").select("doc_id", F.array(F.col("doc_id") % 100, F.col("doc_id") % 77).alias("targets"))
    return records.back_index(links, "doc_id", "targets").select("target", F.array_join(F.transform("sources", lambda x: x.cast("string")), ",").alias("sources"))


@query(sql("""SELECT id, conv_id, sum(new) OVER (PARTITION BY conv_id ORDER BY ts, id) AS session FROM (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY conv_id ORDER BY ts, id)) <= 1200 THEN 0 ELSE 1 END AS new FROM messages)"""))
def e03_dialogue_sessions(spark, sf_dir):
    return records.dialogue_sessions(T.messages(spark, sf_dir)).select("id", "conv_id", "session")


SESSIONS = "sessions AS (SELECT id, conv_id, kind, text, sum(new) OVER (PARTITION BY conv_id ORDER BY ts, id) AS session FROM (SELECT *, CASE WHEN epoch(ts) - epoch(lag(ts) OVER (PARTITION BY conv_id ORDER BY ts, id)) <= 1200 THEN 0 ELSE 1 END AS new FROM messages))"


@query(sql("""SELECT hit_id, substr(string_agg(kind || ': ' || text, chr(10) ORDER BY id), 1, 1000) AS window, count(*) AS lines FROM (SELECT h.id AS hit_id, s.* FROM sessions h JOIN sessions s ON h.conv_id = s.conv_id AND h.session = s.session
  WHERE h.kind = 'user' QUALIFY row_number() OVER (PARTITION BY h.id ORDER BY abs(s.id - h.id), s.id) <= 6) GROUP BY 1""", SESSIONS))
def i17_dialogue_windows(spark, sf_dir):
    m = T.messages(spark, sf_dir)
    hits = records.dialogue_sessions(m).where("kind = 'user'").select(F.col("id").alias("hit_id"), "conv_id", "session")
    return records.dialogue_windows(m, hits)


@query(sql("""SELECT 'pinned' AS section, memory_id FROM memories WHERE pinned UNION ALL SELECT * FROM (SELECT 'emotional', memory_id FROM memories WHERE emotion >= 0.7 ORDER BY ts DESC, memory_id LIMIT 5)
  UNION ALL SELECT * FROM (SELECT 'latest', memory_id FROM memories ORDER BY ts DESC, memory_id LIMIT 3) UNION ALL SELECT * FROM (SELECT 'old', memory_id FROM memories WHERE ts < TIMESTAMP '2024-01-01 04:00:00' ORDER BY md5(memory_id || '|3'), memory_id LIMIT 3)"""))
def f02_wakeup(spark, sf_dir):
    return records.wakeup(T.memories(spark, sf_dir))


@query(sql("""SELECT memory_id, round(activation, 6) AS activation FROM memories WHERE activation >= 2.0 AND memory_id NOT IN (SELECT 'd' || doc_id FROM labels WHERE toxic = 1) ORDER BY activation DESC, memory_id LIMIT 5"""))
def f01_hot(spark, sf_dir):
    out = T.table(spark, sf_dir, "labels").where("toxic = 1").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("memory_id"))
    hot = T.memories(spark, sf_dir).where("activation >= 2.0").join(out, "memory_id", "left_anti")
    return hot.orderBy(F.desc("activation"), "memory_id").limit(5).select("memory_id", F.round("activation", 6).alias("activation"))


@query(sql("SELECT query_id, doc_id, rank FROM (SELECT label AS query_id, vec_id AS doc_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS rank FROM vectors) WHERE rank <= 3"))
def f08_top_margin(spark, sf_dir):
    v = T.vectors(spark, sf_dir).select(F.col("label").alias("query_id"), F.col("vec_id").alias("doc_id"), F.col("embedding")[0].alias("first"))
    return search.top(v, "query_id", [F.desc("first"), F.asc("doc_id")], 3).select("query_id", "doc_id", "rank")


@query(sql("""SELECT a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.tags, b.tags)) / len(list_distinct(list_concat(a.tags, b.tags))), 6) AS jaccard FROM memories a JOIN memories b ON a.doc_id + 1 = b.doc_id"""))
def g01_jaccard(spark, sf_dir):
    m = T.memories(spark, sf_dir).select("doc_id", "tags")
    both = m.alias("a").join(m.alias("b"), F.col("a.doc_id") + 1 == F.col("b.doc_id"))
    return both.select(F.col("a.doc_id").alias("a"), F.col("b.doc_id").alias("b"), F.round(F.size(F.array_intersect("a.tags", "b.tags")) / F.size(F.array_union("a.tags", "b.tags")), 6).alias("jaccard"))


#: One character of a script without blanks for each letter, and the letters.
LATIN, HAN = "abcdefghijklmnopqrstuvwxyz", "".join(chr(0x4E00 + i) for i in range(26))
UNSPACED = f"""unspaced AS (SELECT id, conv_id, kind, ts, replace(translate(lower(text), '{LATIN}', '{HAN}'), ' ', '') AS text FROM messages),
runs AS (SELECT id, unnest(regexp_extract_all(text, '[{HAN[0]}-{HAN[-1]}]+')) AS run FROM unspaced)"""


def _unspaced(spark, sf_dir):
    """The messages as a script that puts no blanks between words."""
    return T.messages(spark, sf_dir).withColumn("text", F.replace(F.translate(F.lower("text"), LATIN, HAN), F.lit(" "), F.lit("")))


@query(sql("SELECT id, sum(greatest(length(run) - 1, 0))::BIGINT AS tokens, count(DISTINCT run)::BIGINT AS runs FROM runs GROUP BY id", UNSPACED))
def h01_unspaced_bigrams(spark, sf_dir):
    """Without a dictionary every run falls back to its bigrams."""
    segmented = segments.segmenter()
    m = _unspaced(spark, sf_dir).select("id", segmented("text").alias("tokens"), F.array_distinct(segments.runs(F.col("text"))).alias("runs")).where(F.size("runs") > 0)
    han = F.filter("tokens", lambda t: t.rlike(f"^[{HAN[0]}-{HAN[-1]}]+$"))
    return m.select("id", F.size(han).cast("long").alias("tokens"), F.size("runs").cast("long").alias("runs"))


@query(sql("""SELECT word, max(uses) AS uses FROM (SELECT g.word AS word, g.uses, min(g.uses * total / (l.uses * r.uses)) AS lift FROM (SELECT word, uses, unnest(range(1, length(word))) AS cut FROM grams WHERE length(word) > 1) g
  JOIN grams l ON l.word = substr(g.word, 1, cut) JOIN grams r ON r.word = substr(g.word, cut + 1), (SELECT sum(uses) AS total FROM grams WHERE length(word) = 1) GROUP BY 1, 2) WHERE lift >= 8 GROUP BY 1""", UNSPACED,
           "grams AS (SELECT substr(run, i::INT, n::INT) AS word, count(*) AS uses FROM runs, range(1, 5) s(n), unnest(range(1, length(run) - n + 2)) t(i) GROUP BY 1 HAVING count(*) >= 5 OR length(word) = 1)"))
def h01_learned_words(spark, sf_dir):
    return segments.learned(_unspaced(spark, sf_dir))
