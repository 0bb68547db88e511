"""Queries of single actions, each against its own SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, signals, text
from ..operators import actions, graph, lifecycle, proposals
from ..sources import tables as T
from .oracle import sql
from .registry import query
from .search import TOKENS, _text_rank


def _name(n):
    return F.concat(F.lit("d"), n.cast("string"))


def _notes(spark, sf_dir):
    """Labels as notes on their records; some name a record that is not there."""
    n = F.col("doc_id")
    return T.table(spark, sf_dir, "labels").select(
        F.concat(F.lit("n"), n.cast("string")).alias("note_id"), _name(F.when(n % 4 == 0, -n - 1).otherwise(n)).alias("memory_id"), F.array(F.lit("ai")).alias("read_by"), "toxic"
    )


NOTES = "notes AS (SELECT 'n' || doc_id AS note_id, 'd' || CASE WHEN doc_id % 4 = 0 THEN -doc_id - 1 ELSE doc_id END AS memory_id, ['ai'] AS read_by, toxic FROM labels)"


@query(sql("SELECT event_id, event_type FROM events UNION ALL SELECT -event_id, 'replayed' FROM events WHERE event_type = 'error'"))
def l06_log_event(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select("event_id", "event_type")
    return actions.appended(e, e.where("event_type = 'error'").select((-F.col("event_id")).alias("event_id"), F.lit("replayed").alias("event_type")))


@query(sql("SELECT note_id, memory_id FROM notes WHERE memory_id IN (SELECT memory_id FROM memories)", NOTES))
def l07_annotate(spark, sf_dir):
    n = _notes(spark, sf_dir).select("note_id", "memory_id")
    return actions.appended_to_known(n.where("false"), n, T.memories(spark, sf_dir), "memory_id")


@query(sql("SELECT source_id, target_id, role FROM semantic WHERE NOT (role = 'updates' AND substr(source_id, 2)::BIGINT % 2 = 0)"))
def l26_remove_update_edge(spark, sf_dir):
    s = T.semantic_edges(spark, sf_dir).select("source_id", "target_id", "role")
    gone = s.where("role = 'updates'").where(F.substring("source_id", 2, 20).cast("long") % 2 == 0)
    return actions.without_edges(s, gone, "source_id", "target_id", "role")


@query(sql("SELECT note_id, 'first' AS author FROM notes WHERE memory_id IN (SELECT memory_id FROM memories WHERE level = 'raw') UNION ALL SELECT 'kept', 'old'", NOTES))
def l27_insert_comment(spark, sf_dir):
    old = spark.range(1).select(F.lit("kept").alias("note_id"), F.lit("old").alias("author"), F.lit(None).cast("string").alias("memory_id"))
    new = _notes(spark, sf_dir).select("note_id", F.lit("first").alias("author"), "memory_id")
    return actions.appended_to_known(old, new, T.memories(spark, sf_dir).where("level = 'raw'"), "memory_id").select("note_id", "author")


@query(sql("SELECT note_id, CASE WHEN toxic = 1 THEN 'ai+user' ELSE 'ai' END AS readers FROM notes", NOTES))
def l28_mark_comments_read(spark, sf_dir):
    n = _notes(spark, sf_dir)
    once = actions.marked_read(n, n.where("toxic = 1"), "note_id", "user")
    return actions.marked_read(once, n.where("toxic = 1"), "note_id", "user").select("note_id", F.array_join("read_by", "+").alias("readers"))


@query(sql("""SELECT 'up_' || substr(sha256('level|' || memory_id || '|cognition'), 1, 16) AS id, memory_id, level, coalesce(n, 0) AS edges FROM memories LEFT JOIN (
  SELECT memory_id, count(*) AS n FROM (SELECT source_id AS memory_id FROM flow UNION ALL SELECT target_id FROM flow UNION ALL SELECT source_id FROM semantic UNION ALL SELECT target_id FROM semantic) GROUP BY 1) USING (memory_id) WHERE activation >= 4 AND level <> 'cognition'"""))
def l43_propose_level(spark, sf_dir):
    m = T.memories(spark, sf_dir)
    asked = m.where("activation >= 4").select("memory_id", F.lit("cognition").alias("new_level"))
    return actions.level_proposals(asked, m, T.flow_edges(spark, sf_dir), T.semantic_edges(spark, sf_dir)).select("id", "memory_id", "level", "edges")


@query(sql("""SELECT 'up_' || substr(sha256('evokes|' || f.source_id || '|' || f.target_id), 1, 16) AS id, f.source_id, f.target_id FROM flow f JOIN memories s ON s.memory_id = f.source_id JOIN memories t ON t.memory_id = f.target_id
  WHERE s.collection <> 'library' AND t.collection = 'library' AND NOT EXISTS (FROM semantic x WHERE x.source_id = f.source_id AND x.target_id = f.target_id)"""))
def l44_propose_evokes(spark, sf_dir):
    return actions.evokes_requests(T.flow_edges(spark, sf_dir).select("source_id", "target_id"), T.memories(spark, sf_dir), T.semantic_edges(spark, sf_dir))


@query(sql("SELECT role, role = 'updates' AS reviewed, count(*) AS n FROM semantic GROUP BY ALL"))
def l54_review_routing(spark, sf_dir):
    review, rest = actions.routed_to_review(T.semantic_edges(spark, sf_dir), ("updates",))
    return review.withColumn("reviewed", F.lit(True)).unionByName(rest.withColumn("reviewed", F.lit(False))).groupBy("role", "reviewed").agg(F.count("*").alias("n"))


@query(sql("SELECT memory_id, CASE WHEN doc_id % 3 = 0 THEN 'state:current+domain:home+kind:note' ELSE array_to_string(tags, '+') END AS tags FROM memories"))
def l65_tags_written_back(spark, sf_dir):
    """A tagger's verdicts: good ones, ones with an unknown tag, ones too short."""
    m, n = T.memories(spark, sf_dir), F.col("doc_id")
    words = F.array(*[F.lit(t) for t in ("state:current", "domain:home", "kind:note")])
    said = F.when(n % 3 == 0, words).when(n % 3 == 1, F.array_append(words, F.lit("mood:odd"))).otherwise(F.slice(words, 1, 2))
    return actions.tags_written_back(m, m.select("memory_id", said.alias("tags")), words).select("memory_id", F.array_join("tags", "+").alias("tags"))


def _queue(spark, sf_dir):
    """Chat messages as queue items; those of odd turns are consumed."""
    return T.messages(spark, sf_dir).select("id", F.when(F.col("id") % 2 == 1, F.col("ts")).alias("consumed_at"))


QUEUE = "queue AS (SELECT id, CASE WHEN id % 2 = 1 THEN ts END AS consumed_at FROM messages)"


@query(sql("SELECT count(*) AS items, count(*) FILTER (consumed_at IS NULL) AS claimed, 0 AS pending FROM queue", QUEUE))
def k10_consume_queue(spark, sf_dir):
    after, taken = actions.claimed(_queue(spark, sf_dir), F.expr("timestamp_ntz'2024-02-01 00:00:00'"))
    return after.agg(F.count("*").alias("items"), F.count_if(F.col("consumed_at").isNull()).cast("int").alias("pending")).crossJoin(taken.agg(F.count("*").alias("claimed"))).select("items", "claimed", "pending")


@query(sql("SELECT id FROM queue UNION ALL SELECT -conv_id - 1 FROM (SELECT DISTINCT conv_id FROM messages)", QUEUE))
def k11_insert_queue_item(spark, sf_dir):
    new = T.messages(spark, sf_dir).select((-F.col("conv_id") - 1).alias("id")).distinct()
    return actions.appended(_queue(spark, sf_dir), new).select("id")


@query(sql("SELECT id FROM queue WHERE consumed_at IS NULL OR consumed_at >= TIMESTAMP '2024-01-09 00:00:00' - INTERVAL 7 DAY", QUEUE))
def k12_sweep_queue(spark, sf_dir):
    return actions.swept(_queue(spark, sf_dir), F.expr("timestamp_ntz'2024-01-09 00:00:00'")).select("id")


@query(sql("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND ts > (SELECT max(ts) FROM events) - INTERVAL 300 SECOND"))
def k24_cached(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    now = e.agg(F.max("ts").cast("string").alias("now")).first()["now"]
    return actions.still_cached(e, "user_id", "ts", F.lit(now).cast("timestamp_ntz"), 300).select("user_id", "event_id")


@query(sql("SELECT memory_id, concat_ws(chr(10), left(text, 10), CASE WHEN doc_id % 2 = 0 THEN level END, left(text, 40)) AS document FROM memories"))
def h51_index_document(spark, sf_dir):
    m = T.memories(spark, sf_dir)
    insight = F.when(F.col("doc_id") % 2 == 0, F.col("level")).otherwise("")
    return m.select("memory_id", actions.index_document(F.substring("text", 1, 10), insight, F.substring("text", 1, 40)).alias("document"))


@query(sql("SELECT memory_id, CASE WHEN trim(left(text, 5)) = '' THEN 'b:b' ELSE left(text, 5) || ':' || level || ',b:b' END AS keys FROM memories WHERE text IS NOT NULL"))
def h56_clean_keys(spark, sf_dir):
    m = T.memories(spark, sf_dir).where("text IS NOT NULL")
    pair = lambda k, q: F.struct(k.alias("key"), q.alias("quote"))
    one, two = pair(F.substring("text", 1, 5), F.col("level")), pair(F.lit("b"), F.lit("b"))
    keys = actions.clean_keys(F.array(one, pair(F.lit(" "), F.lit("x")), one, two, pair(F.lit("y"), F.lit("")), two))
    return m.select("memory_id", F.array_join(F.transform(keys, lambda k: F.concat_ws(":", k["key"], k["quote"])), ",").alias("keys"))


@query(sql("SELECT query_id, text || ' anna friend' AS rewritten, right(regexp_replace(trim(text), '[\\s?？!.]*$', ''), 24) AS surface FROM queries"))
def h101_person_rewrite(spark, sf_dir):
    q = T.search_queries(spark, sf_dir)
    return q.select("query_id", actions.person_rewrite(F.col("text"), F.array(F.lit("anna"), F.lit("friend"), F.lit("anna"))).alias("rewritten"), actions.identity_surface(F.col("text")).alias("surface"))


@query(sql("SELECT id, right(CASE kind WHEN 'user' THEN 'Anna Maria from the old house' ELSE 'Bert' END, 24) AS surface FROM messages"))
def h102_identity_surface(spark, sf_dir):
    asked = F.when(F.col("kind") == "user", "Anna Maria from the old house is who?? ").otherwise(" Bert？")
    return T.messages(spark, sf_dir).select("id", actions.identity_surface(asked).alias("surface"))


@query(sql("""SELECT m.memory_id, m.tags[1] || ' ' || left(m.text, 20) || ' ' || m.text || ' ' || coalesce(u.text, '') || ' ' || ' ' || coalesce(m.source, '') AS body
  FROM memories m LEFT JOIN (SELECT doc_id + 5 AS doc_id, text FROM memories) u USING (doc_id)"""))
def h106_candidate_body(spark, sf_dir):
    """The matched text is that of the record five before."""
    m = T.memories(spark, sf_dir)
    matched = m.select((F.col("doc_id") + 5).alias("doc_id"), F.col("text").alias("matched"))
    both = m.join(matched, "doc_id", "left")
    return both.select("memory_id", actions.searched_body(F.get("tags", F.lit(0)), F.substring("text", 1, 20), F.col("text"), F.col("matched"), F.lit(None).cast("string"), F.col("source")).alias("body"))


@query(sql("SELECT memory_id, CASE WHEN doc_id % 2 = 0 THEN left(text, 20) ELSE left(text, 60) END AS body FROM memories WHERE length(text) > 20"))
def o62_candidate_body(spark, sf_dir):
    m = T.memories(spark, sf_dir).where(F.length("text") > 20)
    snippet = F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 20)).otherwise("")
    return m.select("memory_id", actions.candidate_body(snippet, F.substring("text", 1, 60)).alias("body"))


@query(sql("SELECT event_id, CASE event_type WHEN 'click' THEN 'background' WHEN 'view' THEN 'companion' ELSE 'association' END AS role, event_type <> 'click' AS may_lead FROM events"))
def h107_association_metadata(spark, sf_dir):
    mode = F.when(F.col("event_type") == "click", "evidence").when(F.col("event_type") == "view", "support").otherwise("chat")
    return T.table(spark, sf_dir, "events").select("event_id", actions.association_metadata(mode).alias("m")).select("event_id", "m.*")


@query(sql("SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'quotation' WHEN event_type = 'click' THEN 'direct' ELSE 'context' END AS role FROM events"))
def h108_main_metadata(spark, sf_dir):
    source, mode = F.when(F.col("user_id") % 2 == 0, "cold").otherwise("anchor"), F.when(F.col("event_type") == "click", "evidence").otherwise("chat")
    return T.table(spark, sf_dir, "events").select("event_id", actions.main_metadata(source, mode).alias("role"))


@query(sql("SELECT memory_id, CASE WHEN doc_id % 7 IN (1, 2) THEN '[past] ' ELSE '' END || 'Here it was. The ' || level || ' word is said.' AS shown FROM memories"))
def h89_shown_memory(spark, sf_dir):
    m = T.memories(spark, sf_dir)
    body = F.concat(F.lit("Too far off. Here it was. The "), F.col("level"), F.lit(" word is said."))
    return m.select("memory_id", actions.shown_memory(body, F.concat("level", F.lit(" word")), signals.temporal_label(F.col("tags"), F.lit(False))).alias("shown"))


@query(sql("""SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-13 15:00:00' THEN 'day' ELSE 'week' END AS part FROM events WHERE ts >= TIMESTAMP '2024-01-06 15:00:00' AND ts < TIMESTAMP '2024-01-14 15:00:00' AND (ts >= TIMESTAMP '2024-01-13 15:00:00' OR event_type = 'signup')"""))
def n07_daily_recap(spark, sf_dir):
    """A Sunday: its own events, and the signups of the week before."""
    return actions.daily_recap(T.table(spark, sf_dir, "events"), "2024-01-14", F.col("event_type") == "signup").select("event_id", "part")


@query(sql("SELECT case_id, belief_id FROM cases UNION ALL SELECT 'new-' || source, 'b-' || source FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)"))
def n09_belief_add_case(spark, sf_dir):
    b, c = T.beliefs(spark, sf_dir), T.belief_cases(spark, sf_dir).select("case_id", "belief_id")
    new = b.select(F.concat(F.lit("new-"), F.substring("belief_id", 3, 99)).alias("case_id"), "belief_id")
    return actions.appended_to_known(c, new.unionByName(new.select(F.lit("lost").alias("case_id"), F.lit("b-nowhere").alias("belief_id"))), b, "belief_id")


@query(sql("SELECT query_id, memory_id, round(1 - max(score), 6) AS distance FROM (SELECT query_id, 'd' || doc_id AS memory_id, round(1.0 / rank, 6) AS score FROM text_rank UNION ALL SELECT query_id, 'd' || doc_id, 0.4 FROM text_rank WHERE rank <= 3) GROUP BY 1, 2", TOKENS))
def i20_merged_results(spark, sf_dir):
    r = _text_rank(spark, sf_dir)
    name = _name(F.col("doc_id")).alias("memory_id")
    return actions.merged_results(r.select("query_id", name, F.round(1.0 / F.col("rank"), 6).alias("score")), r.where("rank <= 3").select("query_id", name, F.lit(0.4).alias("score")))


@query(sql("""SELECT query_id, memory_id, CASE WHEN why IS NULL AND row_number() OVER (PARTITION BY query_id, why IS NULL ORDER BY score DESC, memory_id) > 1 THEN 'not first' ELSE why END AS reason FROM (
  SELECT query_id, 'd' || doc_id AS memory_id, 1.0 / rank AS score, CASE WHEN doc_id % 97 = 0 THEN 'excluded' WHEN doc_id % 3 = 0 THEN 'no bridge' WHEN 1.0 / rank < 0.3 THEN 'weak' END AS why FROM text_rank)""", TOKENS))
def i26_fetched_association(spark, sf_dir):
    c = _text_rank(spark, sf_dir).select("query_id", _name(F.col("doc_id")).alias("memory_id"), (1.0 / F.col("rank")).alias("score"), F.when(F.col("doc_id") % 3 != 0, F.lit("d1")).alias("bridge"))
    return actions.fetched_association(c, T.memories(spark, sf_dir).where("pinned"))


@query(sql("""SELECT query_id, canonical, canonical || ': ' || last AS line FROM (SELECT DISTINCT query_id, source AS canonical FROM text_rank JOIN memories USING (doc_id) WHERE source IS NOT NULL QUALIFY dense_rank() OVER (PARTITION BY query_id ORDER BY source) <= 3)
  JOIN (SELECT source AS canonical, arg_max(memory_id, ts) AS last FROM memories GROUP BY 1) USING (canonical)""", TOKENS))
def i27_person_lines(spark, sf_dir):
    m = T.memories(spark, sf_dir).where("source IS NOT NULL").withColumnRenamed("source", "canonical")
    return actions.person_lines(_text_rank(spark, sf_dir).join(m, "doc_id").select("query_id", "canonical"), m)


@query(sql("""SELECT query_id, 'd' || doc_id AS memory_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, 'd' || doc_id) AS place FROM text_rank JOIN memories USING (doc_id) WHERE contains(lower(text), 'an') QUALIFY place <= 2""", TOKENS))
def i28_person_seeds(spark, sf_dir):
    # The hits are ten a passage; the texts stay where they are read.
    r = F.broadcast(_text_rank(spark, sf_dir)).join(T.memories(spark, sf_dir).select("doc_id", "memory_id", "text"), "doc_id").select("query_id", "memory_id", "rank", "text")
    return actions.person_seeds(r, T.search_queries(spark, sf_dir).select("query_id", F.lit("AN").alias("alias")))


@query(sql("SELECT source_id, target_id, greatest(s.ts, t.ts) AS created_at FROM flow JOIN memories s ON s.memory_id = source_id JOIN memories t ON t.memory_id = target_id"))
def o68_link_times(spark, sf_dir):
    return actions.link_times(T.flow_edges(spark, sf_dir).select("source_id", "target_id"), T.memories(spark, sf_dir))


# --- rows of operators that other queries use only in passing ----------------
@query(sql("SELECT source_id, target_id, 'flow' AS family FROM flow UNION ALL SELECT source_id, target_id, 'semantic' FROM semantic"))
def a11_edge_rows(spark, sf_dir):
    part = lambda e, family: e.select("source_id", "target_id", F.lit(family).alias("family"))
    return part(T.flow_edges(spark, sf_dir), "flow").unionByName(part(T.semantic_edges(spark, sf_dir), "semantic"))


@query(sql("SELECT memory_id, ts, level, vec_id IS NOT NULL AS embedded FROM memories LEFT JOIN vectors USING (memory_id) WHERE level = 'raw' AND collection <> 'library'"))
def a07_raw_records(spark, sf_dir):
    m, v = T.memories(spark, sf_dir), T.vectors(spark, sf_dir).select("memory_id", F.lit(True).alias("embedded"))
    return m.where("level = 'raw' AND collection <> 'library'").join(v, "memory_id", "left").select("memory_id", "ts", "level", F.coalesce("embedded", F.lit(False)).alias("embedded"))


@query(sql("SELECT memory_id, round(embedding[1], 6) AS first, len(embedding)::INT AS dims FROM vectors WHERE memory_id IN (SELECT memory_id FROM memories WHERE pinned)"))
def a09_pinned_vectors(spark, sf_dir):
    v = T.vectors(spark, sf_dir).join(T.memories(spark, sf_dir).where("pinned").select("memory_id"), "memory_id", "left_semi")
    return v.select("memory_id", F.round(F.col("embedding")[0], 6).alias("first"), F.size("embedding").alias("dims"))


@query(sql("SELECT memory_id, activation FROM (SELECT memory_id, round(activation, 6) AS activation FROM memories)"))
def b15_activation(spark, sf_dir):
    return T.memories(spark, sf_dir).select("memory_id", F.round("activation", 6).alias("activation"))


@query(sql("SELECT memory_id, usage_count FROM memories WHERE usage_count > 0"))
def b16_citations(spark, sf_dir):
    return T.memories(spark, sf_dir).where("usage_count > 0").select("memory_id", "usage_count")


@query(sql("SELECT memory_id, round(emotion, 6) AS emotion FROM memories WHERE emotion <> 0.5"))
def b17_emotion(spark, sf_dir):
    return T.memories(spark, sf_dir).where("emotion <> 0.5").select("memory_id", F.round("emotion", 6).alias("emotion"))


@query(sql("SELECT memory_id, tier FROM memories WHERE tier <> 'short'"))
def b18_tier(spark, sf_dir):
    return T.memories(spark, sf_dir).where("tier <> 'short'").select("memory_id", "tier")


@query(sql("SELECT memory_id FROM memories WHERE activation >= 2"))
def b14_hot_ids(spark, sf_dir):
    return T.memories(spark, sf_dir).where("activation >= 2").select("memory_id")


@query(sql("SELECT a, b, round(coalesce(f.weight, 0), 6) AS there, round(coalesce(g.weight, 0), 6) AS back FROM (SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM flow) LEFT JOIN flow f ON f.source_id = a AND f.target_id = b LEFT JOIN flow g ON g.source_id = b AND g.target_id = a"))
def b19_edge_weights(spark, sf_dir):
    e = T.flow_edges(spark, sf_dir).withColumns({"a": F.least("source_id", "target_id"), "b": F.greatest("source_id", "target_id")})
    forth = F.col("source_id") == F.col("a")
    best = lambda where: F.round(F.coalesce(F.max(F.when(where, F.col("weight"))), F.lit(0.0)), 6)
    return e.groupBy("a", "b").agg(best(forth).alias("there"), best(~forth).alias("back"))


@query(sql("SELECT memory_id, ts FROM memories WHERE level = 'raw' AND ts >= (SELECT max(ts) FROM memories) - INTERVAL 5 HOUR"))
def b22_recent_raw(spark, sf_dir):
    m = T.memories(spark, sf_dir).select("memory_id", "ts", "level")
    last = m.agg(F.max("ts").cast("string").alias("last")).first()["last"]
    return m.where("level = 'raw'").where(F.col("ts") >= F.lit(last).cast("timestamp_ntz") - F.expr("interval 5 hours")).select("memory_id", "ts")


@query(sql("SELECT source_id, target_id, reason FROM (SELECT 'd' || doc_id AS source_id, 'd' || doc_id AS target_id, 'self' AS reason FROM documents)"))
def b26_self_edges(spark, sf_dir):
    """No record may support itself: every such edge is refused."""
    m = T.memories(spark, sf_dir)
    e = m.select(F.col("memory_id").alias("source_id"), F.col("memory_id").alias("target_id"), F.lit("SUPPORTED_BY").alias("role"))
    return graph.typed_violations(e, m).select("source_id", "target_id", F.lit("self").alias("reason")).distinct()


@query(sql("SELECT memory_id, array_to_string(list_distinct(list_filter(list_transform(string_split(x, ','), lambda t: trim(t)), lambda t: t <> '')).list_sort(), '+') AS parts FROM (SELECT memory_id, ' ' || level || ', ,' || tier || ',' || level AS x FROM memories)"))
def g05_listed_ids(spark, sf_dir):
    x = F.concat(F.lit(" "), "level", F.lit(", ,"), "tier", F.lit(","), "level")
    return T.memories(spark, sf_dir).select("memory_id", F.array_join(F.array_sort(text.listed(x)), "+").alias("parts"))


@query(sql("SELECT id FROM (SELECT 'p' || doc_id AS id FROM documents WHERE doc_id % 2 = 0) UNION SELECT 'p' || doc_id FROM documents WHERE doc_id % 3 = 0"))
def g06_enqueued(spark, sf_dir):
    ids = T.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("id"))
    new = ids.where("doc_id % 3 = 0").select("id")
    return proposals.enqueued(ids.where("doc_id % 2 = 0").select("id"), new.unionByName(new))


@query(sql("SELECT a, b, round(CASE WHEN b = 0 THEN 0 ELSE 100.0 * a / b END, 1) AS percent FROM (SELECT DISTINCT l_linenumber AS a, l_quantity::INT % 9 AS b FROM lineitem)"))
def d17_percent(spark, sf_dir):
    rows = T.table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("a"), (F.col("l_quantity").cast("int") % 9).alias("b")).distinct()
    return rows.select("a", "b", signals.percent(F.col("a"), F.col("b")).alias("percent"))


@query(sql("SELECT count(*) AS n, count(DISTINCT source) AS sources FROM memories"))
def d03_count(spark, sf_dir):
    return T.memories(spark, sf_dir).agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"))


@query(sql("SELECT memory_id, CASE tier WHEN 'core' THEN 'long' ELSE tier END AS tier FROM memories"))
def l10_set_tier(spark, sf_dir):
    m = T.memories(spark, sf_dir)
    return lifecycle.updated(m, m.where("tier = 'core'").select("memory_id", F.lit("long").alias("value")), "memory_id", "tier").select("memory_id", "tier")


@query(sql("SELECT memory_id, CASE WHEN doc_id % 4 = 0 THEN 'raw' ELSE level END AS level FROM memories"))
def l09_set_level(spark, sf_dir):
    m = T.memories(spark, sf_dir)
    return lifecycle.updated(m, m.where("doc_id % 4 = 0").select("memory_id", F.lit("raw").alias("value")), "memory_id", "level").select("memory_id", "level")


@query(sql("SELECT memory_id, round(CASE WHEN doc_id % 5 = 0 THEN 0.25 ELSE emotion END, 6) AS emotion FROM memories"))
def l11_set_emotion(spark, sf_dir):
    m = T.memories(spark, sf_dir)
    return lifecycle.updated(m, m.where("doc_id % 5 = 0").select("memory_id", F.lit(0.25).alias("value")), "memory_id", "emotion").select("memory_id", F.round("emotion", 6).alias("emotion"))


@query(sql("SELECT memory_id, doc_id % 10 = 0 OR doc_id % 97 = 0 AS pinned FROM memories"))
def l14_pin(spark, sf_dir):
    m = T.memories(spark, sf_dir)
    return lifecycle.updated(m, m.where("doc_id % 10 = 0").select("memory_id", F.lit(True).alias("value")), "memory_id", "pinned").select("memory_id", "pinned")


@query(sql("SELECT memory_id, doc_id % 97 = 0 AND doc_id % 2 = 1 AS pinned FROM memories"))
def l15_unpin(spark, sf_dir):
    m = T.memories(spark, sf_dir)
    return lifecycle.updated(m, m.where("pinned AND doc_id % 2 = 0").select("memory_id", F.lit(False).alias("value")), "memory_id", "pinned").select("memory_id", "pinned")


@query(sql("SELECT memory_id, CASE tier WHEN 'short' THEN 'long' ELSE tier END AS tier FROM memories"))
def l56_repaired_tiers(spark, sf_dir):
    m = T.memories(spark, sf_dir).withColumn("tier", F.when(F.col("tier") == "short", "brief").otherwise(F.col("tier")))
    return lifecycle.tiers_repaired(m).select("memory_id", "tier")


@query(sql("SELECT query_id, substr(sha256(text || '|ctx|' || (query_id + 5680000)::VARCHAR), 1, 24) AS id FROM queries"))
def h90_heat_event_ids(spark, sf_dir):
    q = T.search_queries(spark, sf_dir)
    at = F.timestamp_seconds((F.col("query_id") + 5_680_000) * 300 + 17)
    return q.select("query_id", hashing.heat_event_id(F.col("text"), F.lit("ctx"), at).alias("id"))


@query(sql("SELECT p_partkey AS id, CASE WHEN n >= 1073741824 THEN printf('%.1f GB', n / 1073741824) WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576) WHEN n >= 1024 THEN printf('%.1f KB', n / 1024) ELSE printf('%d B', n) END AS size FROM (SELECT p_partkey, (p_partkey * p_partkey * 37)::BIGINT AS n FROM part)"))
def h26_human_bytes(spark, sf_dir):
    k = F.col("p_partkey")
    return T.table(spark, sf_dir, "part").select(k.alias("id"), signals.human_bytes(k * k * 37).alias("size"))


@query(sql("SELECT memory_id, strpos(text, left(text, 12)) - 1 AS start, strpos(text, left(text, 12)) - 1 + length(left(text, 12)) AS stop FROM memories WHERE length(trim(text)) > 12"))
def h53_located_spans(spark, sf_dir):
    m = T.memories(spark, sf_dir).where(F.length(F.trim("text")) > 12)
    place = text.span(F.col("text"), F.substring("text", 1, 12))
    return m.select("memory_id", place["start"].cast("long").alias("start"), place["end"].cast("long").alias("stop"))


@query(sql("SELECT memory_id, len(b) = 0 OR len(list_intersect(a, b)) / least(len(a), len(b)) < 0.72 AS independent FROM (SELECT memory_id, list_distinct(list_transform(range(1, length(x)), lambda i: substr(x, i, 2))) AS a, list_distinct(list_transform(range(1, length(y)), lambda i: substr(y, i, 2))) AS b FROM (SELECT memory_id, left(text, 40) AS x, substr(text, 11, 40) AS y FROM memories WHERE length(text) > 60))"))
def h84_independent(spark, sf_dir):
    m = T.memories(spark, sf_dir).where(F.length("text") > 60)
    return m.select("memory_id", text.independent(F.substring("text", 1, 40), F.substring("text", 11, 40)).alias("independent"))
