"""Further queries: small scalar rows, gates, groups and bookkeeping."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import router, text
from ..operators import graph, greedy, lifecycle, proposals, ranking, reports, search
from ..sources import tables as T
from .oracle import sql
from .registry import query
from .search import ASKED, RECALL_NOW, TOKENS, VECTOR_RANK, _text_rank, _vector_rank, diffusion_sql


@query(sql(r"""SELECT item_id AS query_id, len(regexp_extract_all(text, '[.!?;。！？；\n]')) > 0 AS split FROM benchmark"""))
def h57_topics_split(spark, sf_dir):
    q = T.search_queries(spark, sf_dir)
    return q.select("query_id", F.col("text").rlike(r"[.!?;。！？；\n]").alias("split"))


@query()
def h57_topics(spark, sf_dir):
    q = T.search_queries(spark, sf_dir)
    t = F.col("text")
    return q.select(
        "query_id", text.topics(t).alias("topics"), text.unwrapped(t).alias("bare"), text.unquoted(t).alias("unquoted"), text.contextual(t, F.lit("before that")).alias("contextual"),
        text.context_terms(t).alias("terms"), text.variants(t, F.lit("context")).alias("variants"), text.expanded(t, {r"(?i)\bthe\b": "anchor"}).alias("expanded"),
    )


@query(sql("SELECT doc_id, source AS concept FROM memories WHERE source IS NOT NULL"))
def h69_concepts(spark, sf_dir):
    m = T.memories(spark, sf_dir).where("source IS NOT NULL")
    return m.select("doc_id", text.concept(F.lit(""), F.col("tags"), F.col("text")).alias("concept"))


@query(sql("SELECT event_id, array_to_string(list_sort(list_filter([CASE WHEN value > 50 THEN 'anchor' END, CASE WHEN event_type = 'click' THEN 'cold' END], lambda x: x IS NOT NULL)), '+') AS lanes, event_type IN ('click', 'purchase') AS found FROM events"))
def h105_lanes(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    lanes = F.create_map(F.lit("anchor"), F.coalesce(F.col("value") > 50, F.lit(False)), F.lit("cold"), F.col("event_type") == "click")
    contract = router.answer_contract(F.array(F.lit("click"), F.lit("purchase")), F.array("event_type"))
    return e.select("event_id", F.array_join(router.allowed_lanes(lanes), "+").alias("lanes"), contract["direct_evidence_found"].alias("found"))


@query(sql("SELECT event_id, date_diff('day', ts::DATE, DATE '2024-03-01') AS days FROM events"))
def h91_day_counter(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    days = reports.day_differences(F.create_map(F.lit("d"), F.date_format("ts", "yyyy-MM-dd")), F.lit("2024-03-01").cast("date"))
    return e.select("event_id", days["d"].alias("days"))


SEEDS = "(SELECT doc_id % 3 AS query_id, memory_id, 1.0::DOUBLE AS similarity FROM memories WHERE pinned)"


@query(sql("SELECT query_id, memory_id, round(mass, 9) AS mass, depth FROM diffused", diffusion_sql(SEEDS, RECALL_NOW)))
def j12_diffusion(spark, sf_dir):
    seeds = T.memories(spark, sf_dir).where("pinned").select((F.col("doc_id") % 3).alias("query_id"), "memory_id", F.lit(1.0).alias("similarity"))
    return search.diffused(seeds, T.flow_edges(spark, sf_dir), RECALL_NOW).withColumn("mass", F.round("mass", 9))


@query(sql("""SELECT target_id, source_id AS bridge, activation, weight FROM (SELECT f.target_id, f.source_id, m.activation, f.weight FROM flow f JOIN memories s ON s.memory_id = f.source_id AND s.pinned JOIN memories m ON m.memory_id = f.target_id
  WHERE NOT m.pinned AND m.activation >= 2 QUALIFY row_number() OVER (PARTITION BY f.target_id ORDER BY f.weight DESC, f.source_id) = 1) ORDER BY activation DESC, weight DESC, md5(target_id || '|1'), target_id LIMIT 20"""))
def c03_hot_neighbors(spark, sf_dir):
    m = T.memories(spark, sf_dir)
    return graph.hot_neighbors(m, T.flow_edges(spark, sf_dir), m.where("pinned").select("memory_id"), limit=20)


GROUPS = """groups AS (SELECT min(vec_id) AS group_id, list(memory_id) AS members FROM (SELECT label, memory_id, vec_id, least((row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 5, greatest(0, (count(*) OVER (PARTITION BY label) - 2) // 5)) AS run FROM vectors) GROUP BY label, run)"""


def _groups(spark, sf_dir):
    """Consecutive runs of five vectors of a label, named by their first; a
    single one that is left over joins the run before it."""
    v = T.vectors(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = F.count("*").over(Window.partitionBy("label"))
    last = F.greatest(F.lit(0), F.floor((rows - 2) / 5))
    runs = v.select("label", "vec_id", "memory_id", F.least(F.floor(place / 5), last).alias("run"))
    return runs.groupBy("label", "run").agg(F.min("vec_id").alias("group_id"), F.collect_list("memory_id").alias("members")).select("group_id", "members")


@query(sql("""SELECT group_id, round(min(c), 6) AS least, round(avg(c), 6) AS mean, count(*) AS pairs FROM (SELECT group_id, list_cosine_similarity(x.embedding, y.embedding) AS c FROM
  (SELECT group_id, unnest(members) AS a FROM groups) p JOIN (SELECT group_id, unnest(members) AS b FROM groups) q USING (group_id) JOIN vectors x ON x.memory_id = a JOIN vectors y ON y.memory_id = b WHERE a < b) GROUP BY 1""", GROUPS))
def j19_group_signals(spark, sf_dir):
    return proposals.group_signals(_groups(spark, sf_dir), T.vectors(spark, sf_dir))


@query(sql("""SELECT group_id, records, span_days, CASE WHEN group_id % 2 = 0 THEN 'pending' END AS status FROM (SELECT group_id, count(*)::INT AS records, date_diff('day', min(ts)::DATE, max(ts)::DATE) AS span_days FROM (SELECT group_id, unnest(members) AS memory_id FROM groups) JOIN memories USING (memory_id) GROUP BY 1)""", GROUPS))
def n20_group_payloads(spark, sf_dir):
    g = _groups(spark, sf_dir)
    prior = g.select("group_id", F.lit("pending").alias("status")).where("group_id % 2 = 0")
    return reports.group_payloads(g, T.memories(spark, sf_dir), prior).select("group_id", F.size("records").alias("records"), "span_days", "status")


def _order_groups(spark, sf_dir):
    """Records on the lines of one order form a group; its channels are its lines."""
    n = T.table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    member = F.concat(F.lit("d"), (F.col("l_partkey") % F.col("n")).cast("string"))
    lines = T.table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(n))
    groups = lines.groupBy(F.col("l_orderkey").alias("group_id")).agg(
        F.collect_set(member).alias("members"), F.max("l_linenumber").alias("channels"), F.min("l_quantity").alias("least"), F.count("*").alias("lines"))
    return groups.where("lines BETWEEN 2 AND 6").drop("lines")


@query()
def e05_limited_groups(spark, sf_dir):
    return greedy.limited_groups(_order_groups(spark, sf_dir))


@query(sql("SELECT query_id, 'd' || doc_id AS memory_id, round(1.0 / rank, 6) AS score FROM text_rank WHERE 1.0 / rank >= 0.35 AND doc_id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(1.0 / rank, 6) DESC, 'd' || doc_id) = 1", TOKENS))
def i24_association(spark, sf_dir):
    c = _text_rank(spark, sf_dir).select("query_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("memory_id"), F.round(1.0 / F.col("rank"), 6).alias("score"))
    cooled = T.memories(spark, sf_dir).where("doc_id % 5 = 0").select("memory_id")
    return ranking.association(c, cooled)


@query(sql("""SELECT query_id, 'd' || doc_id AS memory_id, round(distance + CASE WHEN doc_id % 2 = 0 THEN (CASE WHEN doc_id % 500 < 45 THEN 0.30 WHEN doc_id % 500 < 120 THEN 0.18 WHEN doc_id % 500 < 360 THEN 0.08 ELSE 0 END) + 0.04 * least(doc_id % 7, 4) ELSE 0 END + CASE WHEN doc_id % 11 = 0 THEN 0.12 ELSE 0 END, 6) AS score FROM vector_rank""", ASKED, VECTOR_RANK))
def i22_repeat_penalties(spark, sf_dir):
    n, now = F.col("doc_id"), F.expr("timestamp_ntz'2024-02-01 00:00:00'")
    name = F.concat(F.lit("d"), n.cast("string")).alias("memory_id")
    results = _vector_rank(spark, sf_dir).select("query_id", name, F.col("distance").alias("score"), (n % 11 == 0).alias("sticky"))
    shown = T.vectors(spark, sf_dir).withColumnRenamed("vec_id", "doc_id").where(n % 2 == 0).select("memory_id", (now - F.make_dt_interval(F.lit(0), F.lit(0), (n % 500).cast("int"))).alias("at"), (n % 7).alias("count"))
    return ranking.repeat_penalised(results, shown, now).drop("sticky")


@query(sql("SELECT query_id, 'd' || doc_id AS memory_id, distance FROM vector_rank WHERE distance BETWEEN 0.45 AND 0.68 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, 'd' || doc_id) <= 8", ASKED, VECTOR_RANK))
def o64_near_misses(spark, sf_dir):
    rows = _vector_rank(spark, sf_dir).select("query_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("memory_id"), "distance")
    return ranking.near_misses(rows)


@query(sql("SELECT memory_id, CASE WHEN quality IS NOT NULL AND quality = 0 THEN 'low' ELSE 'normal' END AS priority FROM memories LEFT JOIN labels USING (doc_id)"))
def m14_verdicts(spark, sf_dir):
    c = T.memories(spark, sf_dir).select(F.col("memory_id").alias("id"))
    v = T.table(spark, sf_dir, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("quality").cast("double").alias("confidence"))
    return proposals.with_verdicts(c, v).select(F.col("id").alias("memory_id"), "priority")


@query(sql("SELECT kind, count(*) AS n FROM (SELECT CASE WHEN event_type IN ('view', 'click') THEN 'flow' WHEN event_type = 'purchase' THEN 'semantic' ELSE 'rest' END AS kind FROM events) GROUP BY 1"))
def j27_classified_legacy(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type").isin("view", "click"), "lateral").when(F.col("event_type") == "purchase", "updates").otherwise("unknown").alias("edge_type"))
    flow, semantic, rest = lifecycle.classified_legacy(e)
    n = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
    return n("flow", flow).unionByName(n("semantic", semantic)).unionByName(n("rest", rest))


@query(sql("SELECT event_type AS parent_id, count(*) AS attempts, arg_max(user_id, (ts, event_id)) AS error FROM events GROUP BY 1"))
def l64_failures(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").select(F.col("event_type").alias("parent_id"), F.lit(1).alias("attempts"), F.col("user_id").alias("error"), F.struct("ts", "event_id").alias("failed_at"))
    return lifecycle.failures_recorded(e.where("failed_at.event_id % 2 = 0"), e.where("failed_at.event_id % 2 = 1")).select("parent_id", "attempts", "error")


@query(sql("SELECT doc_id, level = 'raw' AND doc_id % 7 > 2 AS valid FROM memories"))
def b46_tag_contract(spark, sf_dir):
    m = T.memories(spark, sf_dir)
    tags = F.when(F.col("level") == "raw", F.concat("tags", F.array(F.lit("state:current")))).otherwise(F.col("tags"))
    return m.select("doc_id", lifecycle.tags_valid(tags, F.concat("tags", F.array(F.lit("state:current")))).alias("valid"))


@query(sql("SELECT event_type AS job, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS at, max(ts) >= TIMESTAMP '2024-01-30' - INTERVAL 24 HOUR AS recent FROM events GROUP BY 1"))
def n11_job_status(spark, sf_dir):
    runs = T.table(spark, sf_dir, "events").select(F.col("event_type").alias("job"), F.col("ts").alias("at"), F.lit(True).alias("ok"))
    status = reports.job_status(runs, runs.select("job").distinct(), F.expr("timestamp_ntz'2024-01-30 00:00:00'"))
    return status.select("job", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "recent")
