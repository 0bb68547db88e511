"""Scalar functions over the driver's tables, several to a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, signals, text, timefn, vector
from ..sources import tables as T
from .oracle import sql
from .registry import query

REDACT = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(?i)bearer\s+[a-z0-9._-]+', '[bearer]', 'g'), '\bsk-[A-Za-z0-9_-]{{8,}}', '[key]', 'g'), '\b[A-Za-z0-9_-]{{36,}}\b', '[token]', 'g'), '\b\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\b', '[ip]', 'g')"""


@query(sql(r"""SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS normalised, CASE WHEN length(flat) > 240 THEN rtrim(substr(flat, 1, 240)) || '…' ELSE flat END AS clipped,
  substr(text, 1, 4096) AS snippet, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS letters, list_contains(tags, 'domain:' || source) AS has_domain,
  len(list_filter(tags, lambda t: starts_with(t, 'state:'))) AS states FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM memories)"""))
def h_text_shape(spark, sf_dir):
    m, t = T.memories(spark, sf_dir), F.col("text")
    return m.select(
        "doc_id", text.normalised(t).alias("normalised"), text.clipped(t).alias("clipped"), text.cut(t, 4096).alias("snippet"), F.length(text.letters_only(t)).alias("letters"),
        F.array_contains("tags", F.concat(F.lit("domain:"), F.col("source"))).alias("has_domain"), F.size(F.filter("tags", lambda x: x.startswith("state:"))).alias("states"),
    )


@query(sql(r"""SELECT page_id, %s AS masked, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages""" % REDACT.format("html")))
def h23_redaction(spark, sf_dir):
    p = T.table(spark, sf_dir, "pages")
    return p.select("page_id", text.redacted(F.col("html")).alias("masked"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))


TERMS = r"""terms AS (SELECT query_id, text, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda t: length(t) >= 2)) AS q FROM queries)"""


@query(sql(r"""SELECT query_id, list_sort(q) AS terms, list_sort(list_filter(list_filter(q, lambda t: t NOT IN ('the', 'and', 'of', 'to', 'in', 'is', 'that', 'it', 'was', 'for') AND NOT regexp_matches(t, '^\p{N}+$') AND length(t) >= 3), lambda t: length(t) >= 6)) AS long_terms FROM terms""", TERMS))
def h02_query_terms(spark, sf_dir):
    q = T.search_queries(spark, sf_dir)
    words = text.query_terms(F.col("text"))
    salient = F.filter(words, lambda t: ~t.isin(*text.STOP_WORDS) & ~t.rlike(r"^\p{N}+$") & (F.length(t) >= 6))
    return q.select("query_id", F.array_sort(words).alias("terms"), F.array_sort(salient).alias("long_terms"))


@query()
def h05_salient_terms(spark, sf_dir):
    q = T.search_queries(spark, sf_dir)
    return q.select("query_id", text.salient_terms(F.col("text")).alias("terms"), text.any_term_expression(F.col("text")).alias("expression"), text.title(F.col("text")).alias("title"))


@query(sql("""SELECT doc_id, 'up_' || substr(sha256('evokes|' || memory_id || '|' || source), 1, 16) AS proposal, sha256(array_to_string(list_sort([memory_id, 'x', source]), chr(10))) AS fingerprint,
  sha256(text) AS source_hash, ('0x' || substr(sha256(memory_id), 1, 8))::BIGINT % 100 < 30 AS sampled FROM memories WHERE source IS NOT NULL"""))
def h28_digests(spark, sf_dir):
    m = T.memories(spark, sf_dir).where("source IS NOT NULL")
    return m.select(
        "doc_id", hashing.proposal_id(F.lit("evokes"), F.col("memory_id"), F.col("source")).alias("proposal"), hashing.group_fingerprint(F.array("memory_id", F.lit("x"), "source")).alias("fingerprint"),
        F.sha2("text", 256).alias("source_hash"), hashing.sampled(F.col("memory_id"), 30).alias("sampled"),
    )


@query()
def h40_named_ids(spark, sf_dir):
    e = T.semantic_edges(spark, sf_dir)
    return e.select(
        "source_id", "target_id", "role", hashing.edge_id(F.col("source_id"), F.col("target_id"), F.col("role")).alias("edge_id"),
        hashing.link_fingerprint(F.lit("semantic"), F.col("role"), F.col("source_id"), F.col("target_id"), F.lit("{}")).alias("link"),
    )


@query(sql("""SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS local_day, CASE WHEN age <= 7 THEN 1.0 WHEN age <= 30 THEN 0.8 WHEN age <= 90 THEN 0.6 ELSE 0.4 END::DOUBLE AS freshness,
  round(greatest(0, least(1, 1 - age / 365)), 6) AS recency, round(greatest(-0.05, least(0.05, 0.05 * (60 - age) / 60)), 6) AS boost, ts >= TIMESTAMP '2024-01-09 15:00:00' AND ts < TIMESTAMP '2024-01-12 15:00:00' AS in_range
  FROM (SELECT *, greatest(0, (epoch_us(TIMESTAMP '2024-03-01') - epoch_us(ts)) / 86400000000::DOUBLE) AS age FROM events)"""))
def h13_time_functions(spark, sf_dir):
    e, now, ts = T.table(spark, sf_dir, "events"), F.expr("timestamp_ntz'2024-03-01 00:00:00'"), F.col("ts").cast("timestamp")
    return e.select(
        "event_id", timefn.local_day(ts).cast("string").alias("local_day"), timefn.freshness(ts, now).alias("freshness"), F.round(timefn.recency_signal(ts, now), 6).alias("recency"),
        F.round(timefn.recency_boost(ts, now, F.lit(False)), 6).alias("boost"), timefn.in_local_days(ts, F.lit("2024-01-10").cast("date"), F.lit("2024-01-12").cast("date")).alias("in_range"),
    )


@query(sql("""SELECT doc_id, round(least(1, activation / 5), 6) AS activation, round(greatest(0, least(1, 0.5 + CASE WHEN level IN ('understanding', 'cognition') THEN 0.3 ELSE 0 END + CASE tier WHEN 'core' THEN 0.2 WHEN 'short' THEN -0.2 ELSE 0 END)), 6) AS tier_level,
  CASE WHEN list_contains(tags, 'state:past') OR list_contains(tags, 'state:obsolete') THEN 'past' ELSE 'current' END AS label, round(greatest(0, least(1, (emotion - 0.2) / 0.6)), 6) AS distance,
  round(1 - abs(0.8 - emotion), 6) AS emotion FROM memories"""))
def h74_ranking_signals(spark, sf_dir):
    m = T.memories(spark, sf_dir)
    return m.select(
        "doc_id", F.round(signals.activation_signal(F.col("activation")), 6).alias("activation"), F.round(signals.tier_level_signal(F.col("tier"), F.col("level")), 6).alias("tier_level"),
        signals.temporal_label(F.col("tags"), F.lit(False)).alias("label"), F.round(signals.distance_signal(F.col("emotion")), 6).alias("distance"), F.round(1 - F.abs(0.8 - F.col("emotion")), 6).alias("emotion"),
    )


@query(sql(r"""SELECT conv_id, turn, CASE WHEN body = '' THEN 'empty' WHEN letters = '' THEN 'symbols' WHEN regexp_matches(body, '(?i)^(go on|continue|next|more)[.!]*$') THEN 'continue'
  WHEN regexp_matches(body, '(?i)^(h+m+|a+h+|o+h+|lol|ha(ha)+|uh+)[.!~]*$') THEN 'interjection' WHEN length(letters) < 2 THEN 'fragment' END AS reason,
  CASE WHEN regexp_matches(text, '(?i)\b(before|earlier|used to|back then|previously|last (week|month|year))\b|以前|昔') THEN 'historical' ELSE 'current' END AS mode
  FROM (SELECT *, trim(coalesce(text, '')) AS body, regexp_replace(trim(coalesce(text, '')), '[^\p{L}\p{N}]', '', 'g') AS letters FROM conversations)"""))
def b40_low_signal_gate(spark, sf_dir):
    c = T.table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", signals.low_signal(F.col("text")).alias("reason"), signals.temporal_mode(F.col("text")).alias("mode"))


@query(sql(r"""SELECT doc_id, level = 'raw' AND collection <> 'library' AND coalesce(regexp_matches(text, '[①-⑳]') OR len(regexp_extract_all(text, '(?m)^\s*\d+[.)、]')) >= 2 OR len(regexp_extract_all(text, '(?m)^\s*[-*•]\s')) >= 2
  OR len(regexp_extract_all(text, '【[^】]+】')) >= 2 OR len(regexp_extract_all(text, '→|->')) >= 2 OR len(regexp_extract_all(text, '、')) >= 3 OR (len(regexp_extract_all(text, '[.!?。！？]')) >= 4 AND length(text) >= 150), false) AS indexed FROM memories"""))
def b31_index_gate(spark, sf_dir):
    return T.memories(spark, sf_dir).select("doc_id", signals.should_index(F.col("text"), F.col("level"), F.col("collection")).alias("indexed"))


@query()
def h78_evidence(spark, sf_dir):
    """Evidence of each benchmark passage in the record that bm25 puts first."""
    from .search import _text_rank

    best = _text_rank(spark, sf_dir).where("rank = 1").select("query_id", "doc_id")
    both = F.broadcast(best.join(T.search_queries(spark, sf_dir).withColumnRenamed("text", "asked"), "query_id")).join(T.memories(spark, sf_dir).select("doc_id", "text"), "doc_id")
    place = text.span(F.col("text"), F.get(text.evidence_terms(F.col("asked"), F.col("text")), F.lit(0)))
    return both.select(
        "query_id", "doc_id", text.evidence_terms(F.col("asked"), F.col("text")).alias("terms"), text.evidence_window(F.col("asked"), F.col("text")).alias("window"),
        F.round(signals.evidence_coverage(text.evidence_terms(F.col("asked"), F.col("text"))), 6).alias("coverage"), text.independent(F.col("asked"), F.col("text")).alias("independent"), place.alias("place"),
    )


@query()
def m01_hash_embedding(spark, sf_dir):
    return T.search_queries(spark, sf_dir).select("query_id", vector.hash_vector(F.col("text")).alias("embedding"))


@query(sql("""SELECT event_id, event_type, round(CASE WHEN value >= 1073741824 THEN 0 ELSE value END, 6) AS value, (props::JSON ->> '$.k')::INT AS k, md5(props) AS digest, json_exists(props, '$.k') AS has_k FROM events"""))
def h08_json_properties(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    props = F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return e.select("event_id", "event_type", F.round("value", 6).alias("value"), F.try_element_at(props, F.lit("k")).cast("int").alias("k"), F.md5("props").alias("digest"), F.map_contains_key(props, "k").alias("has_k"))
