"""Queries of stateful operators: batch forms with oracles, and the streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import records
from ..session import shared_folder
from ..sources import tables as T
from ..streaming import ingest
from .oracle import sql
from .registry import query


def _scratch(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query(sql("""SELECT event_id, event_type FROM (WITH RECURSIVE ordered AS (SELECT event_id, event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
fold AS (SELECT event_id, event_type, ts, k, ts AS last, true AS ok FROM ordered WHERE k = 1 UNION ALL
  SELECT o.event_id, o.event_type, o.ts, o.k, CASE WHEN o.ts - last >= INTERVAL 5 MINUTE THEN o.ts ELSE last END, o.ts - last >= INTERVAL 5 MINUTE FROM fold f JOIN ordered o ON o.event_type = f.event_type AND o.k = f.k + 1)
SELECT event_id, event_type FROM fold WHERE ok)"""))
def k02_time_dedup(spark, sf_dir):
    return records.first_accepted(T.table(spark, sf_dir, "events"), "event_type", "ts", 5).select("event_id", "event_type")


@query(sql("SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 3 + 1 AS position FROM events"))
def k13_cadence(spark, sf_dir):
    return records.every_nth(T.table(spark, sf_dir, "events"), "user_id", "ts", 3).select("event_id", "position")


@query(sql("SELECT event_id, coalesce(floor(epoch(ts)) - floor(epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) < 7200, false) AS cooled FROM events"))
def k14_cooldown(spark, sf_dir):
    return records.cooling(T.table(spark, sf_dir, "events"), "user_id", "ts", 7200).select("event_id", "cooled")


@query(sql("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)) RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW) AS recent FROM events"))
def k21_sliding_history(spark, sf_dir):
    return records.sliding_counts(T.table(spark, sf_dir, "events"), "user_id", "ts", 21_600).select("event_id", "recent")


@query(sql("""SELECT id, array_to_string(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda t: length(t) >= 2), ' ') AS tokenized FROM messages WHERE kind IN ('user', 'voice', 'reply') AND trim(text) <> ''"""))
def k01_stream_ingest(spark, sf_dir):
    """Message files through a stream into the index, then read back."""
    base = _scratch(spark)
    T.messages(spark, sf_dir).select("id", "kind", "text").write.parquet(f"{base}/source")
    schema = spark.read.parquet(f"{base}/source").schema
    ingest.sync_index(spark, f"{base}/source", schema, f"{base}/index", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/index").select("id", "tokenized")


@query(sql("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"))
def k26_windowed_counts(spark, sf_dir):
    e = T.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.windowed_counts(e, "1 hour", "1 day").select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")
