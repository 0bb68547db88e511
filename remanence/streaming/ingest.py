"""Structured Streaming jobs: incremental ingest, keyed state, retention.

Each job runs over a file source with ``availableNow``: it takes what is there,
in bounded micro-batches, and resumes from its checkpoint, so a rerun after a
failure neither loses nor repeats an effect.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text

KINDS = ("user", "voice", "reply")


def indexed(messages: DataFrame) -> DataFrame:
    """Rows that the message index takes: spoken kinds with text, tokenised."""
    spoken = messages.where(F.col("kind").isin(*KINDS) & (F.trim("text") != ""))
    return spoken.select("id", "text", F.array_join(text.tokens(F.col("text")), " ").alias("tokenized"))


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over everything available and stops; a failure of the
    query is raised."""
    job = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()


def sync_index(spark: SparkSession, source: str, schema: T.StructType, out: str, checkpoint: str, files_per_batch: int = 16) -> None:
    """Indexes new message files. Batches are written under their number, so a
    repeated batch overwrites itself."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    run_available(indexed(stream), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), checkpoint)


#: Seconds that state stays after it has expired, for late events.
SPARE = 86_400


class GapFilter(StatefulProcessor):
    """Passes events at least ``seconds`` after the last one passed of a key.

    Events of one micro-batch are taken in time order; the state is one time,
    which goes a day after it has stopped to matter if the query is ``lasting``.
    """

    def __init__(self, seconds: int, lasting: bool = False):
        self.seconds, self.lasting = seconds, lasting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("at", T.TimestampType())]), ttlDurationMs=(self.seconds + SPARE) * 1000 if self.lasting else None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        held = self.last.get()
        last = pd.Timestamp(held[0]) if held else None
        gap, kept = pd.Timedelta(seconds=self.seconds), []
        for at in events["ts"]:
            plain = at.tz_localize(None) if at.tzinfo else at
            ok = last is None or plain - (last.tz_localize(None) if last.tzinfo else last) >= gap
            kept.append(ok)
            last = plain if ok else last
        self.last.update((last.to_pydatetime() if isinstance(last, pd.Timestamp) else last,))
        yield events[kept]

    def close(self) -> None:
        pass


def gap_filtered(stream: DataFrame, key: str, seconds: int, lasting: bool = False) -> DataFrame:
    """``stream`` (event_id, ts, key, ...) through :class:`GapFilter`; needs
    the RocksDB state store. A query that runs on should be ``lasting``, so that
    its state expires; an ``availableNow`` job would not end with such timers."""
    return stream.groupBy(key).transformWithStateInPandas(
        statefulProcessor=GapFilter(seconds, lasting), outputStructType=stream.schema, outputMode="Append", timeMode="ProcessingTime" if lasting else "None"
    )


class RecentlyShown(StatefulProcessor):
    """Marks events whose key was shown within the time to live, and counts
    showings up to ``most``. A showing counts for ``seconds`` of event time; its
    state goes a day later by the clock if the query is ``lasting``."""

    def __init__(self, seconds: int, most: int = 8, lasting: bool = False):
        self.seconds, self.most, self.lasting = seconds, most, lasting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", T.StructType([T.StructField("at", T.DoubleType()), T.StructField("count", T.IntegerType())]), ttlDurationMs=(self.seconds + SPARE) * 1000 if self.lasting else None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        held = self.seen.get()
        at, count = held if held else (None, 0)
        cooled, counts = [], []
        for t in events["ts"]:
            now = t.timestamp()
            warm = at is not None and now - at < self.seconds
            count = min(self.most, count + 1) if warm else 1
            cooled.append(warm)
            counts.append(count)
            at = now
        self.seen.update((at, count))
        yield events.assign(cooled=cooled, shown=counts)

    def close(self) -> None:
        pass


def recently_shown(stream: DataFrame, key: str, seconds: int, lasting: bool = False) -> DataFrame:
    kind = T.StructType(stream.schema.fields + [T.StructField("cooled", T.BooleanType()), T.StructField("shown", T.IntegerType())])
    return stream.groupBy(key).transformWithStateInPandas(statefulProcessor=RecentlyShown(seconds, lasting=lasting), outputStructType=kind, outputMode="Append", timeMode="ProcessingTime" if lasting else "None")


def windowed_counts(stream: DataFrame, width: str, late: str) -> DataFrame:
    """Counts by event-time window with a watermark (an extension: the memory
    engine itself has no late-data policy)."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def retained(traces: DataFrame, now: datetime.datetime, hours: int = 24, most: int = 5000) -> DataFrame:
    """Trace rows of the last ``hours``, newest first, at most ``most``."""
    return traces.where(F.col("t") >= F.lit(now) - F.expr(f"interval {hours} hours")).orderBy(F.desc("t")).limit(most)


def apply_changes(spark: SparkSession, source: str, schema: T.StructType, state_path: str, checkpoint: str, key: str) -> None:
    """Folds a change feed into versioned state snapshots, one a micro-batch."""
    from ..operators.lifecycle import folded_changes

    def fold(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        columns = [f for f in schema.fields if f.name not in ("op", "revision")]
        before = f"{state_path}/version={number - 1}"
        state = session.read.schema(T.StructType(columns)).parquet(before) if number else session.createDataFrame([], T.StructType(columns))
        folded_changes(state, batch, key).write.mode("overwrite").parquet(f"{state_path}/version={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    run_available(stream, fold, checkpoint)
