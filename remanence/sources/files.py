"""File sources and sinks of the engine: queues, traces, packed vectors,
snapshots, rule scans, layered settings. Paths may be in any store that Spark
reads."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import snapshots, tables


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """Proposals of a queue that :func:`write_queue` has published, or of one JSON
    document; a malformed document fails."""
    schema = T.StructType([T.StructField("proposals", T.ArrayType(tables.PROPOSAL))])
    store = snapshots.Store(spark, path)
    if (found := store.snapshot()).version:
        path = f"{store.root}/{found.tables['table']['folder']}"
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.inline("proposals"))


def write_queue(proposals: DataFrame, path: str) -> None:
    """The queue as one JSON document, published as a new version."""
    doc = proposals.agg(F.collect_list(F.struct(*proposals.columns)).alias("proposals"))
    snapshots.publish(doc.coalesce(1), path, "json")


def append_trace(rows: DataFrame, path: str) -> None:
    rows.withColumn("day", F.to_date("t")).write.mode("append").partitionBy("day").json(path)


def read_trace(spark: SparkSession, path: str, since=None) -> DataFrame:
    """Trace rows; bad lines are skipped."""
    rows = spark.read.schema(tables.TRACE).option("mode", "DROPMALFORMED").json(path)
    return rows if since is None else rows.where(F.col("t") >= F.lit(since))


def tail_trace(spark: SparkSession, path: str, words: str = "", limit: int = 30) -> DataFrame:
    lines = spark.read.text(path)
    valid = lines.where(F.contains("value", F.lit(words))).select(F.from_json("value", tables.TRACE).alias("r")).where("r.t IS NOT NULL").select("r.*")
    return valid.orderBy(F.desc("t")).limit(limit)


def last_json_line(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The last line of each file that is a JSON object."""
    lines = spark.read.text(path).withColumns({"file": F.input_file_name(), "place": F.monotonically_increasing_id(), "o": F.from_json("value", schema)})
    good = lines.where(F.trim("value").startswith("{") & F.col("o").isNotNull())
    return good.groupBy("file").agg(F.max_by("o", "place").alias("o")).select("file", "o.*")


def prior_status(spark: SparkSession, folders: Mapping[str, str], schema: T.StructType, key: str) -> DataFrame:
    """Candidates over several folders; the first status of the mapping wins."""
    parts = [spark.read.schema(schema).json(path).select(key, F.lit(status).alias("status"), F.lit(k).alias("place")) for k, (status, path) in enumerate(folders.items())]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    first = Window.partitionBy(key).orderBy("place")
    return every.withColumn("k", F.row_number().over(first)).where("k = 1").select(key, "status")


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def unpacked(blobs: pd.Series) -> pd.Series:
    """float32 bytes to a vector."""
    return blobs.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4").tolist())


@F.pandas_udf(T.BinaryType())
def packed(vectors: pd.Series) -> pd.Series:
    """A vector to float32 bytes."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


def pending_by_hash(rows: DataFrame, done: DataFrame, key: str, text: str, limit: int | None = None) -> DataFrame:
    """Rows whose text is not the one that ``done (key, text_hash)`` knows."""
    left = rows.withColumn("text_hash", F.sha2(text, 256)).join(done.select(key, "text_hash"), [key, "text_hash"], "left_anti")
    return left if limit is None else left.orderBy(F.desc(key)).limit(limit)


def scan_rules(spark: SparkSession, path: str, rules: Mapping[str, str]) -> DataFrame:
    """``rule, file, line, text`` of every line that a pattern matches."""
    text = whole_text(spark, path).select("file", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(pattern), F.lit(name)) for name, pattern in rules.items()]))
    return text.select(F.explode(hits).alias("rule"), "file", (F.col("line") + 1).alias("line"), "text")


@dataclass(frozen=True)
class Settings:
    """Settings by precedence: argument, environment, file, default."""

    data_dir: str = "remanence-data"
    budget: int = 5
    depth: int = 3
    zone: str = "Asia/Tokyo"

    @classmethod
    def load(cls, file: str | None = None, **given) -> Settings:
        import tomllib

        found: dict = {}
        if file:
            with open(file, "rb") as handle:
                found |= tomllib.load(handle)
        for f in fields(cls):
            value = os.environ.get(f"REMANENCE_{f.name.upper()}")
            if value is not None:
                found[f.name] = int(value) if isinstance(f.default, int) else value
        found |= {k: v for k, v in given.items() if v is not None}
        settings = replace(cls(), **{k: v for k, v in found.items() if k in {f.name for f in fields(cls)}})
        if settings.budget < 1 or not 0 <= settings.depth <= 5:
            raise ValueError("budget must be positive and depth between 0 and 5")
        return settings
