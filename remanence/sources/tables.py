"""The engine's tables: schemas, conformance, and their derivation from the
driver's tables.

Derived tables are plain projections and joins, so filters and column pruning
reach the Parquet scans of whatever query uses them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D, _B, _N = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampNTZType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_REASONED = T.ArrayType(_schema(id=_S, reason=_S, score=_D))

MEMORY = _schema(
    memory_id=_S, text=_S, context=_S, ts=_N, usage_count=_L, last_used=_N, tags=T.ArrayType(_S), tier=_S, pinned=_B,
    emotion=_D, level=_S, collection=_S, activation=_D, last_heated=_N,
)
FLOW_EDGE = _schema(source_id=_S, target_id=_S, weight=_D, conductance=_D, created=_N, last_fired=_N, provenance=_S)
SEMANTIC_EDGE = _schema(
    edge_id=_S, source_id=_S, target_id=_S, role=_S, strength=_D, conductance=_D, confidence=_D, valid_from=_N, valid_to=_N,
    provenance=_S, review_state=_S, created_by=_S, audit_note=_S, created=_N,
)
MESSAGE = _schema(id=_L, ts=_N, direction=_S, kind=_S, text=_S, meta=T.MapType(_S, _S))
PROPOSAL = _schema(
    id=_S, kind=_S, status=_S, priority=_S, source_id=_S, target_id=_S, reason=_S, similarity=_D, signals=T.ArrayType(_S), created_at=_N,
)
EVENT = _schema(event_id=_L, memory_id=_S, event_type=_S, detail=_S, ts=_N)
TRACE = _schema(t=_N, stage=_S, q=_S, gate=_S, timings_ms=T.MapType(_S, _D), selected=_REASONED, rejected=_REASONED)

#: Defaults of columns that older snapshots lack.
DEFAULTS = {"context": "", "level": "raw", "collection": "", "tier": "short", "activation": 0.0, "usage_count": 0, "emotion": 0.5, "pinned": False, "conductance": 1.0, "provenance": "unknown"}


def conform(df: DataFrame, schema: T.StructType, defaults: dict = DEFAULTS) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: missing ones get their
    default or null, others are cast; what the schema lacks is dropped."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema
    ])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _minutes(n: Column) -> Column:
    return F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text records from ``documents``, their emotion from ``labels``."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    return d.join(marks, "doc_id", "left").select(
        n, F.concat(F.lit("d"), n.cast("string")).alias("memory_id"), "text", _minutes(n).alias("ts"),
        F.when(n % 10 == 0, "cognition").when(n % 10 <= 3, "understanding").otherwise("raw").alias("level"),
        F.when(F.col("source") == "src0", "library").otherwise("").alias("collection"),
        F.when(n % 3 == 0, "short").when(n % 3 == 1, "long").otherwise("core").alias("tier"),
        (n % 81 / 10.0).alias("activation"),
        F.when(F.col("toxic") == 1, 0.9).when(F.col("quality") == 1, 0.7).when(F.col("quality") == 0, 0.2).otherwise(0.5).alias("emotion"),
        F.array(
            F.concat(F.lit("lang:"), F.coalesce("lang", F.lit("und"))), F.concat(F.lit("domain:"), F.coalesce("source", F.lit("none"))),
            F.when(n % 7 == 0, "state:current").when(n % 7 == 1, "state:past").when(n % 7 == 2, "state:obsolete").otherwise("kind:note"),
        ).alias("tags"),
        (n % 5).alias("usage_count"), (n % 97 == 0).alias("pinned"), "lang", "source",
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("d"), F.col("vec_id").cast("string")).alias("memory_id"), "vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


def flow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between parts on neighbouring lines of an order."""
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    a, b = lines.alias("a"), lines.alias("b")
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") + 1 == F.col("b.l_linenumber")))
    ends = pairs.crossJoin(F.broadcast(n)).select(
        (F.col("a.l_partkey") % F.col("n")).alias("s"), (F.col("b.l_partkey") % F.col("n")).alias("t"), F.col("a.l_shipdate").alias("fired")
    ).where("s <> t")
    return ends.groupBy("s", "t").agg(F.count("*").alias("uses"), F.max("fired").alias("last_fired")).select(
        F.concat(F.lit("d"), F.col("s").cast("string")).alias("source_id"), F.concat(F.lit("d"), F.col("t").cast("string")).alias("target_id"),
        F.least(F.lit(10.0), F.round(F.col("uses") * 0.2, 6)).alias("weight"), F.when(F.col("s") % 2 == 0, 0.25).otherwise(1.0).alias("conductance"),
        "last_fired",
        F.when(F.col("s") % 5 == 0, "manual").when(F.col("s") % 5 == 1, "cluster").when(F.col("s") % 5 == 2, "knn_legacy").otherwise("auto_link").alias("provenance"),
    )


def semantic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``updates``: each repeated text points to its previous copy;
    ``SUPPORTED_BY``: understandings point to a raw record five further on."""
    m = memories(spark, sf_dir).select("doc_id", "memory_id", "text", "level", "ts")
    same = Window.partitionBy("text").orderBy("doc_id")
    updates = m.withColumn("old", F.lag("memory_id").over(same)).where("old IS NOT NULL").select(
        F.col("memory_id").alias("source_id"), F.col("old").alias("target_id"), F.lit("updates").alias("role"), "doc_id", F.col("ts").alias("created")
    )
    raw = m.where("level = 'raw'").select((F.col("doc_id") - 5).alias("doc_id"), F.col("memory_id").alias("target_id"))
    support = m.where("level = 'understanding'").join(raw, "doc_id").select(
        F.col("memory_id").alias("source_id"), "target_id", F.lit("SUPPORTED_BY").alias("role"), "doc_id", F.col("ts").alias("created")
    )
    n = F.col("doc_id")
    return updates.unionByName(support).select(
        "source_id", "target_id", "role", "created", (0.5 + n % 5 / 10.0).alias("confidence"), (1.0 - n % 3 / 10.0).alias("strength"),
        F.when(n % 4 == 0, "pending").when(n % 4 == 1, "auto").otherwise("approved").alias("review_state"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), _minutes(F.col("conv_id") * 180 + F.col("turn") * 7).alias("ts"),
        F.when(F.col("role") == "user", "in").otherwise("out").alias("direction"),
        F.when(F.col("role") == "user", "user").when(F.col("role") == "assistant", "reply").otherwise("system").alias("kind"), "text", "conv_id",
    )


def beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One belief a source; its status and pin follow the source's number."""
    s = table(spark, sf_dir, "documents").select("source").where("source IS NOT NULL").distinct()
    n = F.substring("source", 4, 9).cast("int")
    return s.select(
        F.concat(F.lit("b-"), F.col("source")).alias("belief_id"), F.concat(F.lit("about "), F.col("source")).alias("statement"),
        F.when(n % 4 == 3, "candidate").otherwise("active").alias("status"), (n % 9 == 0).alias("pinned"),
        _minutes(n * 600).alias("last_touched"),
    )


def belief_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as evidence for or against their source's belief."""
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "source")
    return l.join(d, "doc_id", "left").select(
        F.concat(F.lit("c-"), F.col("doc_id").cast("string")).alias("case_id"), F.concat(F.lit("b-"), F.col("source")).alias("belief_id"),
        F.when(F.col("toxic") == 1, "boundary").when(F.col("quality") == 1, "support").otherwise("contradiction").alias("case_kind"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("memory_id"), _minutes(F.col("doc_id")).alias("occurred_at"),
    ).where("belief_id IS NOT NULL")


def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
