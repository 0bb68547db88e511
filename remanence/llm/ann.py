"""Nearest neighbours by adaptive dimension scan (operator 9).

Vectors are rotated by a random orthogonal matrix and put in inverted lists. In
a probed list they are scanned in blocks of columns: after each block, a
hypothesis test on the partial distance abandons candidates whose whole
distance is almost surely above the query's tenth best so far, since after a
random rotation any m of d dimensions estimate the distance with an error of
order 1/sqrt(m). What survives is measured on the original vectors in double
precision.

The centroids, and the share of lists that a query probes, are fitted on a
bounded sample (``Options.sample`` vectors) so that recall on the sample reaches
``Options.recall``; every vector is indexed. Lists are cut in chunks of about
``chunk`` vectors and queries in blocks, so neither a list that holds a third of
all vectors nor many queries makes a large task.

Defined results: vectors that are null, zero, of another dimension than most, or
hold null or non-finite components take no part. Rows that share a vec_id are
one vector (the smallest); null vec_ids take no part. Equal distances go to the
smaller vec_id. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import removed, written


@dataclass(frozen=True)
class Options:
    nearest: int = 10
    sample: int = 4096
    most_lists: int = 1024
    chunk: int = 4096
    query_block: int = 2048
    columns: int = 8
    #: Most rows after which the abandoning bound is tightened.
    slice: int = 1024
    #: Width of the abandoning test, in units of 1/sqrt(dimensions seen).
    epsilon: float = 2.1
    recall: float = 0.985
    seed: int = 7


@dataclass(frozen=True)
class Index:
    rotation: np.ndarray
    centroids: np.ndarray
    probes: int


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)


def fit(sample: np.ndarray, total: int, o: Options) -> Index:
    """Rotation, k-means centroids and the probes that reach the wanted recall
    on the sample, searched for half of it."""
    d = sample.shape[1]
    rng = np.random.default_rng(o.seed)
    rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
    points = sample @ rotation
    lists = int(max(1, min(o.most_lists, len(points) // 16, round(total**0.5 / 4))))
    centres = points[rng.choice(len(points), lists, replace=False)].copy()
    for _ in range(10):
        near = _squares(points, centres).argmin(1)
        for j in range(lists):
            if (near == j).any():
                centres[j] = points[near == j].mean(0)
    near = _squares(points, centres).argmin(1)
    asked = points[: min(256, len(points))]
    order = _squares(asked, centres).argsort(1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(lists)[None, :].repeat(len(asked), 0), 1)
    apart = _squares(asked, points)
    apart[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    best = apart.argsort(1)[:, : o.nearest]
    needed = np.sort(np.take_along_axis(place, near[best], 1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(o.recall * len(needed))) - 1)]) + 1 if len(needed) else lists
    return Index(rotation, centres, min(lists, probes))


def scan(query: np.ndarray, vectors: np.ndarray, o: Options) -> np.ndarray:
    """Rows of ``vectors`` (rotated) that may be among the nearest of ``query``
    (rotated). Rows go in slices, each twice the last up to ``o.slice``; what a
    slice leaves is measured whole, so the bound that abandons candidates is the
    tenth best of all slices before. Only the first, small slice has no bound."""
    n, d = vectors.shape
    found, best, bound = [], np.empty(0), np.inf
    start, width = 0, min(o.slice, 4 * o.nearest)
    while start < n:
        alive = np.arange(start, min(n, start + width))
        start, width = start + width, min(o.slice, 2 * width)
        partial = np.zeros(len(alive))
        for begin in range(0, d, o.columns):
            end = min(d, begin + o.columns)
            block = vectors[alive, begin:end] - query[begin:end]
            partial = partial + np.einsum("ij,ij->i", block, block)
            limit = bound if end == d else bound * (1 + o.epsilon / end**0.5) ** 2 * end / d
            stay = partial <= limit * (1 + 1e-9)
            alive, partial = alive[stay], partial[stay]
            if not len(alive):
                break
        found.append(alive)
        best = np.append(best, partial[: len(alive)])
        if len(best) >= o.nearest:
            best = np.partition(best, o.nearest - 1)[: o.nearest]
            bound = best.max()
    return np.concatenate(found) if found else np.empty(0, dtype=np.int64)


def search(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", o: Options = Options()) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors`` where
    ``is_query``: the nearest of all other rows that the probed lists hold."""
    spark = vectors.sparkSession
    clean = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), is_query.alias("asks")).where(
        F.col("id").isNotNull() & usable(F.col("v"))
    )
    clean = clean.groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks"))
    clean = written(clean, "ann-vectors")
    dims = clean.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    answer = "query_id long, vec_id long, score double"
    if not dims:
        return spark.createDataFrame([], answer).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    d, total = dims[0]["d"], dims[0]["count"]
    clean = clean.where(F.size("v") == d)
    sample = np.array([r["v"] for r in clean.orderBy(F.xxhash64("id"), "id").limit(o.sample).collect()], dtype=float)
    index = fit(sample, total, o)
    shared = spark.sparkContext.broadcast(index)  # at most most_lists + d rows of d numbers

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = shared.value
        for batch in batches:
            if batch.num_rows:
                v = batch.column(1).values.to_numpy(zero_copy_only=False).reshape(-1, d)
                order = np.argsort(_squares(v @ i.rotation, i.centroids), axis=1, kind="stable")[:, : i.probes]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column(2), pa.array(order.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["id", "v", "asks", "probes"]
                )

    placed = written(clean.mapInArrow(place, "id long, v array<double>, asks boolean, probes array<int>"), "ann-lists")
    removed(spark, clean)
    counts = {r["l"]: r["n"] for r in placed.groupBy(F.col("probes")[0].alias("l")).agg(F.count("*").alias("n")).collect()}
    chunks = F.create_map(*[F.lit(x) for l, n in sorted(counts.items()) for x in (l, -(-n // o.chunk))])
    asked = placed.where("asks").count()
    blocks = max(1, -(-asked // o.query_block))
    own = placed.select(
        F.col("probes")[0].alias("list"), F.pmod(F.xxhash64("id"), chunks[F.col("probes")[0]]).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("asks"), "id", "v",
    )
    questions = (
        placed.where("asks").select("id", "v", F.explode("probes").alias("list"))
        .where(F.coalesce(chunks[F.col("list")], F.lit(0)) > 0)
        .select(
            "list", F.explode(F.sequence(F.lit(0), chunks[F.col("list")] - 1)).alias("chunk"),
            F.pmod(F.hash("id"), F.lit(blocks)).alias("block"), F.lit(True).alias("asks"), "id", "v",
        )
    )

    def near(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        ids = table.column("id").to_numpy()
        v = table.column("v").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, d)
        out: list[tuple] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if asks.any() and not asks.all():
            mine, names = v[~asks], ids[~asks]
            turned = np.asfortranarray(mine @ shared.value.rotation)
            for q, qid in zip(v[asks], ids[asks]):
                # The query itself, if it is in this list, is one more to keep.
                some = scan(q @ shared.value.rotation, turned, replace(o, nearest=o.nearest + 1) if (names == qid).any() else o)
                some = some[names[some] != qid]
                apart = np.sqrt(((mine[some] - q) ** 2).sum(1))
                best = np.lexsort((names[some], apart))[: o.nearest]
                out.append((np.full(len(best), qid), names[some][best], apart[best]))
        return pa.table({"query_id": np.concatenate([x[0] for x in out]), "vec_id": np.concatenate([x[1] for x in out]), "score": np.concatenate([x[2] for x in out])})

    found = own.unionByName(questions).groupBy("list", "chunk", "block").applyInArrow(near, answer)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= o.nearest).select("query_id", "rank", "vec_id", "score")
