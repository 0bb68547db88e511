"""Vector search in blocks against every pair measured by Spark's own sums."""

import random

import pytest
from pyspark.sql import functions as F

from remanence.functions.vector import cosine
from remanence.operators import search
from remanence.plans import search as plans


def pairwise(vectors, queries, limit):
    far = F.coalesce(1 - cosine("embedding", "vector"), F.lit(1.0))  # vectors of two lengths have no product
    pairs = vectors.join(queries, F.col("id") != F.col("own")).withColumn("distance", F.round(far, 6))
    return search.top(pairs, "query_id", [F.asc("distance"), F.asc("id")], limit).select("query_id", "id", "rank", "distance")


def listed(df):
    return sorted(str(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("blocks", [(8192, 4096, 256), (16, 8, 3)])
def test_blocks_find_what_all_pairs_give(spark, monkeypatch, kind, blocks):
    for name, size in zip(("BLOCK", "ASKING", "SLICE"), blocks):
        monkeypatch.setattr(search, name, size)
    rng = random.Random(5)
    drawn = [[rng.choice((-1.0, 0.5, 1.0, 2.0)) * (1 + 1e-7 * rng.random()) for _ in range(4)] for _ in range(60)]
    odd = [None, [], [0.0] * 4, [1.0], [1.0, None, 2.0, 3.0], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 1.0, 1.0], [1e-160] * 4, [1e160, 1.0, 1.0, 1.0]]
    rows = list(enumerate(drawn + odd + [[1.0, 2.0, 0.5, 1.0]] * 40))
    v = spark.createDataFrame(rows, "id long, embedding array<double>").withColumn("id", F.col("id").cast(kind))
    q = v.where("cast(id as int) % 3 = 0").select(F.concat(F.lit("q"), "id").alias("query_id"), F.col("id").alias("own"), F.col("embedding").alias("vector"))
    assert listed(search.nearest(v, q, "id", 7, own="own")) == listed(pairwise(v, q, 7))
    assert listed(search.nearest(v, q, "id", 7, most=0.5, own="own")) == listed(pairwise(v, q, 7).where("distance <= 0.5"))


def test_empty_sides_find_nothing(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    q = v.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    assert search.nearest(v.where("false"), q, "id", 3).collect() == search.nearest(v, q.where("false"), "id", 3).collect() == []
    assert [tuple(r) for r in search.nearest(v, q, "id", 3).collect()] == [(1, 1, 1, 0.0)]


def test_no_plan_expands_all_pairs(spark):
    plan = plans._vector_rank(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
