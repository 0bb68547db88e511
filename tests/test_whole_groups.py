"""Groups take in every vector of the table."""

import pytest
from pyspark.sql import functions as F

from remanence.plans import catalog, more

SF = "/root/testdata/sf0.001"


def test_every_vector_is_in_one_group(spark):
    groups = more._groups(spark, SF).collect()
    members = [m for g in groups for m in g["members"]]
    wanted = [f"d{r['vec_id']}" for r in more.T.vectors(spark, SF).collect()]
    assert sorted(members) == sorted(wanted) and all(2 <= len(g["members"]) <= 6 for g in groups)
    assert len({g["group_id"] for g in groups}) == len(groups)
    assert catalog.queries()["j19_group_signals"](spark, SF).count() == len(groups)


@pytest.mark.parametrize("n, sizes", [(1, [1]), (2, [2]), (5, [5]), (6, [6]), (7, [2, 5]), (11, [5, 6])])
def test_a_single_rest_joins_its_neighbour(spark, monkeypatch, n, sizes):
    v = spark.range(n).select(F.col("id").alias("vec_id"), F.lit(0).alias("label"), F.concat(F.lit("d"), F.col("id")).alias("memory_id"))
    monkeypatch.setattr(more.T, "vectors", lambda *_: v)
    assert sorted(len(g["members"]) for g in more._groups(spark, SF).collect()) == sizes
