"""Comparisons of linked records alone, and one pass over two versions of a table."""

from remanence.operators import maintenance, proposals


def test_edges_within_a_mark(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("c", "c"), ("a", "d")], "a string, b string")
    vectors = spark.createDataFrame([("a",), ("b",), ("c",)], "memory_id string")
    marks = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("c", "z"), ("d", "x")], "memory_id string, domain string")
    assert [tuple(r) for r in proposals.within(edges, vectors, marks, "domain").collect()] == [("a", "b")]


def test_rows_that_only_one_side_has(spark):
    kind = "k int, v double"
    before = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, None), (3, 0.5)], kind)
    after = spark.createDataFrame([(1, 1.0), (2, None), (4, 0.5)], kind)
    whole = before.exceptAll(after).count() + after.exceptAll(before).count()
    assert maintenance._moved(before, after) == whole == 3
    assert maintenance._moved(before.limit(0), after.limit(0)) == 0
