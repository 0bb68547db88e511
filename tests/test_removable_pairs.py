"""The guard of maintenance goes through all candidates."""

from remanence.operators import proposals


def plain(rows, degree, most):
    kept = []
    for a, b, _, _ in sorted(rows, key=lambda r: (r[2], r[3], r[0], r[1])):
        if len(kept) < most and degree[a] > 1 and degree[b] > 1:
            kept.append((a, b))
            degree[a] -= 1
            degree[b] -= 1
    return sorted(kept)


def test_leaves_do_not_hide_removable_pairs(spark):
    rows = [("hub", f"leaf{i}", 0.01, 1) for i in range(30)] + [(f"x{i % 3}", f"y{i}", 0.02 + i % 5 / 100, i) for i in range(20)]
    degree = {"hub": 30, **{f"leaf{i}": 1 for i in range(30)}, "x0": 4, "x1": 9, "x2": 2, **{f"y{i}": 1 + i % 4 for i in range(20)}}
    c, d = spark.createDataFrame(rows, "a string, b string, weight double, fired long"), spark.createDataFrame(list(degree.items()), "memory_id string, degree long")
    for most, batch in ((100, 2), (3, 4), (100, 2000)):
        wanted = plain(rows, dict(degree), most)
        assert wanted and sorted(tuple(r) for r in proposals.removable_pairs(c, d, most, batch).collect()) == wanted


def test_query_reads_past_the_weakest(spark, monkeypatch):
    from pyspark.sql import functions as F

    from remanence.plans import catalog, reports
    edges = [(f"l{i:04}", "hub", 0.01) for i in range(2100)] + [("p", "q", 0.05), ("p", "r", 0.06), ("q", "r", 0.07)]
    flow = spark.createDataFrame(edges, "source_id string, target_id string, weight double").withColumns({"last_fired": F.expr("timestamp_ntz'1998-01-01 00:00:00'"), "provenance": F.lit("cluster")})
    monkeypatch.setattr(reports.T, "flow_edges", lambda *_: flow)
    assert [tuple(r) for r in catalog.queries()["j26_removable_pairs"](spark, "").collect()] == [("p", "q")]
