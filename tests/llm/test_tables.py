import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from remanence.llm import ann, near_dup, url_filter
from remanence.llm.common import documents

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"), ("block", "org/fr/"), ("block", "a.b.c/x"), (None, "com/")]


def plain_judge(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for action, rule in RULES:
        if action:
            h, p = rule[: rule.index("/")], rule[rule.index("/") :]
            if (host == h or host.endswith("." + h)) and path.startswith(p):
                best = min(best or (1,), (-len(rule), action != "block", rule, action))
    return host, path, best and best[2], best[3] if best else "allow"


URLS = [
    None, "", "nothing", "http://", "http://NET/", "http://net", "https://A.example.NET/en/x?q#z", "ftp://example.net/en", "http://x.example.com/de/1", "http://notexample.com/de/1",
    "http://org/fr/?", "http://a.b.c/xyz", "http://z.a.b.c/x", "http://.../x", "http://" + "a." * 400 + "net/" + "p/" * 400, "http://Ünï.net/ü", "a://b://net/", "http://net?/x", "http://net/\nline",
]


def test_urls(spark):
    rows = [(i, u, "h", "p", "r") for i, u in enumerate(URLS)] + [(5, URLS[5], "h", "p", "r"), (None, URLS[4], "h", "p", "r")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string")
    rules = spark.createDataFrame(RULES, "action string, rule string")
    got = sorted(map(str, (tuple(r) for r in url_filter.judge(pages, rules).collect())))
    assert got == sorted(str((r[0], *plain_judge(r[1]))) for r in rows)
    assert url_filter.judge(pages.where("false"), rules).collect() == []
    assert {r["verdict"] for r in url_filter.judge(pages, rules.where("false")).collect()} == {"allow"}


def vectors(spark, n=600, d=16):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(n, d)).round(3)
    points[50:80] = points[0]
    rows = [(i, p.tolist(), 0) for i, p in enumerate(points)]
    rows += [(1000, None, 0), (1100, [0.0] * d, 0), (1200, [math.nan] + [1.0] * (d - 1), 0), (1300, [None] + [1.0] * (d - 1), 0), (1400, [1.0], 0), (None, [1.0] * d, 0), (1500, [math.inf] * d, 0)]
    return points, spark.createDataFrame(rows + [rows[100]], "vec_id long, embedding array<double>, rank int")


def test_nearest_recall(spark):
    points, table = vectors(spark)
    got = {}
    for r in ann.search(table, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == [0, 100, 200, 300, 400, 500]
    right = 0
    for q, rows in got.items():
        apart = np.sqrt(((points - points[q]) ** 2).sum(1))
        apart[q] = np.inf
        best = np.lexsort((np.arange(len(points)), apart))[:10]
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11)) and q not in [r[1] for r in rows]
        assert all(s == pytest.approx(apart[v], abs=1e-12) for _, v, s in rows)
        right += len(set(best.tolist()) & {r[1] for r in rows})
    assert right >= 0.9 * 60
    assert [r[1] for r in sorted(got[0])] == list(range(50, 60))


def test_scan_keeps_the_nearest_as_its_bound_tightens():
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(3000, 32))
    exact = ann.Options(epsilon=50.0)
    for query in rng.normal(size=(20, 32)):
        apart = ((vectors - query) ** 2).sum(1)
        some = ann.scan(query, vectors, exact)
        assert set(np.argsort(apart)[:10]) <= set(some.tolist()) and len(some) < 600
    assert len(ann.scan(np.zeros(32), vectors[:0], exact)) == 0


def test_nearest_of_few_or_none(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (100, [2.0, 1.0]), (7, [5.0, 5.0])], "vec_id long, embedding array<double>")
    rows = ann.search(few, F.col("vec_id") % 100 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in rows) == [(0, 1, 100), (0, 2, 7), (100, 1, 0), (100, 2, 7)]
    assert ann.search(few.where("false"), F.col("vec_id") % 100 == 0).collect() == []


def test_nearest_of_a_small_list_are_ten(spark):
    """The ten nearest come first in the list, with the query among them."""
    rng = np.random.default_rng(3)
    points = np.vstack([rng.normal(size=(11, 8)) / 100, rng.normal(size=(39, 8)) + 50])
    table = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<double>").coalesce(1)
    o = ann.Options(most_lists=1)
    rows = ann.search(table, F.col("vec_id") == 0, o=o).collect()
    assert sorted(r["vec_id"] for r in rows) == list(range(1, 11))


def test_pipeline_stages(spark):
    """Each stage keeps the columns, and its decision holds for every row."""
    docs = documents(spark, "/root/testdata/sf0.001")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.collect()}
        after = stage(spark, docs, "/root/testdata/sf0.001")
        rows = after.collect()
        assert after.columns == columns and {r["doc_id"] for r in rows} <= before and rows
        if name == "near_duplicates":
            assert len(rows) == len({r["doc_id"] for r in rows})
            assert all(r["kept"] for r in near_dup.groups(after, 5).collect())
        if name == "secret_scan":
            assert len(rows) == len(before) and not any("AKIA" in (r["text"] or "") for r in rows)
        docs = spark.createDataFrame(rows, docs.schema)
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in docs.collect())
