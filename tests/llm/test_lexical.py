"""Ranked lexical search against a plain scorer of all documents."""

import math
import re
from collections import Counter

import duckdb
import pytest

from remanence.llm import catalog, lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items, limit=10):
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = sum(bool(c) for _, c in counts)
    length = sum(sum(c.values()) for _, c in counts)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(plain_terms(text))
    out = []
    for item, terms in asked.items():
        weight = {t: math.floor(1000 * math.log((2 * held + 2) / (2 * sum(t in c for _, c in counts) + 1))) for t in terms}
        scored = []
        for name, c in counts:
            m = 100 - 90 + 90 * sum(c.values()) * held // max(1, length)
            score = sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, w in weight.items() if c[t])
            if score > 0:
                scored.append((-score, name is None, name or 0, name))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:limit], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def tables(spark, corpus, edges):
    docs = corpus.select("doc_id", "text", F_size()).union(edges.selectExpr("doc_id + 5000", "text", "size"))
    copies = spark.range(40).selectExpr("9000 + id", "'Morning light, MORNING garden water'", "'x'")
    docs = docs.union(copies).repartition(4).cache()
    items = [(1, "the water of the garden"), (2, "MORNING light garden"), (3, "nothingknown"), (4, None), (5, ""), (None, "password wasser"), (None, "stein"), (7, "ünïcödé 漢字 w5 w6"), (7, "stone"), (8, "the the the of")]
    return docs, spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int"), items


def F_size():
    from pyspark.sql import functions as F

    return F.lit("y").alias("score")


def test_ranks_are_the_plain_ones(tables):
    docs, items, listed = tables
    wanted = expected([(r.doc_id, r.text) for r in docs.collect()], listed)
    assert rows(lexical.ranked(docs, items)) == wanted


def test_small_blocks_and_many_sets(tables, monkeypatch):
    docs, items, listed = tables
    monkeypatch.setattr(lexical, "ASKED", 4)
    monkeypatch.setattr(lexical, "TOGETHER", 2)
    wanted = expected([(r.doc_id, r.text) for r in docs.collect()], listed, limit=3)
    assert rows(lexical.ranked(docs, items, limit=3)) == wanted


def test_bounds_hold_for_every_posting(tables):
    """Impacts are rounded upwards by less than a step."""
    import numpy as np

    index = lexical.build(tables[0])
    for row in index.blocks.collect():
        tf, doc = np.frombuffer(row["tf"], "<u4").astype(np.int64), np.frombuffer(row["docs"], "<u4")
        exact = lexical._frequencies(tf, lexical._normal(np.frombuffer(row["lengths"], "<i8"), index.documents, index.length)[doc])
        impact = np.frombuffer(row["impacts"], "u1").astype(np.int64) * lexical.STEP
        assert (impact >= exact).all() and (impact - lexical.STEP < exact).all()


def test_kept_index_answers_again(spark, tables, tmp_path):
    docs, items, _ = tables
    index = lexical.build(docs)
    lexical.stored(index, f"file://{tmp_path}/index")
    again = lexical.opened(spark, f"file://{tmp_path}/index")
    assert (again.documents, again.length) == (index.documents, index.length)
    assert rows(lexical.search(again, items)) == rows(lexical.search(index, items))


def test_empty_tables(spark, nothing, tables):
    docs, items, _ = tables
    assert lexical.ranked(nothing, items).count() == 0
    assert lexical.ranked(docs, items.limit(0)).count() == 0


def test_against_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/sf0.001/{name}.parquet'")
    wanted = con.sql(catalog.OP12_SQL).df()[["item_id", "rank", "doc_id", "score"]]
    assert rows(catalog.op12_lexical(spark, "/root/testdata/sf0.001")) == sorted(map(tuple, wanted.values.tolist()), key=str)
