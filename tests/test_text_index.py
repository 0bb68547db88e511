"""The kept index against BM25 over the texts as they are."""

import random

import pytest

from remanence.operators import search, text_index

WORDS = "stone river light garden house morning window water people night the of and".split()


def texts(seed, ids):
    rng = random.Random(seed)
    return {i: " ".join(rng.choice(WORDS) + str(rng.choice(["", "", 1, 2])) for _ in range(rng.randint(0, 30))) for i in ids}


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string")


@pytest.fixture
def questions(spark):
    return spark.createDataFrame([(1, "stone river1"), (2, "the morning of light2 light2"), (3, "nothing known"), (4, None)], "query_id int, text string")


def ranks(df):
    return sorted(map(tuple, df.select("query_id", "doc_id", "rank", "score").collect()))


def test_answers_follow_updates_removals_and_merges(spark, tmp_path, questions):
    docs = texts(1, range(80))
    index = text_index.TextIndex(spark, f"file://{tmp_path}/index")
    index.update(frame(spark, docs))
    assert ranks(index.search(questions)) == ranks(search.bm25(frame(spark, docs), questions))
    fresh = texts(2, range(60, 110))
    index.update(frame(spark, fresh), frame(spark, {3: "", 5: "", 999: ""}).select("doc_id"))
    docs = {i: t for i, t in (docs | fresh).items() if i not in (3, 5)}
    wanted = ranks(search.bm25(frame(spark, docs), questions))
    assert ranks(index.search(questions)) == wanted
    index.update(frame(spark, {3: "stone"}), None)
    docs[3] = "stone"
    assert ranks(index.search(questions, limit=4)) == ranks(search.bm25(frame(spark, docs), questions, limit=4))
    index.merge()
    index.store.vacuum()
    assert len([t for t in index.store.snapshot().tables if t.startswith("postings")]) == 1
    assert ranks(index.search(questions, limit=4)) == ranks(search.bm25(frame(spark, docs), questions, limit=4))


def test_only_asked_folders_are_read(spark, tmp_path, questions, monkeypatch):
    index = text_index.TextIndex(spark, f"file://{tmp_path}/index")
    index.update(frame(spark, texts(3, range(50))))
    asked = spark.createDataFrame([("stone",), ("river1",)], "term string")
    found = index.asked_postings(asked, index.store.snapshot())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan and "PushedFilters: [" in plan and "term" in plan
    assert {r.term for r in found.collect()} == {"stone", "river1"}
    few = ranks(index.search(questions))
    monkeypatch.setattr(text_index, "PUSHED", 1)
    assert ranks(index.search(questions)) == few
