"""Text search in slices against the plain sum over shared terms."""

import random
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from remanence.functions.text import query_terms, tokens
from remanence.operators import search


def plain(docs, queries, limit):
    asked = queries.select("query_id", F.explode(query_terms(F.col("text"))).alias("term"))
    words = docs.select("doc_id", F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: F.length(t) >= 2).alias("w")).withColumn("length", F.size("w"))
    held = words.select("doc_id", "length", F.explode("w").alias("term")).groupBy("doc_id", "length", "term").agg(F.count("*").alias("tf"))
    corpus = words.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    df = held.groupBy("term").agg(F.count("*").alias("df")).crossJoin(corpus)
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("length") / F.col("mean")))
    summed = asked.join(held.join(df, "term"), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))
    return search.top(summed, "query_id", [F.desc("score"), F.asc("doc_id")], limit).select("query_id", "doc_id", "rank", "score")


def listed(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(11)
    some = [" ".join(rng.choice(("über", "Bär", "x", "two", "three3", "四五", "six-sevens", "É", "the", "rare%d" % rng.randrange(40))) for _ in range(rng.randrange(1, 30))) for _ in range(80)]
    rows = list(enumerate(some + [None, "", " .,", "the"] + ["two three3 the über"] * 60))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = [(i, t) for i, t in enumerate(some[:15] + ["the", "nowhere", "", None, "the two"])]
    return docs, spark.createDataFrame(asked, "query_id int, text string")


@pytest.mark.parametrize("sizes", [(4096, 512, 1024, 2048), (20, 3, 4, 5)])
def test_slices_give_the_plain_ranks(texts, monkeypatch, sizes):
    for name, size in zip(("DOCUMENTS", "PASSAGES", "HEIGHT", "WIDTH"), sizes):
        monkeypatch.setattr(search, name, size)
    docs, asked = texts
    assert listed(search.bm25(docs, asked, limit=6)) == listed(plain(docs, asked, 6))
    named = docs.select(F.col("doc_id").cast("string").alias("memory_id"), "text")
    wanted = plain(docs.withColumn("doc_id", F.col("doc_id").cast("string")), asked, 6)
    assert listed(search.bm25(named, asked, key="memory_id", limit=6)) == listed(wanted)


def test_no_documents_or_questions(texts):
    docs, asked = texts
    assert search.bm25(docs.where("false"), asked).collect() == search.bm25(docs, asked.where("false")).collect() == []


def test_words_are_whole_runs(spark):
    cases = ["", " a bc", "x1-y22 ÀÉ", "𝔸𝔹𝔹 中文字 ½¼", "--ab--", "a_b cd"]
    rows = spark.createDataFrame([(t,) for t in cases], "text string")
    runs = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda t: F.length(t) >= 2)
    assert rows.where(tokens(F.col("text")) != runs).collect() == []


def test_no_join_of_questions_with_postings(texts):
    """What meets by term is a document's terms and the asked ones, each once."""
    docs, asked = texts
    plan = search.bm25(docs, asked)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_texts_are_cut_once_and_keys_that_come_again_are_summed(texts, monkeypatch):
    docs, asked = texts
    plan = search.bm25(docs, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan
    again = docs.union(docs.where("doc_id % 3 = 0"))
    assert listed(search.bm25(again, asked, limit=6)) == listed(plain(again, asked, 6))
    monkeypatch.setattr(search, "SENT", 2)
    assert listed(search.bm25(again, asked, limit=6)) == listed(plain(again, asked, 6))


def test_a_text_is_one_row_of_counts():
    """Whatever its characters, with the counts of the pattern over the text in lower case."""
    rng = random.Random(5)
    some = ["".join(rng.choice("aB9_ .ΑΣσςΒİıKÅß'’éÉ̇四五\x1c\x85\n١²½Ⅷ-\x00ﬁǅ") for _ in range(rng.randrange(40))) for _ in range(1500)] + [None, ""]
    batch = pa.record_batch([pa.array(range(len(some))), pa.array(some)], names=["id", "text"])
    few = ["σσ", "bb", "ας", "99", "四五", "never"]
    for only in (None, SimpleNamespace(value=few)):
        rows = pa.Table.from_batches(search._counter(only)([batch])).to_pylist()
        assert [r["id"] for r in rows] == list(range(len(some)))
        for text, row in zip(some, rows):
            words = search.WORD.findall((text or "").lower())
            named = row["terms"] if only is None else [few[t] for t in row["terms"]]
            assert row["length"] == len(words) and dict(zip(named, row["tf"])) == {w: n for w, n in Counter(words).items() if only is None or w in few}
            assert len(set(named)) == len(named)


@pytest.mark.parametrize("common", [1, 2, 1000])
def test_terms_of_many_and_of_few_queries(texts, monkeypatch, common):
    monkeypatch.setattr(search, "COMMON", common)
    docs, asked = texts
    assert listed(search.bm25(docs, asked, limit=6)) == listed(plain(docs, asked, 6))
