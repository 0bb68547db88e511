"""Independence is judged on whole texts, however long they are."""

import time

import pytest
from pyspark.sql import functions as F

from remanence.functions import text
from remanence.plans import catalog
from remanence.sources import tables as T

SF = "/root/testdata/sf0.001"


def parts(s):
    return {s[i : i + 2] for i in range(len(s) - 1)}


def independent(a, b):
    least = min(len(parts(a)), len(parts(b)))
    return least == 0 or len(parts(a) & parts(b)) / least < 0.72


def test_evidence_is_compared_with_the_whole_text(spark):
    asked = {r["query_id"]: r["text"] for r in T.search_queries(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in T.table(spark, SF, "documents").collect()}
    rows = catalog.queries()["h78_evidence"](spark, SF).select("query_id", "doc_id", "independent").collect()
    assert rows and all(r["independent"] == independent(asked[r["query_id"]], texts[r["doc_id"]]) for r in rows)
    assert any(r["independent"] != independent(asked[r["query_id"]], texts[r["doc_id"]][:400]) for r in rows)


def slots(rows, body):
    """``memory_id: slot`` of the candidates ``(memory_id, rank, final)``."""
    rows = sorted(rows, key=lambda r: (-r[2], r[0]))
    top = next((m for m, rank, final in rows if rank <= 2 and final >= 0.5), None)
    second = next((m for m, rank, final in rows if top and m != top and rank <= 2 and final >= 0.3 and independent(body(m), body(top))), None)
    return {m: 1 if m == top else 2 if m == second else None for m, _, _ in rows}


def test_the_second_slot_is_compared_with_the_whole_first(spark):
    texts = {f"d{r['doc_id']}": r["text"] for r in T.table(spark, SF, "documents").collect()}
    rank = {(r["query_id"], f"d{r['doc_id']}"): r["rank"] for r in catalog.queries()["i01_bm25_search"](spark, SF).collect()}
    got, asked = {}, {}
    for r in catalog.queries()["i23_slots"](spark, SF).collect():
        got.setdefault(r["query_id"], {})[r["memory_id"]] = r["slot"]
        asked.setdefault(r["query_id"], []).append((r["memory_id"], rank[r["query_id"], r["memory_id"]], r["final"]))
    assert got == {q: slots(rows, texts.get) for q, rows in asked.items()}
    assert got != {q: slots(rows, lambda m: texts[m][:300]) for q, rows in asked.items()}


@pytest.mark.parametrize("s, wanted", [("", []), ("a", []), ("ab", ["ab"]), ("aaab", ["aa", "ab"]), ("a😀é漢b", ["a😀", "😀é", "é漢", "漢b"]), ("a\n b", ["a\n", "\n ", " b"]), (None, [])])
def test_bigrams(spark, s, wanted):
    assert spark.createDataFrame([(s,)], "s string").select(text.bigrams(F.col("s"))).first()[0] == wanted


def test_bigrams_of_long_texts_take_no_square(spark):
    """400,000 characters: a look-up of every place by its number takes minutes."""
    long = spark.range(1).select(F.repeat(F.lit("abcdéfgh"), 50_000).alias("s"))
    long.select(F.size(text.bigrams(F.col("s")))).first()
    began = time.perf_counter()
    assert long.select(F.size(text.bigrams(F.col("s")))).first()[0] == 8
    assert time.perf_counter() - began < 20
