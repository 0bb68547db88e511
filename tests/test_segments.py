"""Words of scripts without blanks: paths, fallbacks, learning, and search."""

import itertools
import math
import random

import pandas as pd
from pyspark.sql import functions as F

from remanence.functions import segments
from remanence.operators import records, text_index


def plain_path(run, words, total, unknown):
    """The best of all ways to cut a run, by trying every one."""
    best = None
    for cuts in itertools.product([False, True], repeat=max(0, len(run) - 1)):
        parts, begin = [], 0
        for k, cut in enumerate(cuts, 1):
            if cut:
                parts.append(run[begin:k])
                begin = k
        parts.append(run[begin:])
        if all(p in words or len(p) == 1 for p in parts):
            weight = sum(math.log(max(words[p], 1)) - total if p in words else unknown for p in parts)
            best = weight if best is None else max(best, weight)
    return best


def test_path_is_the_most_probable_one():
    rng = random.Random(2)
    for _ in range(60):
        words = {"".join(rng.choice("一二三四") for _ in range(rng.randint(1, 4))): rng.randint(1, 50) for _ in range(8)}
        w = segments.Words(words)
        total = math.log(sum(words.values()) + 1)
        run = "".join(rng.choice("一二三四五") for _ in range(rng.randint(1, 9)))
        parts = w.path(run)
        assert "".join(parts) == run
        weight = sum(math.log(words[p]) - total if p in words else w.unknown for p in parts)
        assert abs(weight - plain_path(run, words, total, w.unknown)) < 1e-9


def test_tokens_fall_back_to_bigrams(spark):
    w = segments.Words({"观测站": 9, "观测": 20, "蓝色": 12, "校准": 8})
    assert segments.tokens_of("蓝色观测站正在校准。Hello a B12", w) == ["蓝色", "观测站", "正在", "校准", "hello", "b12"]
    assert segments.tokens_of("观测站", w, search=True) == ["观测", "观测站"]
    assert segments.tokens_of("甲乙丙丁", segments.Words({})) == ["甲乙", "乙丙", "丙丁"]
    assert segments.tokens_of(None, w) == segments.tokens_of("。 x", w) == []
    rows = spark.createDataFrame([("蓝色观测站", 1), (None, 2), ("plain words", 3)], "text string, n int")
    dictionary = spark.createDataFrame([("蓝色", 5), ("观测站", 5), (None, 1), ("蓝色", 2)], "word string, uses long")
    got = {r.n: r.t for r in rows.select("n", segments.segmenter(dictionary)("text").alias("t")).collect()}
    assert got == {1: ["蓝色", "观测站"], 2: [], 3: ["plain", "words"]}


def test_words_are_learned_from_the_texts(spark):
    rng = random.Random(5)
    alphabet = [chr(0x4E00 + i) for i in range(200)]
    known = ["".join(rng.sample(alphabet, rng.choice([2, 3]))) for _ in range(20)]
    texts = [("".join(rng.choice(known) if rng.random() < 0.5 else rng.choice(alphabet) for _ in range(40)),) for _ in range(60)]
    found = {r.word for r in segments.learned(spark.createDataFrame(texts, "text string")).collect()}
    assert len(found & set(known)) >= 18
    assert segments.learned(spark.createDataFrame([], "text string")).count() == 0


def test_history_in_a_script_without_blanks(spark, tmp_path):
    """A question finds its message, and the window around it holds the reply
    and not what was said hours later."""
    rows = [(1, "2020-01-01 00:00:00", "User", "蓝色观测站正在校准。", 1), (2, "2020-01-01 00:01:00", "Agent", "收到，保持校准窗口。", 1), (3, "2020-01-01 03:00:00", "User", "不相关的远处消息。", 1)]
    messages = spark.createDataFrame(rows, "id long, ts string, kind string, text string, conv_id long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for dictionary in (None, spark.createDataFrame([("蓝色", 3), ("观测站", 2)], "word string, uses long")):
        index = text_index.TextIndex(spark, f"file://{tmp_path}/{dictionary is None}", key="id", tokenize=segments.segmenter(dictionary, search=True))
        index.update(messages.select("id", "text"))
        hits = index.search(spark.createDataFrame([(7, "蓝色观测站")], "query_id int, text string"), limit=1)
        placed = records.dialogue_sessions(messages).select(F.col("id"), "conv_id", "session").join(hits.select("id"), "id").withColumnRenamed("id", "hit_id")
        window = [r.window for r in records.dialogue_windows(messages, placed).collect()]
        assert len(window) == 1 and "User: 蓝色观测站" in window[0] and "Agent: 收到" in window[0] and "远处" not in window[0]


def test_tokens_of_few_texts_are_held_at_once(spark):
    """One batch of texts leaves in slices, in order."""
    cut = segments.segmenter().func
    texts = pd.Series([f"x{i} 中文字" for i in range(3 * segments.TEXTS + 1)])
    parts = list(cut(iter([texts])))
    assert max(map(len, parts)) <= segments.TEXTS and pd.concat(parts).tolist() == [segments.tokens_of(t, segments.Words({})) for t in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").coalesce(1)
    assert [r["t"] for r in rows.select("id", segments.segmenter()("text").alias("t")).orderBy("id").collect()] == pd.concat(parts).tolist()
