"""Names in texts against a plain search for every alias."""

import random
import re

from remanence.functions import aliases

ROWS = [("Anna Maria Berg", "person", "Anna Maria"), ("Anna Maria Berg", "person", "the old neighbour"), ("Anna Kahn", "person", "Anna"), ("Li Ming", "person", "李明"), ("Li Ming", "person", "Ming"), ("law", "slang", "法"), ("both", "person", "Sam"), ("other", "person", "sam"), ("none", "person", " "), (None, "person", "lost")]


def found(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    dictionary = spark.createDataFrame(ROWS, "canonical string, kind string, alias string")
    return {r.n: [f.canonical for f in r.found] for r in frame.select("n", aliases.matcher(dictionary)("text").alias("found")).collect()}


def test_longest_names_of_several_words(spark):
    got = found(spark, ["I met ANNA  maria today", "Anna, not Maria", "about 李明和法律", "法 is a word", "无法 方法", "ask Sam", None, "", "the old\nneighbour of Anna and Ming", "Anna Anna"])
    assert got == {0: ["Anna Maria Berg"], 1: ["Anna Kahn"], 2: ["Li Ming"], 3: ["law"], 4: [], 5: ["both", "other"], 6: [], 7: [], 8: ["Anna Maria Berg", "Anna Kahn", "Li Ming"], 9: ["Anna Kahn"]}


def test_thousands_of_aliases(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(2, 5)))
    rows = [(f"c{i}", "person", f"{word()} {word()}") for i in range(2000)]
    known = aliases.Aliases(rows)
    for _ in range(40):
        text = " ".join(word() for _ in range(30))
        body = re.sub(r"\s+", "", text)
        plain = {(m.start(), m.start() + len(a)) for _, _, a in ((c, k, x.replace(" ", "")) for c, k, x in rows) for m in re.finditer(f"(?={a})", body)}
        taken = []
        for begin, end in sorted(plain, key=lambda p: (p[0] - p[1], p[0])):
            if all(end <= b or e <= begin for b, e in taken):
                taken.append((begin, end))
        wanted = [(c, k, a) for b, e in sorted(taken) for c, k, a in rows if a.replace(" ", "") == body[b:e]]
        assert list(known.matches(text)) == wanted


def test_an_empty_dictionary(spark):
    nothing = spark.createDataFrame([], "canonical string, kind string, alias string")
    assert spark.createDataFrame([("x",)], "text string").select(aliases.matcher(nothing)("text").alias("f")).first().f == []
