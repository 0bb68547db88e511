"""Removal of repeated passages against plain windows, and against SQL."""

import hashlib
import random
import re

import duckdb
import pytest

from remanence.llm import catalog, repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(rows):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - 12):
                p = tuple(w[k : k + 13])
                first[p] = min(i, first.get(p, i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - 12) if i is not None else ():
            if first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def passages(n=120, seed=3):
    """Texts of random words with shared passages of 12 to 80 words, copies,
    passages at the ends, within themselves, overlapping one another."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randint(0, 60))
    shared = [[word() for _ in range(rng.choice([12, 13, 14, 20, 51, 80]))] for _ in range(25)]
    shared += [s[3:] + shared[0][:9] for s in shared[:6]]
    rows = []
    for i in range(n):
        text = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at = rng.choice([0, len(text), rng.randint(0, len(text))])
            text[at:at] = rng.choice(shared)
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(text)))
    rows += [(n + k, rows[rng.randrange(n)][1]) for k in range(20)]
    rows += [(n + 30 + k, "x " * 40) for k in range(3)] + [(-5, rows[7][1]), (None, rows[9][1]), (None, rows[9][1]), (7, rows[8][1]), (7, rows[8][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk, patterns", [(1 << 19, 80_000), (300, 7)])
def test_removed_words_are_the_plain_ones(spark, chunk, patterns):
    rows = passages()
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, chunk int, words string").repartition(3)
    got = sorted(map(tuple, repeats.digests(docs, chunk, patterns).collect()), key=str)
    assert got == expected(rows)
    assert sum(g[2] for g in got) > 500


def test_text_and_ranges_belong_together(spark):
    rows = passages(40)
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    texts = {}
    for r in repeats.without_repeats(docs).collect():
        assert hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256
        assert len(r.text.split()) == r.n_words - sum(s.end - s.begin for s in r.removed)
        texts.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        w = WORD.findall(t)
        assert any(" ".join(x for k, x in enumerate(w) if not any(s.begin <= k < s.end for s in r.removed)) == r.text for r in texts[i])


def test_edges(spark, edges, nothing):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    assert sorted(map(tuple, repeats.digests(edges).collect()), key=str) == expected(rows)
    assert repeats.digests(nothing).count() == 0
    tables = [t.name for t in spark.catalog.listTables() if t.name.startswith("repeat_chunks")]
    assert not tables


def test_phrases_spelled_alike_are_told_apart(spark):
    """Texts that differ in one word of every window, in words of all letters."""
    base = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(base))]
    for k in range(2, 200):
        changed = list(base)
        for at in range(6, 40, 12):
            changed[at] = f"v{k}{at}"
        rows.append((k, " ".join(changed)))
    rows.append((500, rows[77][1] + " " + " ".join(base[:13])))
    got = sorted(map(tuple, repeats.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == expected(rows)
    assert [g for g in got if g[0] == 500][0][2] == 53 and sum(g[2] for g in got) == 53


def test_against_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    wanted = con.sql(catalog.OP13_SQL).df()[["doc_id", "n_words", "n_removed", "kept_sha256"]]
    got = catalog.op13_repeats(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.values.tolist()))
