import random
from itertools import combinations

import numpy as np
import pytest

from remanence.llm import near_dup


def sets_of(rows, words):
    out = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        k = min(words, len(w))
        out.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    return out


def brute(rows, words):
    sets = sets_of(rows, words)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[k]["doc_id"] for k in range(len(rows)) if find(k) == find(i) and rows[k]["doc_id"] is not None] if sets[i] else [r["doc_id"]]
        low = min([x for x in ids if x is not None], default=None)
        out.append((r["doc_id"], len(sets[i]), low, low is None or r["doc_id"] == low))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", ["corpus", "edges"])
@pytest.mark.parametrize("words", [2, 5])
def test_components_agree_with_all_pairs(name, words, request):
    docs = request.getfixturevalue(name)
    assert sorted((tuple(r) for r in near_dup.groups(docs, words).collect()), key=str) == brute(docs.collect(), words)


def test_chain_and_ring_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 5)
    rng = random.Random(9)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in rng.sample(range(120), rng.randint(1, 16)):
            words[k] = f"m{i}x{k}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in near_dup.groups(docs, 2).collect()), key=str) == brute(docs.collect(), 2)


def test_blocks_return_fewer_links_than_members(spark, monkeypatch):
    """A large group of near copies: small blocks, many components, one link a union."""
    monkeypatch.setattr(near_dup, "BLOCK", 7)
    monkeypatch.setattr(near_dup, "SHINGLES", 900)
    rng = random.Random(4)
    rows = []
    for i in range(150):
        words = [f"t{k}" for k in range(100)]
        for k in rng.sample(range(100), rng.choice([1, 2, 9, 12])):
            words[k] = f"m{i}x{k}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    real = near_dup.components
    monkeypatch.setattr(near_dup, "components", lambda edges: found.append(edges.count()) or real(edges))
    assert sorted((tuple(r) for r in near_dup.groups(docs, 2).collect()), key=str) == brute(docs.collect(), 2)
    assert found[0] <= 150


def test_a_block_joins_what_it_links_once():
    base = np.arange(100, dtype=np.uint64) << np.uint64(50)
    sets = [np.sort(np.append(base[:95], np.arange(5, dtype=np.uint64) + np.uint64(100 * k + 7))) for k in range(30)]
    ranks = near_dup._rank_table()
    rows = {
        "node": [bytes([k]) for k in range(30)], "label": [bytes([k]) for k in range(30)], "n": [100] * 30, "own": [0] * 30, "square": [True] * 30,
        "signature": [near_dup.registers(s, ranks).tobytes() for s in sets], "hashes": [s.tobytes() for s in sets],
    }
    joined = set()
    for band in range(near_dup.BANDS):
        a, b = near_dup._Block(rows | {"band": [band] * 30}).links()
        assert len(a) < 30
        joined |= set(zip(a, b))
    assert len({x for pair in joined for x in pair}) == 30


def test_repeated_ids_keep_the_least_row(spark):
    rows = [(1, "b text of one", "z"), (1, "a text of one", "y"), (1, "a text of one", "x"), (None, "q", "r")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    assert sorted(map(str, (tuple(r) for r in near_dup.survivors(docs, 5).collect()))) == [str((1, "a text of one", "x")), str((None, "q", "r"))]


def test_empty_table(nothing):
    assert near_dup.groups(nothing).collect() == []


def test_survivors_keep_one_of_a_group(corpus):
    kept = near_dup.survivors(corpus, 5)
    assert kept.columns == corpus.columns
    wanted = {r[0] for r in brute(corpus.collect(), 5) if r[3]}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(wanted)


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(4)
    ranks = near_dup._rank_table()
    for share in (0.3, 0.6, 0.9):
        errors = []
        for _ in range(60):
            both = rng.integers(0, 2**64, 1000, dtype=np.uint64)
            common = int(1000 * 2 * share / (1 + share))
            a, b = np.unique(both), np.unique(np.append(both[:common], rng.integers(0, 2**64, 1000 - common, dtype=np.uint64)))
            errors.append(near_dup.estimate(near_dup.registers(a, ranks), near_dup.registers(b, ranks)) - share)
        assert abs(np.mean(errors)) < 0.02
