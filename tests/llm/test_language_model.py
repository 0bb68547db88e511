import math
import zlib
from collections import Counter

import numpy as np
import pytest

from remanence.llm import ngram_lm
from remanence.llm.ngram_lm import EliasFano, NgramTrie


def brute(rows, folds=10):
    held = [zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % folds == 0 for r in rows]
    texts = [(r["text"] or "").encode().lower().split() for r in rows]
    words, pairs = Counter(), Counter()
    for tokens, out in zip(texts, held):
        if not out:
            before = b"\t"
            for w in [*tokens, b"\n"]:
                words[w] += 1
                pairs[before, w] += 1
                before = w
    total, kinds = sum(words.values()), len(words)
    context = dict(words) | {b"\t": words[b"\n"]}
    after = Counter(p for p, _ in pairs)
    out = []
    for r, tokens, is_held in zip(rows, texts, held):
        base = score = 0.0
        before = b"\t"
        for w in [*tokens, b"\n"]:
            p = (words[w] + 0.1) / (total + 0.1 * (kinds + 1))
            c = context.get(before, 0)
            q = (max(pairs[before, w] - 0.75, 0) + 0.75 * after[before] * p) / c if c else p
            base, score, before = base + math.log10(p), score + math.log10(q), w
        known = sum(words[w] > 0 for w in [*tokens, b"\n"])
        out.append((r["doc_id"], is_held, len(tokens) + 1, known, total, base, score))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))


@pytest.mark.parametrize("name", ["corpus", "edges"])
def test_scores_agree_with_a_plain_model(name, request):
    docs = request.getfixturevalue(name)
    wanted = order(brute(docs.collect()))
    got = order([tuple(r) for r in ngram_lm.score(docs).collect()])
    assert [r[:5] for r in got] == [r[:5] for r in wanted]
    for g, w in zip(got, wanted):
        assert g[5] == pytest.approx(w[5], abs=1e-6)
        assert g[6] == pytest.approx(w[6], abs=g[2] * 4e-4)


@pytest.mark.parametrize("sizes", [ngram_lm.Sizes(300, 500, 40), ngram_lm.Sizes(2000, 100, 7)])
def test_small_chunks_tries_and_split_contexts_change_nothing(corpus, sizes):
    """Many chunks and tries, and frequent contexts dealt to several parts."""
    wanted = order(brute(corpus.collect()))
    got = order([tuple(r) for r in ngram_lm.score(corpus, sizes=sizes).collect()])
    assert [r[:5] for r in got] == [r[:5] for r in wanted]
    for g, w in zip(got, wanted):
        assert g[5] == pytest.approx(w[5], abs=1e-6)
        assert g[6] == pytest.approx(w[6], abs=g[2] * 1e-3)


def test_no_table_stays_in_the_catalog(spark, corpus):
    ngram_lm.score(corpus).collect()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lm_")]


def test_lookup_follows_pointers():
    contexts = np.array([3, 5, 8, 9], dtype=np.uint64)
    trie = NgramTrie.built(contexts, np.array([4, 0, 2, 9]), np.array([0, 0, 0, 2, 3, 3]), np.array([7, 7, 9, 1, 7, 8], dtype=np.uint64), np.array([1, 2, 1, 2, 4, 5]))
    assert trie.pointers.at(np.arange(5)).tolist() == [0, 2, 2, 3, 5]
    # ranks of the words 1, 7, 8, 9 are 0 to 3; each context goes on above the one before
    assert trie.successors.at(np.arange(5)).tolist() == [1, 3, 4 + 0, 5 + 1, 5 + 2]
    asked = np.array([3, 4, 5, 8, 9], dtype=np.uint64)
    pairs = [(c, w) for c in range(5) for w in (1, 7, 8, 9, 2)]
    codes, mass = trie.lookup(asked, np.array([c for c, _ in pairs]), np.array([w for _, w in pairs], dtype=np.uint64))
    chances = {(0, 7): 2.25 / 4, (0, 9): 0.25 / 4, (3, 1): 1.25 / 2, (4, 7): 3.25 / 9, (4, 8): 4.25 / 9}
    assert ngram_lm.restored(codes) == pytest.approx([chances.get(p, 0) for p in pairs], rel=1e-3)
    assert ngram_lm.restored(mass) == pytest.approx([0.75 * 2 / 4, 0, 0, 0.75 / 2, 0.75 * 2 / 9], rel=1e-3)


def test_levels_are_compact():
    values = np.sort(np.random.default_rng(6).integers(0, 10**9, 100_000)).astype(np.uint64)
    kept = sum(a.nbytes for a in EliasFano.coded(values).arrays())
    assert kept * 8 / len(values) < np.log2(10**9 / len(values)) + 3


def test_empty_table(nothing):
    assert ngram_lm.score(nothing).collect() == []


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 1, 1, 7], list(range(1000)), [2**63, 2**64 - 1], sorted(np.random.default_rng(1).integers(0, 2**62, 3000).tolist())])
def test_elias_fano_finds_successors(values, tmp_path):
    kept = np.array(values, dtype=np.uint64)
    coded = EliasFano.coded(kept)
    rng = np.random.default_rng(2)
    asked = np.unique(np.concatenate([kept, kept + np.uint64(1), np.array([0, 2**64 - 1], dtype=np.uint64), rng.integers(0, 2**63, 200).astype(np.uint64)]))
    index, equal = coded.successor(asked)
    assert index.tolist() == np.searchsorted(kept, asked).tolist()
    assert equal.tolist() == np.isin(asked, kept).tolist()
    if len(kept):
        assert coded.at(np.arange(len(kept))).tolist() == kept.tolist()


def test_trie_survives_its_file(tmp_path):
    rng = np.random.default_rng(3)
    contexts = np.unique(rng.integers(0, 2**63, 50).astype(np.uint64))
    context, word = rng.integers(0, len(contexts), 2000), rng.integers(0, 300, 2000).astype(np.uint64)
    count = rng.integers(1, 9, 2000)
    totals = np.bincount(context, weights=count, minlength=len(contexts)).astype(np.int64)
    trie = NgramTrie.built(contexts, totals, context, word, count)
    trie.save(str(tmp_path / "levels"))
    again = NgramTrie.mapped(str(tmp_path / "levels"))
    for a, b in zip(trie.lookup(contexts, context, word), again.lookup(contexts, context, word)):
        assert a.tolist() == b.tolist()
    assert (again.lookup(contexts, context, word)[0] > 0).all()
