"""The alignment of two tokenizers against their libraries' whole-text ids."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from remanence.llm import alignment

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD_TEXTS = [
    None, "", " ", "  ", "\n", " \n x", "a\tb c\t d", "x▁ y", "don't stop, it's 12,5.\n\nNew  line. end \n ", "漢字 かな。 emoji \U0001f642\U0001f642 x",
    "<s> </s> <0x41> <|endoftext|> ok", "a" * 3000, "e.g. etc. Mr. (x), y; z!? ...", "a　b c  d", "x\r\ny \r z", "'s 't we'll I'm", "a\x00b ﬁ é", "one two", "one two",
]


@pytest.fixture(scope="module")
def plain():
    """Ids and groups of whole texts, by set operations on token ends."""
    a, b = Tokenizer.from_file(A_PATH), SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    alphabet = alignment.byte_alphabet()

    def groups(text):
        if not text:
            return None
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        data = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if any(b"".join(d) != (" " + text).encode() for d in data):
            return None
        ends = []
        for tokens in data:
            ends.append([sum(map(len, tokens[: k + 1])) for k in range(len(tokens))] if len(tokens) < 500 else running(tokens))
        out, before = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            out.append([[i for i, e in zip(ids[s], ends[s]) if before < e <= cut] for s in (0, 1)] if len(text) < 400 else sliced(ids, ends, before, cut))
            before = cut
        return out

    def running(tokens):
        total, out = 0, []
        for t in tokens:
            total += len(t)
            out.append(total)
        return out

    def sliced(ids, ends, before, cut):
        import bisect

        return [ids[s][bisect.bisect_right(ends[s], before) : bisect.bisect_right(ends[s], cut)] for s in (0, 1)]

    return groups


def expected(rows, plain):
    found = [plain(text) for _, text in rows]
    links = [[(p, q) for a, b in g or [] for p in a for q in b] for g in found]
    counts = Counter(pair for own in links for pair in set(own))
    highest = {}
    for (p, _), n in counts.items():
        highest[p] = max(n, highest.get(p, 0))
    out = []
    for (name, _), g, own in zip(rows, found, links):
        written = ";".join("|".join(",".join(map(str, side)) for side in group) for group in g or [])
        out.append((
            name, sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), len(own), sum(counts[x] == highest[x[0]] for x in own), sum(counts[x] for x in own),
            hashlib.sha256(written.encode()).hexdigest() if g else "",
        ))
    return sorted(out, key=str)


def test_aligned_is_the_plain_alignment(spark, plain, corpus):
    rows = [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").limit(60).collect()] + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id here"), (1000, "one two")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, pairs string, chunk int").repartition(3)
    got = alignment.aligned(docs, A_PATH, B_PATH, chunk=500)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows, plain)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_pair_counts_and_groups(spark, plain):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    groups = {r.doc_id: [[list(g.a), list(g.b)] for g in r.groups] for r in alignment.groups(docs, A_PATH, B_PATH).collect()}
    assert groups == {i: plain(t) or [] for i, t in rows}
    counts = Counter(pair for i in groups for pair in {(p, q) for a, b in groups[i] for p in a for q in b})
    got = alignment.pair_counts(docs, A_PATH, B_PATH, chunk=20).collect()
    assert {(r.a_id, r.b_id): r.documents for r in got} == counts
    assert all(r.best == (r.documents == max(n for (p, _), n in counts.items() if p == r.a_id)) for r in got)


def test_long_group_is_counted_without_listing_it():
    """A group of many tokens on both sides gives few distinct pairs."""
    aligner = alignment.own_aligner(A_PATH, B_PATH)
    one, two, other = aligner.a_bytes.index(b"a"), aligner.a_bytes.index(b"aa"), aligner.b_bytes.index(b"aa")
    n = 30_000
    ids_a, ids_b = np.array([one, *[two] * n, one]), np.array([other] * (n + 1))
    sizes, groups, pairs, times, counts = aligner.align(ids_a, np.array([n + 2]), ids_b, np.array([n + 1]))
    assert sizes[0].tolist() == [n + 2, n + 1, 1, (n + 2) * (n + 1), 0] and counts.tolist() == [2]
    assert dict(zip((pairs >> 32).tolist(), times.tolist())) == {one: 2 * (n + 1), two: n * (n + 1)}
    assert groups[0].count(",") == 2 * n + 1


def test_nothing(nothing):
    assert alignment.aligned(nothing, A_PATH, B_PATH).count() == 0
    assert alignment.pair_counts(nothing, A_PATH, B_PATH).count() == 0
