"""Language-model scoring with an Elias-Fano n-gram trie (operator 1).

The model is a bigram model with interpolated absolute discounting over an
additive unigram base, so probabilities over the vocabulary and one unknown
word sum to one. Its tries hold contexts, successors and quantised smoothed
probabilities:

- level 1 is the sorted context names, a monotone sequence, with monotone
  pointers to where each context's successors begin in
- level 2, the successors of all contexts. A successor is stored relative to its
  context: its word rank above the last value of the context before. A lookup
  follows the context's pointers to its range, takes the value before the range
  as its base, and is one successor search for base plus word rank.

Both levels and the pointers are Elias-Fano coded, with a rank sample every 512
bits, in one file that is memory-mapped for lookups. The n-grams are dealt to tries by context; a context with
very many tokens is dealt to several by successor, so no trie grows with one
frequent word.

The model is never gathered. Documents are tokenised once into chunks; a chunk
sends each trie its distinct n-grams with their training counts, the trie is
built from what all chunks sent, and answers each chunk's lookups. Two such
exchanges, for words and for pairs, move distinct n-grams only; a chunk sends a
trie nothing if it holds none of its n-grams, so there are never more messages
than distinct n-grams of chunks.

Defined results: a null or empty text is its end token alone. Null doc_ids fold
as ''. Repeated rows are counted and scored each. With no training row every
probability is the base's. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import fold, removed, scratch_dir, written
from .near_dup import _mix

DISCOUNT, ADDED = 0.75, 0.1
#: Quantisation: codes are steps of log10 probability, 0 is 'not seen'.
STEP = 1 / 4096
END, BEGIN = b"\n", b"\t"


@dataclass(frozen=True)
class Sizes:
    """What one task holds, in tokens: of a chunk; of training text a trie; of
    training text after one context, beyond which the context is split."""

    chunk: int = 1_000_000
    trie: int = 2_000_000
    part: int = 1_000_000


#: High words (of 64 bits) for each rank sample.
SAMPLE = 8


class EliasFano:
    """A monotone sequence of integers as low bits and unary high parts.

    Arrays may be memory-mapped; lookups touch only the words they need.
    ``ranks`` holds the ones before every ``SAMPLE`` words of the high part.
    """

    def __init__(self, size: int, low_bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.size, self.low_bits, self.low, self.high, self.ranks = size, low_bits, low, high, ranks

    @classmethod
    def coded(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        shift = np.uint64(bits)
        highs = (values >> shift).astype(np.int64)
        ones = highs + np.arange(n)
        words = int(ones[-1] // 64 + 2) if n else 1
        high = np.zeros(-(-words // SAMPLE) * SAMPLE, dtype=np.uint64)
        np.bitwise_or.at(high, ones // 64, np.uint64(1) << (ones % 64).astype(np.uint64))
        ranks = np.append(0, np.cumsum(np.bitwise_count(high).astype(np.int64).reshape(-1, SAMPLE).sum(1)))
        low = np.zeros(n * bits // 64 + 2, dtype=np.uint64)
        if bits:
            at = np.arange(n, dtype=np.uint64) * shift
            word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            part = values & ((np.uint64(1) << shift) - np.uint64(1))
            np.bitwise_or.at(low, word, part << off)
            spill = off + shift > 64
            np.bitwise_or.at(low, word[spill] + 1, part[spill] >> (np.uint64(64) - off[spill]))
        return cls(n, bits, low, high, ranks)

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.size, self.low_bits], dtype=np.int64), self.low, self.high, self.ranks]

    def _lows(self, index: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(index), dtype=np.uint64)
        shift = np.uint64(self.low_bits)
        at = index.astype(np.uint64) * shift
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        value = self.low[word] >> off
        spill = off + shift > 64
        value[spill] |= self.low[word[spill] + 1] << (np.uint64(64) - off[spill])
        return value & ((np.uint64(1) << shift) - np.uint64(1))

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Bit position of the one, or zero, number k (from 0): from the rank
        sample before it, word by word, then by halves of the word."""
        before = np.arange(len(self.ranks)) * (64 * SAMPLE) - self.ranks if zeros else self.ranks
        group = np.minimum(np.searchsorted(before, k, side="right") - 1, len(self.ranks) - 2)
        word, rest = group * SAMPLE, k - before[group]
        flip = np.uint64(0xFFFFFFFFFFFFFFFF if zeros else 0)
        for _ in range(SAMPLE - 1):
            count = np.bitwise_count(self.high[word] ^ flip).astype(np.int64)
            move = (rest >= count) & (word % SAMPLE < SAMPLE - 1)
            if not move.any():
                break
            rest, word = np.where(move, rest - count, rest), np.where(move, word + 1, word)
        bits = self.high[word] ^ flip
        place = np.zeros(len(k), dtype=np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            part = bits & np.uint64((1 << width) - 1)
            count = np.bitwise_count(part).astype(np.int64)
            move = rest >= count
            rest = np.where(move, rest - count, rest)
            bits = np.where(move, bits >> np.uint64(width), part)
            place += np.where(move, width, 0)
        return word * 64 + place

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first element >= value, and whether it is equal."""
        values = values.astype(np.uint64)
        if not self.size:
            return np.zeros(len(values), dtype=np.int64), np.zeros(len(values), dtype=bool)
        shift = np.uint64(self.low_bits)
        highs = values >> shift
        most = 64 * len(self.high) - self.size - 1
        over = highs > np.uint64(most)
        h = np.minimum(highs, np.uint64(most)).astype(np.int64)
        end = self._select(h, True) - h
        start = np.where(h > 0, self._select(np.maximum(h - 1, 0), True) - h + 1, 0)
        want = values & ((np.uint64(1) << shift) - np.uint64(1)) if self.low_bits else np.zeros(len(values), dtype=np.uint64)
        lo, hi = start, end.copy()
        while True:
            open_ = lo < hi
            if not open_.any():
                break
            middle = np.where(open_, (lo + hi) // 2, 0)
            less = open_ & (self._lows(middle) < want)
            lo = np.where(less, middle + 1, lo)
            hi = np.where(open_ & ~less, middle, hi)
        found = (lo < end) & ~over
        equal = found.copy()
        equal[found] = self._lows(lo[found]) == want[found]
        return np.where(over, self.size, lo), equal

    def at(self, index: np.ndarray) -> np.ndarray:
        """Elements by index, through selection of ones."""
        return (self._select(index, False) - index).astype(np.uint64) << np.uint64(self.low_bits) | self._lows(index)


def quantised(chances: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities in steps of their logarithm; 0 stays 0."""
    with np.errstate(divide="ignore"):
        codes = np.rint(-np.log10(chances) / STEP) + 1
    return np.where(chances > 0, np.clip(codes, 1, 65_535), 0).astype(np.uint16)


def restored(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** (-(codes.astype(float) - 1) * STEP), 0)


class NgramTrie:
    """Contexts -> successors -> quantised log10 probability."""

    def __init__(self, contexts: EliasFano, words: EliasFano, pointers: EliasFano, successors: EliasFano, codes: np.ndarray, backoff: np.ndarray):
        self.contexts, self.words, self.pointers, self.successors = contexts, words, pointers, successors
        self.codes, self.backoff = codes, backoff

    @classmethod
    def built(cls, contexts: np.ndarray, totals: np.ndarray, context: np.ndarray, word: np.ndarray, count: np.ndarray) -> NgramTrie:
        """From sorted distinct ``contexts`` with their training ``totals``, and
        n-grams (index of context, word name, count), which may repeat."""
        words, word_rank = np.unique(word, return_inverse=True)
        width = max(1, len(words))
        pair = context.astype(np.int64) * width + word_rank
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else np.empty(0, np.int64)
        counts = np.add.reduceat(count[order], first) if len(first) else np.empty(0)
        owner, place = np.divmod(pair[first], width)
        kinds = np.bincount(owner, minlength=len(contexts))
        pointers = np.append(0, np.cumsum(kinds))
        reach = np.zeros(len(contexts), dtype=np.int64)
        reach[kinds > 0] = place[pointers[1:][kinds > 0] - 1] + 1
        relative = (np.cumsum(reach) - reach)[owner] + place
        with np.errstate(divide="ignore", invalid="ignore"):
            kept = (counts - DISCOUNT) / totals[owner]
            backoff = np.where((totals > 0) & (kinds > 0), DISCOUNT * kinds / totals, 0)
        codes, backoff = quantised(kept), quantised(backoff)
        return cls(*(EliasFano.coded(x) for x in (contexts, words, pointers, relative)), codes, backoff)

    def save(self, path: str) -> None:
        parts = [a for ef in (self.contexts, self.words, self.pointers, self.successors) for a in ef.arrays()] + [self.codes, self.backoff]
        with open(path, "wb") as file:
            file.write(np.array([len(p) for p in parts], dtype=np.int64).tobytes())
            for p in parts:
                file.write(np.ascontiguousarray(p).tobytes() + b"\0" * (-p.nbytes % 8))

    @classmethod
    def mapped(cls, path: str) -> NgramTrie:
        data = np.memmap(path, dtype=np.uint8, mode="r")
        kinds = [np.int64, np.uint64, np.uint64, np.int64] * 4 + [np.uint16, np.uint16]
        sizes, at, parts = data[: 8 * len(kinds)].view(np.int64), 8 * len(kinds), []
        for kind, n in zip(kinds, sizes.tolist()):
            bytes_ = n * np.dtype(kind).itemsize
            parts.append(data[at : at + bytes_].view(kind))
            at += bytes_ + -bytes_ % 8
        levels = [EliasFano(int(p[0][0]), int(p[0][1]), *p[1:]) for p in (parts[i : i + 4] for i in range(0, 16, 4))]
        return cls(*levels, parts[16], parts[17])

    def lookup(self, contexts: np.ndarray, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of n-grams (index in ``contexts``, word name), 0 if not seen,
        and codes of the backoff mass of each context."""
        rank, known = self.contexts.successor(contexts)
        backoff = np.where(known, self.backoff[np.where(known, rank, 0)], 0) if len(self.backoff) else np.zeros(len(contexts), np.uint16)
        begin, end, base = (np.zeros(len(contexts), dtype=np.int64) for _ in range(3))
        begin[known], end[known] = self.pointers.at(rank[known]), self.pointers.at(rank[known] + 1)
        inner = known & (begin > 0)
        base[inner] = self.successors.at(begin[inner] - 1).astype(np.int64) + 1
        place, exists = self.words.successor(word)
        possible = np.flatnonzero(exists & (begin < end)[context])
        codes = np.zeros(len(word), dtype=np.uint16)
        index, same = self.successors.successor(base[context[possible]] + place[possible])
        same &= index < end[context[possible]]
        codes[possible[same]] = self.codes[index[same]]
        return codes, backoff


def _pack(array: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(array).tobytes(), 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype=kind)


def _one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of batches, of which only one is unpacked at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Tokenised chunks of a partition: their words, and documents as numbers of
    words. Number 0 is the end of a text, 1 its beginning."""
    part, made = TaskContext.get().partitionId(), itertools.count()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([part << 32 | next(made)], pa.int64()), pa.array([names], pa.list_(kind)), pa.array([held], pa.list_(pa.bool_())),
            pa.array([_pack(np.array([len(t) for t in texts], dtype="<i4"))]), pa.array([_pack(np.concatenate(texts).astype("<i4"))]),
            pa.array([zstandard.compress(b" ".join(number), 1)]),
        ], names=["chunk", "doc_ids", "held", "lengths", "tokens", "words"])

    names, held, texts, total = [], [], [], 0
    number: defaultdict[bytes, int] = defaultdict(itertools.count(2).__next__)
    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for doc_id, is_held, text in zip(*(c.to_pylist() for c in batch.columns)):
            tokens = (text or "").encode("utf-8", "replace").lower().split()
            numbers = np.fromiter(itertools.chain(map(number.__getitem__, tokens), (0,)), dtype=np.int32, count=len(tokens) + 1)
            names.append(doc_id)
            held.append(is_held)
            texts.append(numbers)
            total += len(numbers)
            if total >= most:
                yield flush()
                names, held, texts, total = [], [], [], 0
                number = defaultdict(itertools.count(2).__next__)
    if names:
        yield flush()


class _Chunk:
    """A chunk's arrays, and its requests in an order that can be made again."""

    def __init__(self, row: dict, part: int):
        self.part = part
        words = zstandard.decompress(row["words"])
        self.names = [END, BEGIN, *(words.split(b" ") if words else [])]
        self.tokens = _unpack(row["tokens"], "<i4").astype(np.int64)
        self.lengths = _unpack(row["lengths"], "<i4").astype(np.int64)
        self.doc_ids, self.held = row["doc_ids"], np.array(row["held"], dtype=bool)
        self.train = np.repeat(~self.held, self.lengths)
        self.hash = np.fromiter(map(xxhash.xxh3_64_intdigest, self.names), dtype=np.uint64, count=len(self.names))

    def word_shards(self, shards: int) -> list[np.ndarray]:
        home = (self.hash % np.uint64(shards)).astype(np.int64)
        home[1] = -1
        order = np.argsort(home, kind="stable")
        return np.split(order[1:], np.searchsorted(home[order[1:]], np.arange(1, shards)))

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.train], minlength=len(self.names))

    def totals(self, replies: list[dict], shards: int) -> np.ndarray:
        """Training counts of the chunk's words over all chunks."""
        total = np.zeros(len(self.names), dtype=np.int64)
        homes = self.word_shards(shards)
        for r in replies:
            total[homes[r["shard"]]] = _unpack(r["answer"], "<i8")
        total[1] = total[0]
        return total

    def pairs(self, total: np.ndarray, shards: int) -> None:
        """Distinct pairs, contexts by part, and the trie of each."""
        before = np.append(1, self.tokens[:-1])
        before[before == 0] = 1
        unique, self.pair_of = np.unique(before * len(self.names) + self.tokens, return_inverse=True)
        self.context, self.word = np.divmod(unique, len(self.names))
        parts = 1 + total // self.part
        own = self.hash[self.word] % parts[self.context].astype(np.uint64)
        many = np.unique(self.context[parts[self.context] > 1])
        asked = np.repeat(many, parts[many])
        part = np.arange(len(asked)) - np.repeat(np.cumsum(parts[many]) - parts[many], parts[many])
        name = lambda c, p: _mix(self.hash[c] + p.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        keys = np.concatenate([name(self.context, own), name(asked, part)])
        self.keys, first, slot = np.unique(keys, return_index=True, return_inverse=True)
        self.slot = slot[: len(unique)]
        self.owner = np.concatenate([self.context, asked])[first]
        self.home = ((self.keys >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(self.home[self.slot], kind="stable")
        self.pairs_at = np.split(order, np.searchsorted(self.home[self.slot][order], np.arange(1, shards)))
        order = np.argsort(self.home, kind="stable")
        self.keys_at = np.split(order, np.searchsorted(self.home[order], np.arange(1, shards)))


def _ask_words(shards: int, part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_by_one(batches):
            chunk = _Chunk(row, part)
            counts = chunk.word_counts()
            homes = [(s, x) for s, x in enumerate(chunk.word_shards(shards)) if len(x)]
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([s for s, _ in homes], pa.int32()), "chunk": pa.array([row["chunk"]] * len(homes), pa.int64()),
                "words": [zstandard.compress(b" ".join(chunk.names[i] for i in x), 1) for _, x in homes],
                "counts": [_pack(counts[x].astype("<i8")) for _, x in homes],
            })
    return run


def _answer_words(table: pa.Table) -> pa.Table:
    total: defaultdict[bytes, int] = defaultdict(int)
    rows = []
    for row in table.to_pylist():
        words = zstandard.decompress(row["words"]).split(b" ")
        rows.append((row["chunk"], words))
        for w, n in zip(words, _unpack(row["counts"], "<i8").tolist()):
            total[w] += n
    seen = [n for n in total.values() if n]
    shard = table.column("shard")[0].as_py()
    return pa.table({
        "chunk": pa.array([c for c, _ in rows], pa.int64()), "shard": pa.array([shard] * len(rows), pa.int32()),
        "answer": [_pack(np.array([total[w] for w in words], dtype="<i8")) for _, words in rows],
        "tokens": pa.array([sum(seen)] + [0] * (len(rows) - 1), pa.int64()), "kinds": pa.array([len(seen)] + [0] * (len(rows) - 1), pa.int64()),
    })


def _ask_pairs(shards: int, part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_by_one(batches):
            chunk = _Chunk(row, part)
            total = chunk.totals(row["words_answer"], shards)
            chunk.pairs(total, shards)
            counts = np.bincount(chunk.pair_of[chunk.train], minlength=len(chunk.slot))
            place = np.zeros(len(chunk.keys), dtype=np.int64)
            for shard, (keys, pairs) in enumerate(zip(chunk.keys_at, chunk.pairs_at)):
                if len(keys):
                    place[keys] = np.arange(len(keys))
                    packed = chunk.keys[keys].tobytes(), _pack(total[chunk.owner[keys]].astype("<i8")), _pack(place[chunk.slot[pairs]].astype("<i4")), chunk.hash[chunk.word[pairs]].tobytes(), _pack(counts[pairs].astype("<i4"))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([shard], pa.int32()), pa.array([row["chunk"]], pa.int64()), *(pa.array([x], pa.binary()) for x in packed)],
                        names=["shard", "chunk", "keys", "totals", "context", "word", "counts"],
                    )
    return run


def _answer_pairs(table: pa.Table) -> pa.Table:
    rows = [
        (r["chunk"], np.frombuffer(r["keys"], dtype=np.uint64), _unpack(r["totals"], "<i8"), _unpack(r["context"], "<i4"), np.frombuffer(r["word"], dtype=np.uint64), _unpack(r["counts"], "<i4"))
        for r in table.to_pylist()
    ]
    shard = table.column("shard")[0].as_py()
    keys, first, rank = np.unique(np.concatenate([r[1] for r in rows]), return_index=True, return_inverse=True)
    totals = np.concatenate([r[2] for r in rows])[first]
    starts = np.cumsum([0] + [len(r[1]) for r in rows])
    context = np.concatenate([rank[s:][r[3]] for s, r in zip(starts, rows)])
    word, word_at = np.unique(np.concatenate([r[4] for r in rows]), return_inverse=True)
    ends = np.cumsum([len(r[4]) for r in rows])
    pair, asked = np.unique(context * len(word) + word_at, return_inverse=True)
    count = np.bincount(asked, weights=np.concatenate([r[5] for r in rows]), minlength=len(pair)).astype(np.int64)
    chunks = [r[0] for r in rows]
    del rows, word_at
    # Every distinct n-gram that a chunk has asked for is looked up once.
    context, place = np.divmod(pair, max(1, len(word)))
    seen = count > 0
    trie = NgramTrie.built(keys, totals, context[seen], word[place[seen]], count[seen])
    with tempfile.TemporaryDirectory(prefix="trie-") as folder:
        path = os.path.join(folder, "levels")
        trie.save(path)
        trie = NgramTrie.mapped(path)
        codes, backoff = trie.lookup(keys, context, word[place])
        del trie
    return pa.table({
        "chunk": pa.array(chunks, pa.int64()), "shard": pa.array([shard] * len(chunks), pa.int32()),
        "answer": [_pack(codes[asked[a:b]]) for a, b in zip(np.append(0, ends), ends)],
        "backoff": [_pack(backoff[rank[a:b]].astype("<u2")) for a, b in zip(starts, starts[1:])],
    })


def _score(shards: int, part: int, tokens: int, kinds: int, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _one_by_one(batches):
            chunk = _Chunk(row, part)
            total = chunk.totals(row["words_answer"], shards)
            chunk.pairs(total, shards)
            base = (total + ADDED) / (tokens + ADDED * (kinds + 1))
            seen = np.zeros(len(chunk.slot))
            mass = np.zeros(len(chunk.names))
            for r in row["pairs_answer"]:
                seen[chunk.pairs_at[r["shard"]]] = restored(_unpack(r["answer"], "<u2"))
                np.add.at(mass, chunk.owner[chunk.keys_at[r["shard"]]], restored(_unpack(r["backoff"], "<u2")))
            known = total[chunk.context] > 0
            smooth = np.where(known, seen + mass[chunk.context] * base[chunk.word], base[chunk.word])
            logs = np.log10(smooth)[chunk.pair_of]
            begin = np.cumsum(chunk.lengths) - chunk.lengths
            yield pa.RecordBatch.from_arrays([
                pa.array(chunk.doc_ids, id_type), pa.array(chunk.held), pa.array(chunk.lengths),
                pa.array(np.add.reduceat((total[chunk.tokens] > 0).astype(np.int64), begin)), pa.array(np.full(len(begin), tokens)),
                pa.array(np.add.reduceat(np.log10(base)[chunk.tokens], begin)), pa.array(np.add.reduceat(logs, begin)),
            ], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def score(docs: DataFrame, folds: int = 10, sizes: Sizes = Sizes()) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``
    of every row; training rows are those not held out (fold 0 of ``folds``)."""
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType
    kind = id_type.simpleString()
    chunked = docs.select("doc_id", (fold(F.col("doc_id"), folds) == 0).alias("held"), "text").mapInArrow(
        lambda batches: _chunks(batches, sizes.chunk), f"chunk long, doc_ids array<{kind}>, held array<boolean>, lengths binary, tokens binary, words binary"
    )
    # Bucketed, so that the two joins move the answers but not the chunks.
    name = f"lm_chunks_{uuid.uuid4().hex}"
    buckets = max(1, 2 * docs.select("doc_id").rdd.getNumPartitions())
    chunked.write.bucketBy(buckets, "chunk").sortBy("chunk").option("path", f"{scratch_dir(spark)}/{name}").saveAsTable(name)
    chunks = spark.table(name)
    number = chunks.count()
    shards = max(1, -(-number * sizes.chunk // sizes.trie))
    result = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    words = written(
        chunks.mapInArrow(_ask_words(shards, sizes.part), "shard int, chunk long, words binary, counts binary").groupBy("shard")
        .applyInArrow(_answer_words, "chunk long, shard int, answer binary, tokens long, kinds long"),
        "lm-words",
    )
    whole = words.agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).first()
    tokens, kinds = whole["tokens"] or 0, whole["kinds"] or 0
    with_words = chunks.join(words.groupBy("chunk").agg(F.collect_list(F.struct("shard", "answer")).alias("words_answer")), "chunk")
    pairs = written(
        with_words.mapInArrow(_ask_pairs(shards, sizes.part), "shard int, chunk long, keys binary, totals binary, context binary, word binary, counts binary")
        .groupBy("shard").applyInArrow(_answer_pairs, "chunk long, shard int, answer binary, backoff binary"),
        "lm-pairs",
    )
    with_pairs = with_words.join(pairs.groupBy("chunk").agg(F.collect_list(F.struct("shard", "answer", "backoff")).alias("pairs_answer")), "chunk")
    scores = written(with_pairs.mapInArrow(_score(shards, sizes.part, tokens, kinds, to_arrow_type(id_type)), result), "lm-scores")
    removed(spark, chunks, words, pairs)
    spark.sql(f"DROP TABLE {name}")
    return scores
