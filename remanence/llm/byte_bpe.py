"""Byte-level BPE by backtracking over longest matches (operator 6).

A piece of text is encoded without replaying merges. An Aho-Corasick automaton
over the vocabulary, its bytes mapped to Latin-1 characters, lists every token
that starts at every byte in one pass. From the left the longest token is taken
that is compatible with the one before it; two tokens are compatible if merging
their joined bytes gives back exactly these two, which is memoised. When no
token fits, the last one is given up for a shorter one, and the position is dead
from then on, so each is left once at most: linear time, and the result is the
one that merging by rank gives. Pieces that recur are looked up.

Defined results: a null text is empty: no ids, no bytes. Very long texts and
pieces are encoded whole. Repeated rows are encoded alike; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain, islice

import ahocorasick
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

#: Pieces and token pairs that one process remembers before it starts afresh.
REMEMBERED = 300_000
#: A vocabulary is broadcast; this bounds its file.
LARGEST_FILE = 64 << 20


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as file:
        data = file.read(LARGEST_FILE + 1)
    if len(data) > LARGEST_FILE:
        raise ValueError(f"{path} is larger than {LARGEST_FILE} bytes")
    return data


class _Pieces(dict):
    """Ids by piece, found when first asked for; only short pieces are kept.
    When it is full the older half stays: common pieces come early."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.shorten(REMEMBERED // 2)
        found = tuple(self.encode(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= 64:
            self[piece] = found
        return found


    def shorten(self, size: int) -> None:
        if len(self) > size:
            kept = list(islice(self.items(), size))
            self.clear()
            self.update(kept)


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            if self.merged(token) == [rank]:
                self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self._fits: dict[int, bool] = {}
        self._known = _Pieces(self.piece)

    def merged(self, data: bytes) -> list[int]:
        """Ids by replaying merges, lowest rank first; for short inputs."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        found = self._fits.get(pair)
        if found is None:
            if len(self._fits) >= REMEMBERED:
                self._fits.clear()
            found = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            self._fits[pair] = found
        return found

    def _longest(self, text: str, length: int) -> list[int] | None:
        """The longest matches from the left, if they tile the piece and every
        neighbour fits; they are then the encoding, without backtracking."""
        ids, at, before = [], 0, -1
        for last, (rank, size) in self.automaton.iter_long(text):
            if last - size + 1 != at or (before >= 0 and not self.fits(before, rank)):
                return None
            ids.append(rank)
            at, before = last + 1, rank
        return ids if at == length else None

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        text, length = data.decode("latin-1"), len(data)
        straight = self._longest(text, length)
        if straight is not None:
            return straight
        begin: list[list[tuple[int, int]]] = [[] for _ in range(length)]
        for last, (rank, size) in self.automaton.iter(text):
            begin[last - size + 1].append((rank, size))
        alive = bytearray(b"\x01") * (length + 1)
        ids: list[int] = []
        tried: list[int] = []
        at, k = 0, len(begin[0]) - 1
        while at < length:
            options = begin[at]
            while k >= 0:
                rank, size = options[k]
                if alive[at + size] and (not ids or self.fits(ids[-1], rank)):
                    break
                k -= 1
            if k >= 0:
                ids.append(rank)
                tried.append(k)
                at += size
                k = len(begin[at]) - 1 if at < length else 0
            else:
                alive[at] = 0
                at -= len(self.bytes_of[ids.pop()])
                k = tried.pop() - 1
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self._known.__getitem__, self.pieces(text))))

    def trim(self, size: int) -> None:
        """Forgets what was learned last, beyond ``size`` pieces, and pairs."""
        self._known.shorten(size)
        if len(self._fits) > size:
            self._fits.clear()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


#: The codec of this process, kept between tasks with its commonest pieces.
_OWN: dict[str, Codec] = {}
KEPT_BETWEEN_TASKS = 50_000


def own_codec(ranks: bytes, pattern: str) -> Codec:
    name = xxhash.xxh3_128_hexdigest(ranks + pattern.encode())
    if name not in _OWN:
        _OWN.clear()
        _OWN[name] = Codec(ranks, pattern)
    return _OWN[name]


def _over_texts(docs: DataFrame, ranks_path: str, pattern: str, schema: str, row) -> DataFrame:
    """Applies ``row(codec, text) -> values`` to every text, in Arrow batches.

    The vocabulary goes to the executors as one broadcast, read on the driver
    and bounded by ``LARGEST_FILE``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = own_codec(shared.value, pattern)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                rows = [row(codec, t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0)] + [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["doc_id", *names])
        codec.trim(KEPT_BETWEEN_TASKS)
        pa.default_memory_pool().release_unused()

    names = [f.split()[0] for f in schema.split(", ")]
    arrow = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    types = [arrow[f.split()[1]] for f in schema.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {schema}")


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, ids`` (array of int) of every row."""
    return _over_texts(docs, ranks_path, pattern, "ids array<int>", lambda c, t: (c.encode(t),))


def digest(ids: list[int], decoded: bytes, names: dict[int, str]) -> tuple[int, str, str]:
    joined = " ".join(map(names.__getitem__, ids))
    return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: every text is encoded,
    its ids are decoded, and both are digested where they are."""
    names: dict[int, str] = {}

    def row(codec: Codec, text: str) -> tuple[int, str, str]:
        if not names:
            names.update((rank, str(rank)) for rank in codec.bytes_of)
        ids = codec.encode(text)
        return digest(ids, codec.decode(ids), names)

    return _over_texts(docs, ranks_path, pattern, "n_tokens long, ids_sha256 string, decoded_sha256 string", row)


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256``: the ids of every text and the
    digest of the bytes that they decode to."""

    def row(codec: Codec, text: str) -> tuple[int, list[int], str]:
        ids = codec.encode(text)
        return len(ids), ids, hashlib.sha256(codec.decode(ids)).hexdigest()

    return _over_texts(docs, ranks_path, pattern, "n_tokens long, ids array<int>, decoded_sha256 string", row)
