"""Alignment of two tokenizers over the same bytes (operator 11).

Every text is encoded by A, a byte-level BPE file, as ``space + text``, and by B,
a piece model that puts the space before the text itself. The ends of tokens are
running sums of their byte lengths; byte offsets where tokens of both end cut the
bytes into groups, and every A token of a group is linked with every B token of it.

A text is taken apart into units at places that no token of either can span, so
a unit's ids and groups do not depend on its neighbours and are found once for
many occurrences: in A, a visible character never shares a token with white space
after it; in B, two characters that no piece has side by side never share one.
Where the model does not allow these cuts a text is one unit.

Documents go through in chunks of a bounded number of units. A chunk holds its
distinct id pairs, each with the number of its documents that have it linked.
These partial counts are summed in two shuffles, first by pair and salt, then by
pair, and go back to the chunks that hold the pair; there the documents are
summed up. No step needs more of the corpus than a chunk.

Defined results: null and empty texts, and texts whose joined tokens of either
side are not ``space + text`` byte by byte (U+2581 in a text, say), have no
tokens: zeros and an empty digest. Strings of special tokens are plain text.
Very long texts are aligned whole, also groups of very many tokens, whose links
are counted by distinct ids. Every row is a document of its own, repeated ones
too; a null doc_id stays null; an empty table gives no rows; extra columns are
ignored. Pairs that tie for the highest count of their A id are all best.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import removed, repeated_ranges, written

#: Units of a chunk (a document is never split), units a process remembers.
CHUNK, REMEMBERED = 1 << 18, 150_000
#: First-stage groups of one pair.
SALTS = 16
#: Characters, as ranges, that some notion of white space or of a piece model
#: treats apart: fixed values.
ODD_RANGES = [(0, 9), (11, 31), (0x7F, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x2064), (0x2581, 0x2581), (0x3000, 0x3000), (0xFEFF, 0xFEFF)]
ODD = "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ODD_RANGES)
UNIT = re.compile(rf"[ \n]*[^ \n]+(?:(?<=[{ODD}])[ \n]+[^ \n]+)*")
SPACE = chr(0x2581)


def byte_alphabet() -> dict[str, int]:
    """Byte of every character that byte-level vocabularies write for it:
    printable Latin-1 stands for itself, the rest for U+0100 onwards."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


def _flat(lists: Iterator[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the lists, and all their items."""
    lists = list(lists)
    counts = np.array([len(x) for x in lists], dtype=np.int64)
    return counts, np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=int(counts.sum()))


class Aligner:
    """Units of one process: their ids, groups and links, found when first met."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        kinds = self.a.get_vocab_size()
        self.a_bytes = [bytes(map(alphabet.__getitem__, t)) if t and set(t) <= alphabet.keys() else b"" for t in map(self.a.id_to_token, range(kinds))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_length = np.array([len(x) for x in self.a_bytes])
        self.b_length = np.array([len(x) for x in self.b_bytes])
        #: Characters side by side in some piece; no token of B spans any others.
        self.neighbours = {p[i : i + 2] for i, p in enumerate(pieces) if not self.b.is_byte(i) for i in range(len(p) - 1)}
        self.divisible = not any("\n" in n or (n[1] == SPACE and n[0] != SPACE) for n in self.neighbours)
        self.names = [str(i) for i in range(max(kinds, len(pieces)))]
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes = np.zeros((0, 5), dtype=np.int64)  # A ids, B ids, groups, links, unaligned
        self.ends = np.zeros(1, dtype=np.int64)
        self.pairs = np.zeros(0, dtype=np.int64)
        self.times = np.zeros(0, dtype=np.int64)

    def split(self, text: str) -> list[str]:
        """Units of ``space + text``."""
        if not self.divisible:
            return [" " + text]
        body = " " + text
        tail = len(body.rstrip(" \n"))
        units = UNIT.findall(body[:tail])
        if not units:
            return [body]
        units[-1] += body[tail:]
        return units

    def units(self, texts: list[str]) -> list[np.ndarray]:
        """Numbers of every text's units; new ones are learned together."""
        split = [self.split(t) for t in texts]
        new = list(set(chain.from_iterable(split)).difference(self.known))
        for begin in range(0, len(new), 5_000):
            self.learn(new[begin : begin + 5_000])
        return [np.fromiter(map(self.known.__getitem__, s), dtype=np.int64, count=len(s)) for s in split]

    def learn(self, units: list[str]) -> None:
        n_a, a = _flat(e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False))
        # B puts a space first; where none belongs, a line break keeps it apart.
        found = self.b.encode([u[1:] if u[0] == " " else "\n" + u for u in units], num_threads=1)
        n_b, b = _flat(ids if u[0] == " " else ids[2:] for u, ids in zip(units, found))
        data = [u.encode("utf-8", "replace") for u in units]
        good = self._same(data, n_a, a, self.a_bytes) & self._same(data, n_b, b, self.b_bytes)
        if not good.all():
            n_a, a, n_b, b = n_a * good, a[np.repeat(good, n_a)], n_b * good, b[np.repeat(good, n_b)]
        sizes, groups, pairs, times, counts = self.align(a, n_a, b, n_b)
        sizes[:, 4] = ~good
        self.known.update(zip(units, range(len(self.groups), len(self.groups) + len(units))))
        self.groups += groups
        self.sizes = np.concatenate([self.sizes, sizes])
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(counts))
        self.pairs, self.times = np.append(self.pairs, pairs), np.append(self.times, times)

    def _same(self, data: list[bytes], counts: np.ndarray, ids: np.ndarray, tokens: list[bytes]) -> np.ndarray:
        """Whether every unit's tokens are its bytes."""
        found = [tokens[i] for i in ids.tolist()]
        ends = np.cumsum(counts)
        if b"".join(found) == b"".join(data):
            size = np.append(0, np.cumsum([len(f) for f in found]))
            return size[ends] - size[ends - counts] == np.array([len(d) for d in data])
        return np.array([b"".join(found[e - n : e]) == d for d, n, e in zip(data, counts.tolist(), ends.tolist())], dtype=bool)

    def shorten(self, size: int) -> None:
        """Keeps the ``size`` units that were met first: common ones come early."""
        if len(self.known) > size:
            self.known = dict(islice(self.known.items(), size))
            self.groups, self.sizes, self.ends = self.groups[:size], self.sizes[:size].copy(), self.ends[: size + 1].copy()
            self.pairs, self.times = self.pairs[: self.ends[-1]].copy(), self.times[: self.ends[-1]].copy()

    def align(self, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray):
        """Of consecutive units with ``n_a`` and ``n_b`` ids each: sizes, groups
        as text, linked id pairs with how often a group has them, pairs a unit."""
        ends_a, ends_b = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        tokens = np.cumsum(n_a)
        upto = np.append(0, np.append(group_a, -1)[tokens - 1] + 1) if len(a) else np.zeros(len(n_a) + 1, dtype=np.int64)
        upto = np.maximum.accumulate(np.where(np.append(0, tokens) > 0, upto, 0))
        # Ids of a group once each, so that a group of very many tokens stays small.
        key_a, times_a = np.unique(group_a << 32 | a, return_counts=True)
        key_b, times_b = np.unique(group_b << 32 | b, return_counts=True)
        of_a, of_b = key_a >> 32, key_b >> 32
        in_b = np.bincount(of_b, minlength=len(cuts))
        first_b = np.cumsum(in_b) - in_b
        wide = in_b[of_a]
        right = repeated_ranges(first_b[of_a], wide)
        pairs = np.repeat(key_a & 0xFFFFFFFF, wide) << 32 | key_b[right] & 0xFFFFFFFF
        times = np.repeat(times_a, wide) * times_b[right]
        before = np.append(0, np.cumsum(np.bincount(of_a, minlength=len(cuts)) * in_b))
        links = np.append(0, np.cumsum(np.bincount(group_a, minlength=len(cuts)) * np.bincount(group_b, minlength=len(cuts))))
        sizes = np.stack([n_a, n_b, np.diff(upto), np.diff(links[upto]), np.zeros(len(n_a), dtype=np.int64)], axis=1)
        return sizes, self._written(a, group_a, b, group_b, upto), pairs, times, np.diff(before[upto])

    def _written(self, a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, upto: np.ndarray) -> list[str]:
        group, side = np.append(group_a, group_b), np.append(np.zeros(len(a), np.int8), np.ones(len(b), np.int8))
        order = np.lexsort((np.arange(len(group)), side, group))
        group, side, ids = group[order], side[order], np.append(a, b)[order]
        unit = np.searchsorted(upto, group, side="right")
        changed = np.where(np.diff(group, prepend=-1) > 0, 2, np.diff(side, prepend=0))
        marks = np.array([",", "|", ";"], dtype=object)[np.minimum(changed, 2)]
        first = np.flatnonzero(np.diff(unit, prepend=0))
        marks[first] = ""
        parts = [m + self.names[i] for m, i in zip(marks.tolist(), ids.tolist())]
        texts = [""] * (len(upto) - 1)
        for begin, end in zip(first.tolist(), [*first[1:].tolist(), len(parts)]):
            texts[unit[begin] - 1] = "".join(parts[begin:end])
        return texts


#: The aligner of this process, kept between tasks with what it has learned.
_OWN: dict[tuple[str, str], Aligner] = {}


def own_aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _OWN:
        _OWN.clear()
        _OWN[a_path, b_path] = Aligner(a_path, b_path)
    return _OWN[a_path, b_path]


def _digest(aligner: Aligner, units: np.ndarray) -> str:
    """sha256 of the groups; a unit's groups are written next to its neighbours'."""
    digest = hashlib.sha256()
    for begin in range(0, len(units), 100_000):
        part = ";".join(map(aligner.groups.__getitem__, units[begin : begin + 100_000].tolist()))
        digest.update((";" + part if begin else part).encode())
    return digest.hexdigest()


COUNTED = ["n_a", "n_b", "n_groups", "n_links"]


#: Units or pairs of a row: rows stay small, whatever a chunk holds.
PIECE = 8192


def _packed(unit: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending unit numbers and their uses: steps and uses as planes of bytes,
    most of which are zero, compressed."""
    both = np.concatenate([np.diff(unit, prepend=0), times]).astype("<u4")
    return _COMPRESSOR.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(_DECOMPRESSOR.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


_COMPRESSOR, _DECOMPRESSOR = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()


def _chunk_rows(aligner: Aligner, number: int, ids: list, docs: list[np.ndarray], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A chunk as rows of three kinds: documents with their distinct units,
    pieces of the units' links, pieces of the distinct pairs."""
    lengths = np.array([len(d) for d in docs])
    units = np.concatenate(docs)
    doc = np.repeat(np.arange(len(docs)), lengths)
    bad = np.bincount(doc, weights=aligner.sizes[units, 4], minlength=len(docs)) > 0
    units, doc = units[~bad[doc]], doc[~bad[doc]]
    local, units_local = np.unique(units, return_inverse=True)
    # Distinct units of every document, and how often it has them.
    keys, times = np.unique(doc * max(1, len(local)) + units_local, return_counts=True)
    of, unit = np.divmod(keys, max(1, len(local)))
    wide = aligner.ends[local + 1] - aligner.ends[local]
    at = repeated_ranges(aligner.ends[local], wide)
    pairs, place = np.unique(aligner.pairs[at], return_inverse=True)
    # A document counts once for a pair, however many of its units have it.
    starts = np.cumsum(wide) - wide
    linked = np.unique(np.repeat(of, wide[unit]) * max(1, len(pairs)) + place[repeated_ranges(starts[unit], wide[unit])])
    holding = np.bincount(linked % max(1, len(pairs)), minlength=len(pairs))
    summed = [np.bincount(of, weights=times * aligner.sizes[local[unit], k], minlength=len(docs)).astype(np.int64) for k in range(4)]

    def batch(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int64()) if f.name == "chunk" else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    ends = np.cumsum(np.bincount(of, minlength=len(docs)))
    yield batch(
        len(docs), doc_id=ids, **dict(zip(COUNTED, summed)), units=[_packed(unit[b:e], times[b:e]) for b, e in zip([0, *ends[:-1].tolist()], ends.tolist())],
        digest=["" if b or not len(d) else _digest(aligner, d) for d, b in zip(docs, bad)],
    )
    for begin in range(0, len(local), PIECE):
        some = wide[begin : begin + PIECE]
        part = slice(int(starts[begin]), int(starts[begin] + some.sum()))
        yield batch(1, first=[begin], wide=[some.astype("<u4").tobytes()], place=[place[part].astype("<u4").tobytes()], inside=[aligner.times[at[part]].astype("<i8").tobytes()])
    for begin in range(0, len(pairs), PIECE):
        yield batch(1, first=[begin], pairs=[pairs[begin : begin + PIECE]], holding=[holding[begin : begin + PIECE]])


def _chunks(docs: DataFrame, a_path: str, b_path: str, chunk: int) -> DataFrame:
    id_type, kind = to_arrow_type(docs.schema["doc_id"].dataType), docs.schema["doc_id"].dataType.simpleString()
    long, binary, longs = pa.int64(), pa.binary(), pa.list_(pa.int64())
    arrow = pa.schema([
        ("chunk", long), ("doc_id", id_type), *((c, long) for c in COUNTED), ("units", binary), ("digest", pa.string()),
        ("first", pa.int32()), ("wide", binary), ("place", binary), ("inside", binary), ("pairs", longs), ("holding", longs),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = own_aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        ids: list = []
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                texts = part.column(1).to_pylist()
                for name, text, units in zip(part.column(0).to_pylist(), texts, aligner.units([t or "" for t in texts])):
                    ids.append(name)
                    held.append(units if text else units[:0])
                    size += len(units)
                if size >= chunk:
                    yield from _chunk_rows(aligner, number, ids, held, arrow)
                    ids, held, size, number = [], [], 0, number + 1
                    if len(aligner.known) > REMEMBERED:
                        aligner.shorten(REMEMBERED // 2)
        if ids:
            yield from _chunk_rows(aligner, number, ids, held, arrow)
        aligner.shorten(REMEMBERED // 2)
        pa.default_memory_pool().release_unused()

    counted = ", ".join(f"{c} long" for c in COUNTED)
    schema = f"chunk long, doc_id {kind}, {counted}, units binary, digest string, first int, wide binary, place binary, inside binary, pairs array<long>, holding array<long>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _totals(chunks: DataFrame) -> DataFrame:
    """``a, pair, documents``: two-stage sums over the chunks' counts."""
    rows = chunks.where("pairs IS NOT NULL").select("chunk", F.explode(F.arrays_zip("pairs", "holding")).alias("p")).select("chunk", "p.pairs", "p.holding")
    salted = rows.groupBy(F.col("pairs").alias("pair"), F.pmod(F.xxhash64("chunk"), F.lit(SALTS)).alias("salt")).agg(F.sum("holding").alias("documents"))
    totals = written(salted.groupBy("pair").agg(F.sum("documents").alias("documents")).withColumn("a", F.shiftright("pair", 32)), "pair-totals")
    return totals


def _best(totals: DataFrame) -> DataFrame:
    """``pair, documents, best``: whether no pair of the same A id has more. A
    vocabulary bounds the A ids."""
    highest = totals.groupBy("a").agg(F.max("documents").alias("highest"))
    return totals.join(F.broadcast(highest), "a").select("pair", "documents", (F.col("documents") == F.col("highest")).alias("best"))


def pair_counts(docs: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK) -> DataFrame:
    """``a_id, b_id, documents, best``: documents that hold the two ids linked."""
    found = _best(_totals(_chunks(docs, a_path, b_path, chunk)))
    return found.select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id"), "documents", "best")


def groups(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, groups``: of every text its groups in order, as ``a`` and ``b``,
    the ids of both sides."""
    id_type, kind = to_arrow_type(docs.schema["doc_id"].dataType), docs.schema["doc_id"].dataType.simpleString()
    group_type = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def parsed(text: str) -> list[dict]:
        return [dict(zip("ab", ([int(i) for i in side.split(",")] for side in g.split("|")))) for g in text.split(";")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = own_aligner(a_path, b_path)
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                texts = part.column(1).to_pylist()
                found = []
                for text, units in zip(texts, aligner.units([t or "" for t in texts])):
                    aligned = text and not aligner.sizes[units, 4].any()
                    found.append([g for u in units.tolist() for g in parsed(aligner.groups[u])] if aligned else [])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, group_type)], names=["doc_id", "groups"])
                if len(aligner.known) > REMEMBERED:
                    aligner.shorten(REMEMBERED // 2)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, groups array<struct<a:array<int>,b:array<int>>>")


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _finished(id_type: pa.DataType):
    def run(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        docs = chunk.filter(pc.is_valid(chunk.column("digest")))
        units = chunk.filter(pc.is_valid(chunk.column("wide"))).sort_by("first")
        joined = lambda rows, name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind).astype(np.int64)
        wide, place, inside = joined(units, "wide", "<u4"), joined(units, "place", "<u4"), joined(units, "inside", "<i8")
        packed = [_unpacked(x) for x in docs.column("units").to_pylist()]
        kinds = np.array([len(u) for u, _ in packed], dtype=np.int64)
        unit, times = np.concatenate([u for u, _ in packed]), np.concatenate([t for _, t in packed])
        at = answers.column("at").to_numpy()
        documents, best = np.zeros(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        documents[at], best[at] = answers.column("documents").to_numpy(), answers.column("best").to_numpy(zero_copy_only=False)
        n_best, count_sum = (_sums(_sums(weight[place] * inside, wide)[unit] * times, kinds) for weight in (best, documents))
        return pa.table({
            "doc_id": docs.column("doc_id").cast(id_type), **{c: docs.column(c) for c in COUNTED},
            "n_best": pa.array(n_best), "count_sum": pa.array(count_sum), "groups_sha256": docs.column("digest"),
        })

    return run


def aligned(docs: DataFrame, a_path: str, b_path: str, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``
    of every row."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType
    chunks = written(_chunks(docs, a_path, b_path, chunk), "aligned-chunks")
    held = chunks.where("pairs IS NOT NULL").select("chunk", "first", F.posexplode("pairs").alias("k", "pair")).select("chunk", (F.col("first") + F.col("k")).alias("at"), "pair")
    totals = _totals(chunks)
    answers = held.join(_best(totals), "pair").select(F.col("chunk").alias("to"), "at", "documents", "best")
    schema = f"doc_id {kind.simpleString()}, " + ", ".join(f"{c} long" for c in [*COUNTED, "n_best", "count_sum"]) + ", groups_sha256 string"
    rest = chunks.where("pairs IS NULL").drop("pairs", "holding")
    found = written(rest.groupBy("chunk").cogroup(answers.groupBy("to")).applyInArrow(_finished(to_arrow_type(kind)), schema), "aligned")
    removed(spark, chunks, totals)
    return found
