"""Token-id files compressed by Re-Pair grammars (operator 7).

Documents are range-partitioned by id, tokenised, and written as blocks. In a
block, the most frequent pairs of adjacent ids are replaced by new symbols until
no pair has ``LEAST`` uses; pairs never cross a document's end. A block row holds

- ``shard, block``: order of the blocks; ids ascend through them;
- ``doc_ids, counts, offsets``: documents, their token counts, and where their
  symbols begin in the block's sequence;
- ``rules``: two symbols a rule, rule r being symbol ``BASE + r``;
- ``lengths``: expansion length (uint32) of every rule;
- ``symbols``: the sequence.

Symbols are stored as a plane of their low 16 bits and one of the 8 bits above,
so a block may have 2^24 - ``BASE`` rules, more than it has ids.

Any stretch of a document can be decoded without the rest: its symbols are a
slice, and the stored expansion lengths tell which of them, and which half of
each rule, reach into the stretch.

Defined results: a null text is empty and holds the end id alone; null doc_ids
come first, repeated ones are ordered by text; an empty table writes no block.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BASE = 49_408
#: Tokens a block, least uses of a rule.
BLOCK, LEAST = 1 << 19, 6
#: A round replaces pairs down to this share of the uses of the most frequent.
SHARE = 0.25
#: Bits of the buckets that tell rare pairs; places that are settled one by one.
BUCKETS, FEW = 18, 200
#: Words whose ids one process remembers before it starts afresh.
REMEMBERED = 700_000
#: Marks that are pieces apart from the letters before them; words the library gets at once.
MARKS, JOINED = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", 200
#: The tokenizer of this process, kept between tasks with what it has learned.
_OWN: dict[str, WordTokenizer] = {}


def compress(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Grammar of one block: rules (n, 2), their expansion lengths, symbols, and
    the documents' new starts. ``starts``: where documents begin in ``ids``.

    A round counts all pairs exactly and replaces those that are at least
    ``SHARE`` as frequent as the most frequent one; where two of them overlap the
    more frequent has its way, as if they were replaced one after another.
    Rounds end when no pair has ``LEAST`` uses. Places of pairs in buckets of
    fewer uses are not counted again.
    """
    sequence = ids.astype(np.uint32)
    first = np.zeros(len(sequence) + 1, dtype=bool)
    first[starts] = True
    rules, lengths = [np.empty((0, 2), dtype=np.uint32)], np.ones(BASE, dtype=np.int64)
    live = np.ones(len(sequence), dtype=bool)
    while len(sequence) > 1:
        where = np.flatnonzero(live[:-1] & ~first[1 : len(sequence)])
        # Half the bytes wherever two symbols fit into 32 bits.
        word, width, low = (np.uint32, 16, 0xFFFF) if sequence.max() < 1 << 16 else (np.uint64, 24, 0xFFFFFF)
        pair = sequence[where].astype(word) << word(width) | sequence[where + 1]
        # New pairs hold a new symbol, so a rare pair stays rare: its places are left out from now on.
        bucket = (pair * word(0x9E3779B1)) >> word(8 * pair.itemsize - BUCKETS)
        often = np.bincount(bucket.astype(np.int64), minlength=1)[bucket] >= LEAST
        live[where[~often]] = False
        where, pair = where[often], pair[often]
        ordered = np.sort(pair)
        cut = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.empty(0, np.int64)
        uses = np.diff(np.append(cut, len(ordered)))
        if not len(uses) or uses.max() < LEAST:
            break
        chosen = uses >= max(LEAST, SHARE * uses.max())
        names, uses = ordered[cut[chosen]], uses[chosen]
        rank = np.empty(len(names), dtype=np.int64)
        rank[np.argsort(-uses, kind="stable")] = np.arange(len(names))
        # Only pairs of a left and a right symbol of chosen ones are looked up.
        left = np.zeros((2, int(sequence.max()) + 1), dtype=bool)
        left[0, names >> word(width)] = left[1, names & word(low)] = True
        some = left[0].take(pair >> word(width)) & left[1].take(pair & word(low))
        at, pair = where[some], pair[some]
        place = np.searchsorted(names, pair)
        same = names[np.minimum(place, len(names) - 1)] == pair
        at, order = at[same], rank[place[same]]
        at, order = _replaced(at, order)
        used = np.bincount(order, minlength=len(names))
        good = used >= LEAST
        if not good.any():
            good[:] = used >= 2
            if not good.any():
                break
        number = np.cumsum(good) - 1 + len(lengths)
        at, order = at[good[order]], order[good[order]]
        fresh = names[np.argsort(rank)][good]
        rule = np.stack([fresh >> word(width), fresh & word(low)], axis=1).astype(np.uint32)
        rules.append(rule)
        lengths = np.append(lengths, lengths[rule].sum(axis=1))
        sequence[at] = number[order]
        live[at] = live[np.maximum(at - 1, 0)] = True
        stay = np.ones(len(sequence), dtype=bool)
        stay[at + 1] = False
        sequence, live, first = sequence[stay], live[stay], np.append(first[:-1][stay], False)
    return np.concatenate(rules), lengths[BASE:], sequence, np.flatnonzero(first)


def _replaced(at: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the overlapping places are replaced when ranks go in order, each
    from the left. A place is free to go once both neighbours rank after it, or
    are gone; each pass settles all such places, and the last few go one by one."""
    taken = np.zeros(len(at), dtype=bool)
    alive = np.arange(len(at))
    while len(alive) > FEW:
        a, r = at[alive], order[alive]
        touch = np.diff(a) == 1
        # Equal ranks that overlap are one symbol repeated: the left one goes first.
        before_wins = np.append(False, touch & (r[:-1] <= r[1:]))
        after_wins = np.append(touch & (r[1:] < r[:-1]), False)
        win = ~before_wins & ~after_wins
        taken[alive[win]] = True
        lost = np.append(False, touch & win[:-1]) | np.append(touch & win[1:], False)
        alive = alive[~win & ~lost]
    gone: set[int] = set()
    for _, a, i in sorted(zip(order[alive].tolist(), at[alive].tolist(), alive.tolist())):
        if a not in gone:
            taken[i] = True
            gone.update((a - 1, a, a + 1))
    return at[taken], order[taken]


def planes(symbols: np.ndarray) -> bytes:
    symbols = symbols.ravel()
    return (symbols & 0xFFFF).astype("<u2").tobytes() + (symbols >> 16).astype(np.uint8).tobytes()


def from_planes(data: bytes) -> np.ndarray:
    n = len(data) // 3
    return np.frombuffer(data, "<u2", n).astype(np.int64) | np.frombuffer(data, np.uint8, n, 2 * n).astype(np.int64) << 16


def decode(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Ids ``begin`` to ``end`` of what ``symbols`` expand to. Lengths place every
    symbol, so only those that reach into the stretch are ever expanded."""
    size = lambda s: np.where(s >= BASE, lengths[np.maximum(s - BASE, 0)], 1) if len(lengths) else np.ones(len(s), dtype=np.int64)
    own = size(symbols)
    at = np.cumsum(own) - own
    end = int(own.sum()) if end is None else end
    out = np.empty(max(0, end - begin), dtype=np.uint16)
    while len(symbols):
        reach = (at < end) & (at + own > begin)
        symbols, at = symbols[reach], at[reach]
        leaf = symbols < BASE
        out[at[leaf] - begin] = symbols[leaf]
        rule, at = rules[symbols[~leaf] - BASE], at[~leaf]
        symbols = rule.ravel()
        own = size(symbols)
        at = np.repeat(at, 2)
        at[1::2] += own[::2]
    return out


def opened(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules and expansion lengths of a block row."""
    return from_planes(block["symbols"]), from_planes(block["rules"]).reshape(-1, 2), np.frombuffer(block["lengths"], dtype="<u4").astype(np.int64)


def document_ids(block: dict, which: int, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Ids (of a stretch) of one document of a block row, decoding nothing else."""
    symbols, rules, lengths = opened(block)
    ends = [*block["offsets"][1:], len(symbols)]
    return decode(symbols[block["offsets"][which] : ends[which]], rules, lengths, begin, end)


class WordTokenizer:
    """Ids of a text from its words: the vocabulary's pieces never cross white
    space, so a word's ids do not depend on its neighbours.

    The library encodes each distinct word once. Letters and the marks after
    them are separate pieces too, and case is folded, so ``Word.`` is taken from
    ``word`` and ``.``; only letters up to U+00FF, which neither folding nor
    normalisation lengthens, are treated so. The library gets many of them at
    a time, with blanks between: each is one piece, whose last id ends a word.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(1 << 16, dtype=bool)
        self.ends[[i for piece, i in self.tokenizer.get_vocab().items() if suffix and piece.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}
        self.roots: dict[str, bytes] = {}

    def _library(self, pieces: list[str]) -> Iterator[tuple[str, bytes]]:
        for begin in range(0, len(pieces), 2_000):
            some = pieces[begin : begin + 2_000]
            for piece, got in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                yield piece, array("H", got.ids).tobytes()

    def _joined(self, words: list[str]) -> None:
        """Learns words of letters alone, by hundreds."""
        groups = [words[begin : begin + JOINED] for begin in range(0, len(words), JOINED)]
        for begin in range(0, len(groups), 20):
            some = groups[begin : begin + 20]
            for group, got in zip(some, self.tokenizer.encode_batch_fast([" ".join(g) for g in some], add_special_tokens=False)):
                ids = np.array(got.ids, dtype=np.uint16)
                cut = (2 * np.flatnonzero(self.ends[ids]) + 2).tolist()
                if len(cut) != len(group):
                    self.roots.update(self._library(group))
                    continue
                data = ids.tobytes()
                self.roots.update(zip(group, [data[i:j] for i, j in zip([0, *cut], cut)]))

    def learn(self, words: set[bytes]) -> None:
        if len(self.roots) > REMEMBERED * 3 // 2:
            self.roots.clear()
        texts, roots = b"\n".join(words).decode().split("\n"), self.roots
        cores = [t.rstrip(MARKS) for t in texts]
        plain = [c.isalpha() and (c.isascii() or max(c) <= "\u00ff") for c in cores]
        marks = [t[len(c) :] if p else "" for t, c, p in zip(texts, cores, plain)]
        cores = [c.lower() if p else t for t, c, p in zip(texts, cores, plain)]
        fresh = {c for c, p in zip(cores, plain) if p}.difference(roots)
        self._joined(list(fresh))
        rest = {c for c, p in zip(cores, plain) if not p}.union(marks)
        rest.discard("")
        roots.update(self._library(list(rest.difference(roots))))
        self.known.update((w, roots[c] + roots[m] if m else roots[c]) for w, c, m in zip(words, cores, marks))

    def encode(self, texts: list[str], end: int) -> list[np.ndarray]:
        split = [t.encode("utf-8", "replace").split() for t in texts]
        every: set[bytes] = set().union(*split)
        missing = every.difference(self.known)
        if len(self.known) + len(missing) > REMEMBERED:
            self.known.clear()
            missing = every
        if missing:
            self.learn(missing)
        last, get = array("H", [end]).tobytes(), self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, words)) + last, dtype=np.uint16) for words in split]


def own_tokenizer(path: str) -> WordTokenizer:
    if path not in _OWN:
        _OWN.clear()
        _OWN[path] = WordTokenizer(path)
    return _OWN[path]


def write_blocks(docs: DataFrame, tokenizer_path: str, end: int) -> DataFrame:
    """Writes the token file of ``docs`` in the shared folder and returns it."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, shard, block = own_tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        pending: list[np.ndarray] = []
        names: list = []
        held = 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                for name, ids in zip(part.column(0).to_pylist(), tokens.encode([t or "" for t in part.column(1).to_pylist()], end)):
                    names.append(name)
                    pending.append(ids)
                    held += len(ids)
                    if held >= BLOCK:
                        yield row(shard, block, names, pending)
                        pending, names, held, block = [], [], 0, block + 1
        if names:
            yield row(shard, block, names, pending)

    def row(shard: int, block: int, names: list, pending: list[np.ndarray]) -> pa.RecordBatch:
        counts = np.array([len(p) for p in pending])
        rules, lengths, symbols, offsets = compress(np.concatenate(pending), np.cumsum(counts) - counts)
        return pa.RecordBatch.from_pydict({
            "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "doc_ids": pa.array([names], pa.list_(types)), "counts": pa.array([counts.tolist()], pa.list_(pa.int32())),
            "offsets": pa.array([offsets.tolist()], pa.list_(pa.int32())), "rules": [planes(rules)],
            "lengths": [lengths.astype("<u4").tobytes()], "symbols": [planes(symbols)],
        })

    from pyspark.sql.pandas.types import to_arrow_type

    types = to_arrow_type(docs.schema["doc_id"].dataType)
    schema = f"shard int, block int, doc_ids array<{kind}>, counts array<int>, offsets array<int>, rules binary, lengths binary, symbols binary"
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(run, schema), "token-blocks")


def read_documents(blocks: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the file."""
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1).to_pylist()[0]
                ids = decode(*opened(b)).astype("<u4")
                counts = np.array(b["counts"], dtype=np.int64)
                ends = np.cumsum(counts)
                sums = [zlib.crc32(ids[e - n : e]) for n, e in zip(counts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array([b["shard"]] * len(counts), pa.int32()), pa.array([b["block"]] * len(counts), pa.int32()),
                    pa.array(b["doc_ids"], types), pa.array(ends - counts), pa.array(counts), pa.array(sums, pa.int64()),
                ], names=["shard", "block", "doc_id", "within", "n_tokens", "ids_crc32"])

    from pyspark.sql.pandas.types import to_arrow_type

    types = to_arrow_type(blocks.schema["doc_ids"].dataType.elementType)
    sizes = blocks.select("shard", "block", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("tokens"))
    decoded = blocks.mapInArrow(run, f"shard int, block int, doc_id {kind}, within long, n_tokens long, ids_crc32 long")
    return decoded.join(_before(sizes), ["shard", "block"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


#: Shards whose totals are summed together.
SHARDS = 512


def _before(sizes: DataFrame) -> DataFrame:
    """``shard, block, before``: tokens of all earlier blocks. Sums run within a
    shard, within a group of shards and over the groups, so no window holds more
    than a shard's blocks, ``SHARDS`` shards, or one row a group."""

    def running(rows: DataFrame, within: list[str], order: str, name: str) -> DataFrame:
        earlier = Window.partitionBy(*within).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(name, F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))

    shards = sizes.groupBy("shard").agg(F.sum("tokens").alias("tokens")).withColumn("group", F.floor(F.col("shard") / SHARDS).cast("int"))
    groups = running(shards.groupBy("group").agg(F.sum("tokens").alias("tokens")), [], "group", "groups").drop("tokens")
    shards = running(shards, ["group"], "shard", "shards").join(groups, "group").select("shard", "shards", "groups")
    blocks = running(sizes, ["shard"], "block", "blocks")
    return blocks.join(shards, "shard").select("shard", "block", (F.col("groups") + F.col("shards") + F.col("blocks")).alias("before"))


def round_trip(docs: DataFrame, tokenizer_path: str, end: int = 2) -> DataFrame:
    """Writes the token file of ``docs`` and returns its documents, read back."""
    return read_documents(write_blocks(docs, tokenizer_path, end))
