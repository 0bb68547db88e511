"""Removal of passages that an earlier document has (operator 13).

A window is ``WINDOW`` consecutive words of a document. Every word goes that some
window covers whose words also occur, in the same order, in a document with a
smaller doc_id. All windows are judged on the input.

Documents are cut into chunks of a bounded number of words, kept as a table of
word numbers; four steps find which windows recur and where:

1. In every window the ``SEED`` words with the least hash are its seed: equal
   windows have equal seeds, and neighbours mostly share one, so the seeds are a
   fifth of the words. A chunk sends each of its seeds once.
2. Seeds that several documents have go back to the chunks that hold them.
3. Windows around such a seed are confirmed by 96 bits of hash of all their words:
   a chunk sends each once, with its least doc_id and where it is; whether that
   is the least of all chunks goes back.
4. A chunk compiles the recurring windows into Aho-Corasick automata, shards of
   at most ``PATTERNS`` phrases, and streams all its documents through them. A
   word is spelled as one of ``LETTERS`` letters, since nodes of many edges are
   slow; what an automaton finds is then compared word by word. Every occurrence
   is removed but those in the first document that has the phrase.

What is grouped by a seed or a window is one small row a chunk, never a row an
occurrence, and the sorts behind the groups spill.

Defined results: a null or empty text, or one of fewer words than a window, is
kept as it is (no words: an empty text). A row with a null doc_id is kept whole
and counts as no document's predecessor. Rows that share a doc_id are no
predecessors of each other; each gives a row. Very long texts are searched
whole, in a chunk of their own. An empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import repeated_ranges, scratch_dir, written

#: Words of a window, and of the seed that stands for it.
WINDOW, SEED = 13, 5
#: Words and documents of a chunk (a document is never split).
CHUNK, DOCUMENTS = 1 << 19, 1 << 16
#: Phrases of one automaton, and letters that stand for words in it.
PATTERNS, LETTERS = 80_000, 64
#: Positions whose seeds are chosen at once.
AT_ONCE = 1 << 16


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _hashes(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Order-sensitive hashes of ``length`` words from every start."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for k in range(length):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + words[starts + k])
    return out


class _Chunk:
    """Words of some documents, one after another."""

    def __init__(self, row: dict):
        self.doc_ids = row["doc_ids"]
        self.lengths = np.frombuffer(row["lengths"], "<i8")
        self.words = row["words"].split(b" ") if row["words"] else []
        self.ids = np.frombuffer(row["ids"], "u1").reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
        self.ends = np.cumsum(self.lengths)
        self.named = np.array([i is not None for i in self.doc_ids], dtype=bool)
        self.number = np.array([0 if i is None else i for i in self.doc_ids], dtype=np.int64)

    def starts(self) -> tuple[np.ndarray, np.ndarray]:
        """Where windows begin, and in which document."""
        windows = np.where(self.named, np.maximum(0, self.lengths - WINDOW + 1), 0)
        doc = np.repeat(np.arange(len(windows)), windows)
        within = np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows)
        return (self.ends - self.lengths)[doc] + within, doc

    def hashed(self) -> tuple[np.ndarray, np.ndarray]:
        both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.words)), dtype="<u8").reshape(-1, 2)
        return both[:, 0][self.ids], both[:, 1][self.ids]

    def seeds(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The seed of every window: the least hash of its runs of words."""
        if not len(starts):
            return np.zeros(0, dtype=np.uint64)
        grams = _hashes(words, np.arange(len(words) - SEED + 1), SEED)
        views = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - SEED + 1)
        return np.concatenate([views[starts[b : b + AT_ONCE]].min(axis=1) for b in range(0, len(starts), AT_ONCE)])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    known: dict[bytes, int] = {}
    doc_ids: list = []
    lengths: list[int] = []
    held: list[np.ndarray] = []

    def row() -> pa.RecordBatch:
        ids = np.concatenate(held).astype("<u4") if held else np.zeros(0, "<u4")
        return pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([np.array(lengths, dtype="<i8").tobytes()], pa.binary()),
            pa.array([b" ".join(known)], pa.binary()), pa.array([ids.view("u1").reshape(-1, 4).T.tobytes()], pa.binary()),
        ], names=["chunk", "doc_ids", "lengths", "words", "ids"])

    size = 0
    for batch in batches:
        for begin in range(0, batch.num_rows, 200):
            part = batch.slice(begin, 200)
            for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words = (text or "").encode("utf-8", "replace").split()
                for w in dict.fromkeys(words):
                    if w not in known:
                        known[w] = len(known)
                doc_ids.append(name)
                lengths.append(len(words))
                held.append(np.fromiter(map(known.__getitem__, words), dtype=np.uint32, count=len(words)))
                size += len(words)
                if size >= most or len(doc_ids) >= DOCUMENTS:
                    yield row()
                    known, doc_ids, lengths, held, size, number = {}, [], [], [], 0, number + 1
    if doc_ids:
        yield row()


def _send_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        chunk = _Chunk(row)
        starts, doc = chunk.starts()
        seeds = chunk.seeds(chunk.hashed()[0], starts)
        least, most = _extremes(seeds, chunk.number[doc])
        names = np.unique(seeds)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), row["chunk"])), pa.array(names.view(np.int64)), pa.array(least < most)], names=["chunk", "seed", "many"])


def _extremes(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of every distinct key, keys ascending."""
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    sorted_values = values[order]
    return (np.minimum.reduceat(sorted_values, first), np.maximum.reduceat(sorted_values, first)) if len(first) else (sorted_values, sorted_values)


def _send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        chunk = _Chunk(row)
        starts, doc = chunk.starts()
        one, two = chunk.hashed()
        recurring = np.sort(np.array(row["seeds"], dtype=np.int64).view(np.uint64))
        seeds = chunk.seeds(one, starts)
        place = np.minimum(np.searchsorted(recurring, seeds), len(recurring) - 1)
        near = recurring[place] == seeds
        starts, doc = starts[near], doc[near]
        high, low = _hashes(one, starts, WINDOW), (_hashes(two, starts, WINDOW) >> np.uint64(33)).astype(np.int64)
        number = chunk.number[doc]
        order = np.lexsort((number, low, high))
        high, low, number, at = high[order], low[order], number[order], starts[order]
        first = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))) if len(high) else np.zeros(0, dtype=np.int64)
        last = np.append(first[1:], len(high)) - 1
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(len(first), row["chunk"])), pa.array(at[first].astype(np.int32)), pa.array(high[first].view(np.int64)), pa.array(low[first].astype(np.int32)),
            pa.array(number[first]), pa.array(number[first] < number[last]),
        ], names=["chunk", "at", "high", "low", "doc", "many"])


def covered(chunk: _Chunk, windows: np.ndarray, most: int = PATTERNS) -> np.ndarray:
    """Which words of the chunk go: those of every occurrence of a window that
    begins at ``w`` of ``windows``. If an earlier chunk's document has it first,
    all occurrences go; ``-1 - w`` says that a document of this chunk does, and
    the occurrences in that one stay."""
    own = windows < 0
    at = np.where(own, -1 - windows, windows)
    change = np.zeros(len(chunk.ids) + 1, dtype=np.int64)
    letters = np.frombuffer(b"".join(map(xxhash.xxh32_digest, chunk.words)), "u1").reshape(-1, 4)[:, 0] % LETTERS + ord("0")
    # A letter of its own after every document keeps phrases within one.
    doc = np.repeat(np.arange(len(chunk.lengths)), chunk.lengths)
    place = np.arange(len(doc)) + doc
    spelling = np.full(len(doc) + len(chunk.lengths), ord("\n"), dtype=np.uint8)
    spelling[place] = letters[chunk.ids]
    text = spelling.tobytes().decode("ascii")
    word = np.zeros(len(spelling), dtype=np.int64)
    word[place] = np.arange(len(doc))
    for begin in range(0, len(at), most):
        some, mine = at[begin : begin + most], own[begin : begin + most]
        alike: dict[str, list[int]] = {}
        for k, p in enumerate(place[some].tolist()):
            alike.setdefault(text[p : p + WINDOW], []).append(k)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, phrase in enumerate(alike):
            automaton.add_word(phrase, k)
        automaton.make_automaton()
        hits = np.fromiter(chain.from_iterable(automaton.iter(text)), dtype=np.int64).reshape(-1, 2)
        # Phrases spelled alike are told apart by their words.
        size = np.fromiter(map(len, alike.values()), dtype=np.int64, count=len(alike))
        member = np.fromiter(chain.from_iterable(alike.values()), dtype=np.int64, count=int(size.sum()))
        phrase = member[repeated_ranges((np.cumsum(size) - size)[hits[:, 1]], size[hits[:, 1]])]
        begins = np.repeat(word[hits[:, 0]] - WINDOW + 1, size[hits[:, 1]])
        same = chunk.named[doc[begins]]
        for k in range(WINDOW):
            same &= chunk.ids[begins + k] == chunk.ids[some[phrase] + k]
        phrase, begins = phrase[same], begins[same]
        number = chunk.number[doc[begins]]
        first = np.full(len(some), np.iinfo(np.int64).max)
        np.minimum.at(first, phrase, number)
        goes = begins[~mine[phrase] | (number > first[phrase])]
        np.add.at(change, goes, 1)
        np.add.at(change, goes + WINDOW, -1)
    return np.cumsum(change[:-1]) > 0


SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def _remove(with_text: bool, patterns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            chunk = _Chunk(row)
            gone = covered(chunk, np.array(row["windows"] or [], dtype=np.int64), patterns)
            spans, texts = [], []
            for end, length in zip(chunk.ends.tolist(), chunk.lengths.tolist()):
                own = gone[end - length : end]
                edge = np.flatnonzero(np.diff(own.view(np.int8), prepend=0, append=0))
                spans.append([{"begin": b, "end": e} for b, e in edge.reshape(-1, 2).tolist()])
                texts.append(b" ".join([chunk.words[i] for i in chunk.ids[end - length : end][~own].tolist()]))
            columns = [
                pa.array(chunk.doc_ids, pa.int64()), pa.array(chunk.lengths), pa.array(spans, SPANS), pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                *([pa.array([t.decode("utf-8", "replace") for t in texts])] if with_text else []),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "removed", "kept_sha256", "text"][: len(columns)])

    return run


def without_repeats(docs: DataFrame, text: bool = True, chunk: int = CHUNK, patterns: int = PATTERNS) -> DataFrame:
    """``doc_id, n_words, removed, kept_sha256`` of every row (integer doc_id,
    text), and ``text``, the kept words joined by a space. ``removed``: the word
    ranges that go, as ``begin`` and ``end``."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunked = source.mapInArrow(lambda batches: _chunks(batches, chunk), "chunk long, doc_ids array<long>, lengths binary, words binary, ids binary")
    # Bucketed, so that answers move to the chunks and the chunks stay.
    name = f"repeat_chunks_{uuid.uuid4().hex}"
    buckets = max(1, 2 * source.rdd.getNumPartitions())
    chunked.write.bucketBy(buckets, "chunk").sortBy("chunk").option("compression", "zstd").option("path", f"{scratch_dir(spark)}/{name}").saveAsTable(name)
    try:
        chunks = spark.table(name)
        same = Window.partitionBy("seed")
        seeds = (
            chunks.mapInArrow(_send_seeds, "chunk long, seed long, many boolean")
            .withColumn("recurs", (F.count("*").over(same) > 1) | F.max("many").over(same)).where("recurs")
            .groupBy("chunk").agg(F.collect_list("seed").alias("seeds"))
        )
        same = Window.partitionBy("high", "low")
        windows = (
            chunks.join(seeds, "chunk").mapInArrow(_send_windows, "chunk long, at int, high long, low int, doc long, many boolean")
            .withColumn("own", F.col("doc") == F.min("doc").over(same)).where("many OR NOT own")
            .groupBy("chunk").agg(F.collect_list(F.when(F.col("own"), -1 - F.col("at")).otherwise(F.col("at"))).alias("windows"))
        )
        schema = "doc_id long, n_words long, removed array<struct<begin:int,end:int>>, kept_sha256 string" + ", text string" * text
        return written(chunks.join(windows, "chunk", "left").mapInArrow(_remove(text, patterns), schema), "without-repeats")
    finally:
        _dropped(spark, name)


def _dropped(spark, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/{name}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def digests(docs: DataFrame, chunk: int = CHUNK, patterns: int = PATTERNS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row."""
    found = without_repeats(docs, False, chunk, patterns)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["begin"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), "kept_sha256")
