"""Ranked lexical search over a two-level quantised index (operator 12).

A term is a run of ASCII letters and digits and of characters beyond ASCII, A-Z
lower-cased. Documents are indexed in blocks; a block row holds its distinct
terms, each with its postings at two levels:

- ``impacts``: one byte a posting, the length-normalised frequency rounded
  upwards to a multiple of ``STEP``;
- ``docs, tf`` and the documents' ``lengths``: what the exact integers are made of.

A search weighs the asked terms by document frequencies that the blocks' posting
lists give, sums the bytes to bounds of every document's score, and takes every
item's k-th highest lower bound over all blocks. Documents whose upper bound
reaches it, all of them, are scored again in exact integers, and ranked.
Impacts do not depend on weights, so one index answers any items.

Items are asked in sets of at most ``ASKED`` terms on average, which go to the
executors as one broadcast; a set's terms, weights and limits are all that the
driver ever holds.

Defined results: a null or empty text, or one without a term, is found by no
item and does not count. Rows that share an item_id, null included, are one item
with the terms of all. Repeated documents are found each; equal scores are
ordered by doc_id, a null one last. Very long texts are indexed whole. Items
without known terms give no rows, and so do empty tables; extra columns are
ignored. Sums stay exact while an item has fewer than 600,000 terms.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import removed, repeated_ranges, written

#: Documents and postings of a block (a document is never split).
BLOCK, POSTINGS = 1024, 1 << 22
#: Unit of the byte impacts: frequencies are below one million.
STEP = 4_000
#: Terms of the items that are asked together, and items whose terms share a matrix.
ASKED, TOGETHER = 200_000, 64
#: Share of the length that does not count, and of the one that does, in percent.
FLAT, SLOPE = 10, 90
#: What each byte of a text becomes: lower-cased, itself, or a blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_BYTES).split()


@dataclass(frozen=True)
class Index:
    """Blocks and what their impacts rest on: documents with a term, all terms."""

    blocks: DataFrame
    documents: int
    length: int


def _normal(lengths: np.ndarray, documents: int, length: int) -> np.ndarray:
    return np.array([FLAT + SLOPE * n * documents // max(1, length) for n in lengths.tolist()], dtype=np.int64)


def _frequencies(tf: np.ndarray, normal: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1_000 * tf + 8 * normal)


def _sizes(docs: DataFrame) -> tuple[int, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = total = 0
        for batch in batches:
            for text in batch.column(0):
                n = len(terms(text.as_py()))
                held, total = held + (n > 0), total + n
        yield pa.RecordBatch.from_pydict({"held": pa.array([held], pa.int64()), "total": pa.array([total], pa.int64())})

    row = docs.select("text").mapInArrow(run, "held long, total long").agg(F.sum("held").alias("held"), F.sum("total").alias("total")).first()
    return row["held"] or 0, row["total"] or 0


def _block_row(number: int, ids: list, counts: list[Counter], documents: int, length: int, id_type: pa.DataType) -> pa.RecordBatch:
    known: dict[bytes, int] = {}
    for c in counts:
        for t in c:
            if t not in known:
                known[t] = len(known)
    sizes = np.array([len(c) for c in counts], dtype=np.int64)
    of = np.fromiter((known[t] for c in counts for t in c), dtype=np.int64, count=int(sizes.sum()))
    tf = np.fromiter((n for c in counts for n in c.values()), dtype=np.int64, count=len(of))
    doc = np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(of, kind="stable")
    doc, tf = doc[order], tf[order]
    lengths = np.bincount(doc, weights=tf, minlength=len(ids)).astype(np.int64)
    impacts = -(-_frequencies(tf, _normal(lengths, documents, length)[doc]) // STEP)
    binary = lambda values, kind: pa.array([values.astype(kind).tobytes()], pa.binary())
    return pa.RecordBatch.from_arrays([
        pa.array([number], pa.int64()), pa.array([documents], pa.int64()), pa.array([length], pa.int64()), pa.array([ids], pa.list_(id_type)), binary(lengths, "<i8"),
        pa.array([b" ".join(known)], pa.binary()), binary(np.bincount(of, minlength=len(known)), "<u4"), binary(impacts, "u1"), binary(doc, "<u4"), binary(tf, "<u4"),
    ], names=["block", "documents", "length", "doc_ids", "lengths", "terms", "holding", "impacts", "docs", "tf"])


def build(docs: DataFrame, label: str = "lexical-index") -> Index:
    """The index of ``docs`` (doc_id, text), written to the shared folder."""
    id_type, kind = to_arrow_type(docs.schema["doc_id"].dataType), docs.schema["doc_id"].dataType.simpleString()
    documents, length = _sizes(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        counts: list[Counter] = []
        postings = 0
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                for name, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = Counter(terms(text))
                    if not found:
                        continue
                    ids.append(name)
                    counts.append(found)
                    postings += len(found)
                    if len(ids) >= BLOCK or postings >= POSTINGS:
                        yield _block_row(number, ids, counts, documents, length, id_type)
                        ids, counts, postings, number = [], [], 0, number + 1
        if ids:
            yield _block_row(number, ids, counts, documents, length, id_type)

    schema = f"block long, documents long, length long, doc_ids array<{kind}>, lengths binary, terms binary, holding binary, impacts binary, docs binary, tf binary"
    return Index(written(docs.select("doc_id", "text").mapInArrow(run, schema), label), documents, length)


def stored(index: Index, path: str) -> None:
    """Keeps the index for later sessions."""
    index.blocks.write.mode("overwrite").parquet(path)


def opened(spark, path: str) -> Index:
    """An index that :func:`stored` has kept."""
    blocks = spark.read.parquet(path)
    row = blocks.select("documents", "length").first()
    return Index(blocks, *(row or (0, 0)))


class Asked:
    """Items asked together: numbers of their terms and, later, their weights."""

    def __init__(self, items: dict, together: int = TOGETHER):
        self.ids, self.together = list(items), together
        self.number = {t: i for i, t in enumerate(sorted(set().union(*items.values()) if items else ()))}
        self.of = [np.sort(np.fromiter((self.number[t] for t in found), dtype=np.int64, count=len(found))) for found in items.values()]
        self.weight = np.zeros(len(self.number), dtype=np.int64)
        self.least = np.zeros(len(self.ids))

    def weigh(self, holding: dict[int, int], documents: int) -> None:
        for i in range(len(self.weight)):
            self.weight[i] = math.floor(1000 * math.log((2 * documents + 2) / (2 * holding.get(i, 0) + 1)))


class _Block:
    """The postings of asked terms in one block."""

    COLUMNS = ("doc_ids", "lengths", "terms", "holding", "impacts", "docs", "tf")

    def __init__(self, row: dict, asked: Asked):
        self.row = row
        found = [(asked.number[t], k) for k, t in enumerate(row["terms"].split(b" ")) if t in asked.number]
        found.sort()
        self.term = np.array([i for i, _ in found], dtype=np.int64)
        holding = np.frombuffer(row["holding"], "<u4").astype(np.int64)
        ends = np.cumsum(holding)
        place = np.array([k for _, k in found], dtype=np.int64)
        self.holding = holding[place]
        self.at = repeated_ranges(ends[place] - self.holding, self.holding)
        self.owner = np.repeat(np.arange(len(place)), self.holding)
        self.size = len(row["lengths"]) // 8

    def bounds(self) -> None:
        self.doc = np.frombuffer(self.row["docs"], "<u4").astype(np.int64)[self.at]
        self.impact = np.frombuffer(self.row["impacts"], "u1").astype(np.float64)[self.at]

    def items(self, asked: Asked) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Some items at a time: their numbers, the rows of ``term`` that any of
        them has, and their weights on these."""
        for begin in range(0, len(asked.ids), asked.together):
            some = np.arange(begin, min(begin + asked.together, len(asked.ids)))
            weights = np.zeros((len(some), len(self.term)))
            for k, i in enumerate(some):
                mine = np.isin(self.term, asked.of[i], assume_unique=True)
                weights[k, mine] = asked.weight[self.term[mine]]
            rows = np.flatnonzero(weights.any(axis=0))
            yield some, rows, weights[:, rows]

    def matrix(self, rows: np.ndarray, values: np.ndarray, docs: np.ndarray | None = None) -> np.ndarray:
        """``values`` of the postings as terms times documents (of ``docs``)."""
        place = np.full(len(self.term), -1)
        place[rows] = np.arange(len(rows))
        column = np.arange(self.size)
        if docs is not None:
            column = np.full(self.size, -1)
            column[docs] = np.arange(len(docs))
        mine = (place[self.owner] >= 0) & (column[self.doc] >= 0)
        out = np.zeros((len(rows), self.size if docs is None else len(docs)))
        out[place[self.owner[mine]], column[self.doc[mine]]] = values[mine]
        return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns)}


def _holding(index: Index, shared) -> dict[int, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        total = np.zeros(len(asked.number), dtype=np.int64)
        for row in _rows(batches):
            block = _Block(row, asked)
            total[block.term] += block.holding
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(seen, pa.int32()), "holding": pa.array(total[seen], pa.int64())})

    found = index.blocks.select("terms", "holding", "lengths").mapInArrow(run, "term int, holding long")
    return {r["term"]: r["total"] for r in found.groupBy("term").agg(F.sum("holding").alias("total")).collect()}


def _least(index: Index, shared, limit: int) -> dict[int, int]:
    """Of every item that has as many documents, its limit-th highest lower bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best = np.zeros((len(asked.ids), limit))
        for row in _rows(batches):
            block = _Block(row, asked)
            block.bounds()
            for some, rows, weights in block.items(asked):
                lower = weights @ block.matrix(rows, np.maximum(block.impact - 1, 0)) * STEP
                both = np.concatenate([best[some], lower], axis=1)
                best[some] = np.partition(both, both.shape[1] - limit, axis=1)[:, both.shape[1] - limit :]
        item, column = np.nonzero(best)
        yield pa.RecordBatch.from_pydict({"item": pa.array(item, pa.int32()), "lower": pa.array(best[item, column].astype(np.int64))})

    found = index.blocks.select("lengths", "terms", "holding", "impacts", "docs").mapInArrow(run, "item int, lower long")
    order = Window.partitionBy("item").orderBy(F.desc("lower"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return {r["item"]: r["lower"] for r in ranked.where(F.col("rank") == limit).collect()}


def _scored(index: Index, shared, limit: int) -> DataFrame:
    """``item, doc_id, score`` of every document whose upper bound reaches the
    item's limit; of a block only what may be among the limit best."""
    kind = index.blocks.schema["doc_ids"].dataType.elementType
    documents, length = index.documents, index.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for row in _rows(batches):
            block = _Block(row, asked)
            block.bounds()
            normal = _normal(np.frombuffer(row["lengths"], "<i8"), documents, length)
            tf = np.frombuffer(row["tf"], "<u4").astype(np.int64)[block.at]
            exact = _frequencies(tf, normal[block.doc]).astype(np.float64)
            for some, rows, weights in block.items(asked):
                upper = weights @ block.matrix(rows, block.impact) * STEP
                hopeful = (upper >= asked.least[some][:, None]) & (upper > 0)
                docs = np.flatnonzero(hopeful.any(axis=0))
                if not len(docs):
                    continue
                score = np.where(hopeful[:, docs], weights @ block.matrix(rows, exact, docs), 0)
                if len(docs) > limit:
                    score[score < np.partition(score, len(docs) - limit, axis=1)[:, len(docs) - limit, None]] = 0
                item, column = np.nonzero(score)
                yield pa.RecordBatch.from_arrays([
                    pa.array(some[item], pa.int32()), pa.array([row["doc_ids"][d] for d in docs[column].tolist()], to_arrow_type(kind)), pa.array(score[item, column].astype(np.int64)),
                ], names=["item", "doc_id", "score"])

    return index.blocks.select(*_Block.COLUMNS).mapInArrow(run, f"item int, doc_id {kind.simpleString()}, score long")


def search(index: Index, items: DataFrame, limit: int = 10) -> DataFrame:
    """``item_id, rank, doc_id, score``: of every item (item_id, text) its
    ``limit`` highest-scoring documents."""
    spark, kind = items.sparkSession, items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(set(terms(t))) for t in batch.column(1).to_pylist()], pa.list_(pa.binary()))], names=["item_id", "terms"])

    split = written(items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, terms array<binary>"), "asked-items")
    total = split.agg(F.sum(F.size("terms")).alias("total")).first()["total"] or 0
    sets = max(1, -(-total // ASKED))
    out = None
    for k in range(sets):
        mine: dict = {}
        for row in split.where(F.pmod(F.xxhash64("item_id"), F.lit(sets)) == k).collect():
            mine.setdefault(row["item_id"], set()).update(map(bytes, row["terms"]))
        asked = Asked(mine, TOGETHER)
        asked.weigh(_holding(index, spark.sparkContext.broadcast(asked)), index.documents)
        for item, lower in _least(index, spark.sparkContext.broadcast(asked), limit).items():
            asked.least[item] = lower
        scored = _scored(index, spark.sparkContext.broadcast(asked), limit)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
        names = spark.createDataFrame([(i, name) for i, name in enumerate(asked.ids)], f"item int, item_id {kind}")
        found = written(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
        out = found if out is None else out.union(found)
    removed(spark, split)
    return out


def ranked(docs: DataFrame, items: DataFrame, limit: int = 10) -> DataFrame:
    """Indexes ``docs`` and asks all ``items``."""
    index = build(docs)
    found = search(index, items, limit)
    removed(docs.sparkSession, index.blocks)
    return found
