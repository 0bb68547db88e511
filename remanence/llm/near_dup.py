"""Near-duplicate groups by HyperMinHash (operator 4).

Each text's set of word shingles is hashed once. The top bits of a hash choose a
bucket; of the least remainder in a bucket the register keeps the count of
leading zeros and the mantissa bits after them, 16 bits in all. Empty buckets
borrow the register of a filled one, chosen by a fixed random ranking that both
sides of a pair share. Bands of registers make candidates; the share of equal
registers, corrected for chance collisions, estimates the Jaccard similarity;
what passes is confirmed on the full sets.

Groups are linked without listing their pairs:

1. Texts with one shingle set are one class, with the least doc_id.
2. Every class is compared with one other: of the least classes of its band
   buckets, the one that it meets most often. Confirmed links give components.
3. Buckets that still hold several components are searched in blocks, bounded in
   members and in shingles. A block compares across components only, unites two
   as soon as one link between them is confirmed on the full sets, and returns
   that link alone: fewer rows than members. The bucket's largest component is
   dealt out once; only the rest of the bucket meets all of its blocks. No link
   between components is lost, as every pair meets in its first common bucket.

Bands of 6 registers, 42 of them, miss a pair at similarity 0.8 with probability
3e-6. Every stage's table is written to the shared folder, so lost executors
cost a stage, not the job.

Defined results: a null text, or one without words, has an empty set, is linked
with nothing and kept. One with fewer words than a shingle is one shingle.
Repeated rows are linked and all carry the same component. A null doc_id takes
its group's least doc_id; if there is none the component is null and the row is
kept. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, written

BUCKETS, MANTISSA = 256, 10
BANDS, ROWS = 42, 6
#: Similarity of a link, as a fraction.
NUMERATOR, DENOMINATOR = 80, 100
#: Members and shingles of one side of a block, on average.
BLOCK, SHINGLES = 2048, 1 << 20
#: Rows of a file, for tables whose rows are small, and for those of texts and sets.
LIGHT, HEAVY = 100_000, 5_000
#: Rows a Python worker gets at once: sets of long texts are wide.
AT_ONCE = 200
#: Standard errors by which an estimate may fall short before a pair is dropped.
ERRORS = 5.0
#: Words whose hashes a process remembers.
_KNOWN = 150_000


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = (text or "").encode("utf-8", "replace").lower().split()
        if not tokens:
            return np.empty(0, dtype=np.uint64)
        known = self.known
        if len(known) > _KNOWN:
            known.clear()
        try:
            h = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        except KeyError:
            for t in tokens:
                if t not in known:
                    known[t] = xxhash.xxh3_64_intdigest(t)
            h = np.fromiter(map(known.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
        width = min(self.words, len(h))
        sets = np.zeros(len(h) - width + 1, dtype=np.uint64)
        for k in range(width):
            sets = _mix(sets * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
        return np.unique(sets)


def _rank_table() -> np.ndarray:
    return np.random.default_rng(11).permuted(np.tile(np.arange(BUCKETS, dtype=np.uint16), (BUCKETS, 1)), axis=1)


def registers(hashes: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted non-empty set."""
    bucket = (hashes >> np.uint64(56)).astype(np.int64)
    least = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    rest = (hashes[least] & np.uint64((1 << 56) - 1)) >> np.uint64(4)
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.uint64)
    zeros = np.uint64(52) - bits
    mantissa = np.where(bits > 0, (rest << (zeros + np.uint64(1))) & np.uint64((1 << 52) - 1), np.uint64(0)) >> np.uint64(52 - MANTISSA)
    found = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    out = np.zeros(BUCKETS, dtype=np.uint16)
    filled = bucket[least]
    out[filled] = found
    if len(filled) < BUCKETS:
        empty = np.setdiff1d(np.arange(BUCKETS), filled, assume_unique=True)
        out[empty] = found[ranks[np.ix_(empty, filled)].argmin(axis=1)]
    return out


#: Chance that registers of different minima are equal: the zero counts must
#: agree (1/3 for geometric counts) and so must the mantissas.
COLLISION = 1 / 3 / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of register rows."""
    return np.maximum(0, ((a == b).mean(axis=-1) - COLLISION) / (1 - COLLISION))


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether a link is possible: by set sizes, surely; by the estimate, up to
    ``ERRORS`` standard errors."""
    goal = NUMERATOR / DENOMINATOR
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    slack = ERRORS * np.sqrt(goal * (1 - goal) / np.minimum(BUCKETS, np.maximum(1, small)))
    return (DENOMINATOR * small >= NUMERATOR * large) & (estimate(a, b) >= goal - slack)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    r = signatures[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    low = r[..., 0] | r[..., 1] << np.uint64(16) | r[..., 2] << np.uint64(32) | r[..., 3] << np.uint64(48)
    high = r[..., 4] | r[..., 5] << np.uint64(16) | np.arange(BANDS, dtype=np.uint64) << np.uint64(32)
    return _mix(low ^ _mix(high)).astype(np.int64)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the wanted similarity, exactly."""
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS)


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, name, n_shingles, node, signature``: node is the digest of the
    whole set, null for an empty one; name finds the row's text again."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, ranks = Shingler(words), _rank_table()
        for batch in batches:
            sets = [shingles(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([registers(s, ranks).tobytes() if len(s) else None for s in sets], pa.binary()),
            ], names=["doc_id", "name", "n_shingles", "node", "signature"])

    return _named(docs).mapInArrow(run, f"doc_id {kind}, name string, n_shingles long, node binary, signature binary")


def _named(docs: DataFrame) -> DataFrame:
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("?"), F.hex(F.xxhash64("text"))))
    return docs.select("doc_id", name.alias("name"), "text")


def _bands(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_signatures(batch.column(1)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys.ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int8), batch.num_rows)), batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS))),
                ], names=["key", "band", "node"])

    return nodes.select("node", "signature").mapInArrow(run, "key long, band byte, node binary")


def _plausible_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                good = plausible(_signatures(batch.column(2)), _signatures(batch.column(3)), batch.column(4).to_numpy(), batch.column(5).to_numpy())
                yield batch.select([0, 1]).filter(pa.array(good))

    one = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sa"), F.col("n_shingles").alias("na"))
    two = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sb"), F.col("n_shingles").alias("nb"))
    sized = pairs.join(one, "a").join(two, "b").where(
        (DENOMINATOR * F.least("na", "nb") >= NUMERATOR * F.greatest("na", "nb"))
    )
    return sized.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a binary, b binary")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``node, hashes``: the full sets of the wanted nodes (node, name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in batches:
            nodes, sets = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingles(text).tobytes()
                if xxhash.xxh3_128_digest(s) == node:
                    nodes.append(node)
                    sets.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())], names=["node", "hashes"])

    texts = _named(docs).drop("doc_id").join(wanted, "name").select("node", "text")
    return texts.mapInArrow(run, "node binary, hashes binary").dropDuplicates(["node"])


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [
                linked(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64))
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    one = sets.select(F.col("node").alias("a"), F.col("hashes").alias("ha"))
    two = sets.select(F.col("node").alias("b"), F.col("hashes").alias("hb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ha", "hb").mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node on an edge: the least node it reaches.

    Each round takes the least label among neighbours and then the label of the
    label, so depth halves; rounds end when nothing changes.
    """
    files = 1 + 2 * edges.count() // LIGHT
    both = written(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct(), "edges", files=files)
    labels = written(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels", files=files)
    while True:
        seen = labels.select(F.col("node").alias("other"), F.col("label").alias("theirs"))
        near = both.join(seen, "other").groupBy("node").agg(F.min("theirs").alias("theirs"))
        lower = labels.join(near, "node").select("node", F.least("label", "theirs").alias("label"), F.col("label").alias("old"))
        lower = written(lower, "lower", files=files)
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = written(lower.join(jump, "label", "left").select("node", F.coalesce("further", "label").alias("label"), (F.coalesce("further", "label") != F.col("old")).alias("moved")), "labels", files=files)
        removed(edges.sparkSession, labels, lower)
        labels = after.select("node", "label")
        if after.where("moved").limit(1).count() == 0:
            removed(edges.sparkSession, both)
            return labels


class _Block:
    """Members of two blocks of one bucket, searched row by row."""

    def __init__(self, rows: dict):
        self.node = rows["node"]
        self.label = np.unique(np.array([*rows["label"], None], dtype=object)[:-1], return_inverse=True)[1]
        self.n, self.own = np.array(rows["n"]), np.array(rows["own"])
        self.square, self.band = rows["square"][0], rows["band"][0]
        self.registers = np.frombuffer(b"".join(rows["signature"]), dtype=np.uint16).reshape(-1, BUCKETS)
        self.keys = band_keys(self.registers)
        self.sets = [np.frombuffer(x, dtype=np.uint64) for x in rows["hashes"]]

    def confirmed(self, k: int, some: np.ndarray) -> np.ndarray:
        """Those of ``some`` whose full sets are linked with member k's."""
        mine, good, begin = self.sets[k], [], 0
        ends = np.cumsum(self.n[some])
        while begin < len(some):
            end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + SHINGLES, side="right")))
            part = some[begin:end]
            tokens = np.concatenate([self.sets[m] for m in part])
            same = mine[np.minimum(np.searchsorted(mine, tokens), len(mine) - 1)] == tokens
            shared = np.add.reduceat(same.astype(np.int64), np.cumsum(self.n[part]) - self.n[part])
            good.append(part[DENOMINATOR * shared >= NUMERATOR * (self.n[part] + self.n[k] - shared)])
            begin = end
        return np.concatenate(good) if good else some

    def links(self) -> tuple[list, list]:
        """Confirmed links, one for each union of two components."""
        a, b = [], []
        most = self.label == np.bincount(self.label).argmax()
        every = np.arange(len(self.node))
        for k in np.flatnonzero(~most):
            near = (self.label != self.label[k]) & (most | (every > k))
            if not self.square:
                near &= self.own != self.own[k]
            near = np.flatnonzero(near & (DENOMINATOR * np.minimum(self.n, self.n[k]) >= NUMERATOR * np.maximum(self.n, self.n[k])))
            near = near[(self.keys[near] == self.keys[k]).argmax(axis=1) == self.band] if len(near) else near
            near = near[plausible(self.registers[k], self.registers[near], self.n[k], self.n[near])] if len(near) else near
            if not len(near):
                continue
            # Of each component the best estimate first, which mostly settles it.
            near = near[np.argsort(-estimate(self.registers[k], self.registers[near]), kind="stable")]
            first = np.unique(self.label[near], return_index=True)[1]
            for some in (near[first], np.delete(near, first)):
                for m in self.confirmed(k, some[self.label[some] != self.label[k]]):
                    if self.label[m] != self.label[k]:
                        self.label[self.label == self.label[m]] = self.label[k]
                        a.append(self.node[k])
                        b.append(self.node[m])
        return a, b


def _across(shared: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a, b`` that join components within a bucket; see the module."""
    labelled = shared.join(labels, "node", "left").join(nodes.select("node", "n_shingles"), "node").select(
        "key", "node", "band", F.col("n_shingles").alias("n"), F.coalesce("label", "node").alias("label")
    )
    parts = labelled.groupBy("key", "label").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"))
    most = F.max(F.struct("members", "label", "shingles"))
    blocks = lambda members, shingles: F.ceil(F.greatest(members / BLOCK, shingles / SHINGLES)).cast("int")
    open_ = (
        parts.groupBy("key").agg(F.count("*").alias("parts"), most.alias("most"), F.sum("members").alias("members"), F.sum("shingles").alias("shingles")).where("parts > 1")
        .select(
            "key", F.col("most.label").alias("major"), blocks(F.col("most.members"), F.col("most.shingles")).alias("majors"),
            blocks(F.col("members") - F.col("most.members"), F.col("shingles") - F.col("most.shingles")).alias("minors"),
        )
    )
    # Task (i, j): the minor block i with the major block j, or with the minor block j - majors.
    is_major = F.col("label") == F.col("major")
    own = F.when(is_major, F.pmod(F.hash("node"), "majors")).otherwise(F.pmod(F.hash("node"), "minors"))
    task = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    as_major = F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda i: task(i, F.col("own")))
    as_minor = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("majors") - 1), lambda j: task(F.col("own"), j)),
        F.transform(F.sequence(F.lit(0), F.col("minors") - 1), lambda j: task(F.least("own", j), F.col("majors") + F.greatest("own", j))),
    )
    members = (
        labelled.join(open_, "key").withColumn("own", own)
        .withColumn("task", F.explode(F.when(is_major, as_major).otherwise(as_minor)))
        .select(
            "key", "task.i", "task.j", (F.col("task.j") == F.col("majors") + F.col("task.i")).alias("square"),
            F.when(is_major, F.col("own")).otherwise(F.col("majors") + F.col("own")).alias("own"), "band", "node", "label", "n",
        )
        .join(nodes.select("node", "signature"), "node").join(sets, "node")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        at = None
        for batch in batches:
            columns = batch.to_pydict()
            keys = list(zip(columns["key"], columns["i"], columns["j"]))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for begin, end in zip(cuts, cuts[1:]):
                if begin < end and keys[begin] != at:
                    if held:
                        yield as_batch(held)
                    held, at = {c: [] for c in columns}, keys[begin]
                for c, values in columns.items():
                    held[c] += values[begin:end]
        if held:
            yield as_batch(held)

    def as_batch(rows: dict) -> pa.RecordBatch:
        a, b = _Block(rows).links()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a binary, b binary")


def groups(docs: DataFrame, words: int = 2) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row."""
    spark = docs.sparkSession
    sketched = written(sketch(docs.select("doc_id", "text"), words), "sketches", 2000)
    rows = sketched.count()
    nodes = written(
        sketched.where("node IS NOT NULL").groupBy("node").agg(
            F.min("doc_id").alias("root"), F.min("name").alias("name"), F.min("n_shingles").alias("n_shingles"), F.min("signature").alias("signature")
        ),
        "nodes", files=1 + 4 * rows // LIGHT,
    )
    heavy = 1 + rows // HEAVY
    hubs = _bands(nodes).groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
    shared = written(_bands(nodes).join(hubs, "key").select("key", "band", "node", "hub"), "buckets", files=1 + BANDS * rows // (4 * LIGHT))
    sets = written(_sets(docs, nodes.join(shared.select("node").distinct(), "node", "left_semi").select("name", "node"), words), "sets", AT_ONCE, heavy)
    met = shared.where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("times"))
    stars = met.groupBy("node").agg(F.max(F.struct("times", "hub")).alias("best")).select(F.col("node").alias("a"), F.col("best.hub").alias("b"))
    edges = written(_confirmed(_plausible_pairs(stars, nodes), sets), "star-links", AT_ONCE, heavy)
    labels = components(edges)
    more = written(_across(shared.select("key", "band", "node"), labels, nodes, sets), "cross-links", AT_ONCE, heavy)
    if more.limit(1).count():
        removed(spark, labels)
        labels = components(edges.union(more))
    removed(spark, shared, sets, edges, more)
    roots = labels.join(nodes.select("node", "root"), "node")
    least = roots.groupBy("label").agg(F.min("root").alias("low"))
    grouped = roots.join(least, "label").select("node", "low")
    # Written, so that a group of very many copies meets a plain join, which can be split.
    named = written(nodes.select("node", "root").join(grouped, "node", "left").select("node", F.coalesce("low", "root").alias("component")), "components", files=1 + rows // LIGHT)
    removed(spark, nodes, labels)
    out = sketched.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    )


def survivors(docs: DataFrame, words: int = 5) -> DataFrame:
    """One document of each group, all columns of ``docs``. Rows that share a
    doc_id are one document, the least of them; rows with a null doc_id stay."""
    kept = groups(docs, words).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    one = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row")).select("row.*")
    return one.union(docs.where("doc_id IS NULL"))
