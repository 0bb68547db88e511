"""Retrieval: full text (BM25), vectors, rank fusion, hybrid search, recall."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import settled

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
RRF_K, TEXT_ONLY = 60, 1.5
#: Vectors and queries a block of a vector search, queries of one matrix product.
BLOCK, ASKING, SLICE = 8192, 4096, 256
#: Documents a slice and queries a block of a text search; documents and terms of one matrix product.
DOCUMENTS, PASSAGES, HEIGHT, WIDTH = 4096, 512, 1024, 2048
#: A term goes through a matrix product if more than one query of so many asks for it.
COMMON = 32
#: Asked terms that are sent to every task; where there are more, they are joined.
SENT = 100_000
#: A token, as :func:`tokens` cuts it.
WORD = re.compile(r"[^\W_]{2,}")
#: Bytes as they are, but for capitals of ASCII, and blanks for what is no letter or digit of it.
APART = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())
#: What rounding to six digits can make equal, and the error of a product.
MARGIN = 1.1e-6


@dataclass(frozen=True)
class Policy:
    budget: int
    library: int
    least: float


#: Budgets and least scores of the recall policies.
POLICIES = {"conversation": Policy(5, 2, 0.25), "briefing": Policy(5, 1, 0.15), "reflex": Policy(3, 1, 0.25), "search": Policy(10, 0, 0.05)}


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, tf, length``: the inverted index of ``docs``."""
    words = docs.select(F.col(key), tokens(F.col(text)).alias("words")).withColumn("length", F.size("words"))
    return words.select(key, "length", F.explode("words").alias("term")).groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 10) -> DataFrame:
    """``query_id, key, rank, score``: best ``limit`` documents a query, any
    query term matching. Higher is better; ties go to the smaller key.

    A text becomes one row: its length and the asked terms in it, by number. The
    rows are settled, so that texts are cut once whatever is asked of them; only
    where a key and length come again are they taken apart and summed.
    """
    spark = docs.sparkSession
    kinds = queries.schema["query_id"].dataType.simpleString(), docs.schema[key].dataType.simpleString()
    asked = queries.select("query_id", "text").mapInArrow(_counter(), f"id {kinds[0]}, length int, terms array<string>, tf array<long>").select(F.col("id").alias("query_id"), F.explode("terms").alias("term")).distinct()
    wanted = asked.select("term").distinct()
    some = [r["term"] for r in wanted.limit(SENT + 1).collect()]
    if len(some) <= SENT:
        asked = asked.join(spark.createDataFrame(list(enumerate(some)), "number int, term string"), "term").select("query_id", F.col("number").alias("term"))
        held = docs.select(key, text).mapInArrow(_counter(spark.sparkContext.broadcast(some)), f"id {kinds[1]}, length int, terms array<int>, tf array<long>")
    else:
        held = docs.select(key, text).mapInArrow(_counter(), f"id {kinds[1]}, length int, terms array<string>, tf array<long>")
    held = settled(held.withColumnRenamed("id", key))
    each = held.select(key, "length", F.explode(F.arrays_zip("terms", "tf")).alias("use")).select(key, "length", F.col("use.terms").alias("term"), F.col("use.tf").alias("tf"))
    corpus = held.agg(F.count("*").alias("n"), (F.sum("length") / F.count("*")).alias("mean"))
    if held.groupBy(key, "length").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        each = settled(each.groupBy(key, "length", "term").agg(F.sum("tf").alias("tf")))
        held = packed(each, key)
    if len(some) > SENT:
        held = packed(each.join(wanted, "term"), key)
    return scored(asked, held, corpus, key, limit)


def packed(each: DataFrame, key: str) -> DataFrame:
    """Postings ``key, length, term, tf`` as rows of :func:`scored`."""
    return each.select(key, "length", F.array("term").alias("terms"), F.array("tf").alias("tf"))


def _counter(few: Broadcast | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from texts to ``id, length, terms, tf``: the number of tokens of
    each text, its distinct ones and their counts; with ``few``, those of its
    list alone, as places in it. Letters newer than the JVM's Unicode are
    letters here."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = None if few is None else pa.array(few.value, pa.string())
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                each, words = _words(part.column(1).to_pylist())
                terms = words.unique() if only is None else only
                code = pc.index_in(words, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)
                asked, wide = code >= 0, max(1, len(terms))
                pair, uses = np.unique(each[asked] * wide + code[asked], return_counts=True)
                ends = pa.array(np.searchsorted(pair, np.arange(len(part) + 1) * wide).astype(np.int32))
                code = pa.array((pair % wide).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(np.bincount(each, minlength=len(part)).astype(np.int32)),
                    pa.ListArray.from_arrays(ends, terms.take(code) if only is None else code), pa.ListArray.from_arrays(ends, pa.array(uses.astype(np.int64))),
                ], names=["id", "length", "terms", "tf"])

    return counted


def _words(texts: list[str | None]) -> tuple[np.ndarray, pa.Array]:
    """The tokens of all ``texts``, and the number of the text of each. Texts are
    cut at what is ASCII and no token first; pieces with other characters are cut
    by the pattern. Only a capital sigma is lower-cased by what surrounds it, so
    where there is one the whole text is."""
    lists = pc.ascii_split_whitespace(pa.array([(t.lower() if "\u03a3" in t else t).encode().translate(APART) if t else b"" for t in texts], pa.string()))
    pieces = lists.flatten()
    each = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    ascii_ = pc.string_is_ascii(pieces).to_numpy(zero_copy_only=False)
    plain = ascii_ & (pc.binary_length(pieces).to_numpy(zero_copy_only=False) > 1)
    odd, of = pieces.filter(pa.array(~ascii_)), each[~ascii_]
    odd = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(odd)], pa.int32()), odd), "\n")[0].as_py().lower().split("\n")[: len(odd)]
    whole = np.fromiter((w.isalnum() and len(w) > 1 for w in odd), bool, len(odd))
    cut = [WORD.findall(w) for w, one in zip(odd, whole) if not one]
    more = np.repeat(of[~whole], np.fromiter(map(len, cut), np.int64, len(cut)))
    return np.concatenate([each[plain], of[whole], more]), pa.concat_arrays([
        pieces.filter(pa.array(plain)), pa.array(odd, pa.string()).filter(pa.array(whole)), pa.array(list(chain.from_iterable(cut)), pa.string()),
    ])


def scored(asked: DataFrame, held: DataFrame, corpus: DataFrame, key: str, limit: int) -> DataFrame:
    """BM25 ranks of ``asked (query_id, term)`` over the postings ``held (key,
    length, terms, tf)`` of all asked terms, any number of them in a row;
    ``corpus``: one row ``n, mean``.

    Documents are dealt to slices and queries to blocks; a slice meets a block
    in one task's matrix, and the best ``limit`` of the slice a query go on. So
    rows grow with the postings, not with the queries that share them.
    """
    many = asked.agg(F.count_distinct("query_id").alias("asking"))
    sizes = F.broadcast(corpus.crossJoin(many).select(
        "n", "mean", *[F.greatest(F.ceil(F.col(c) / k).cast("int"), F.lit(1)).alias(name) for c, k, name in (("n", DOCUMENTS, "slices"), ("asking", PASSAGES, "blocks"))]
    ))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    block = lambda c, k: F.pmod(F.xxhash64(c), F.col(k)).cast("int")
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    df = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    asks = asked.join(df, "term").crossJoin(sizes).select("query_id", "term", idf.alias("idf"), block("query_id", "blocks").alias("i"), every("slices").alias("j"))
    bulk = K1 * (1 - B + B * F.col("length") / F.col("mean"))
    answers = held.crossJoin(sizes).select(F.col(key).alias("key"), "terms", "tf", bulk.alias("bulk"), block(key, "slices").alias("j"), every("blocks").alias("i"))
    kinds = asks.schema["query_id"].dataType.simpleString(), answers.schema["key"].dataType.simpleString()
    summed = answers.groupBy("i", "j").cogroup(asks.groupBy("i", "j")).applyInArrow(
        lambda left, right: _summed(left, right, limit), f"query_id {kinds[0]}, key {kinds[1]}, score double"
    ).select("query_id", F.col("key").alias(key), F.round("score", 6).alias("score"))
    return top(summed, "query_id", [F.desc("score"), F.asc(key)], limit).select("query_id", key, "rank", "score")


def _summed(answers: pa.Table, asks: pa.Table, limit: int) -> pa.Table:
    """``query_id, key, score`` of all that may be among the ``limit`` highest of
    a query once scores are rounded; of equal ones the first keys stay."""
    keys, queries = (t[c].combine_chunks().dictionary_encode(null_encoding="encode") for t, c in ((answers, "key"), (asks, "query_id")))
    terms = asks["term"].combine_chunks().dictionary_encode()
    lists, tf = answers["terms"].combine_chunks(), answers["tf"].combine_chunks().flatten().to_numpy()
    term, n = pc.index_in(lists.flatten(), value_set=terms.dictionary), pc.list_value_length(lists).to_numpy()
    met = pc.is_valid(term).to_numpy(zero_copy_only=False)
    query, doc, bulk = queries.indices.to_numpy(), np.repeat(keys.indices.to_numpy(), n), np.repeat(answers["bulk"].to_numpy(), n)
    part = tf * (K1 + 1) / (tf + bulk)
    doc, term, part = doc[met], term.drop_null().to_numpy(), part[met]
    own, idf = terms.indices.to_numpy(), asks["idf"].to_numpy()
    # Terms that many queries ask for go through matrix products, the others
    # posting by posting.
    uses = np.bincount(own, minlength=len(terms.dictionary))
    line = np.argsort(-uses, kind="stable")
    common, number = int((uses * COMMON > len(queries.dictionary)).sum()), np.empty(len(line), dtype=np.int64)
    number[line] = np.arange(len(line))
    uses, term, own = uses[line], number[term], number[own]
    order = np.lexsort((np.minimum(term, common) // WIDTH, term >= common, doc // HEIGHT))
    doc, term, part = doc[order], term[order], part[order]
    order = np.argsort(own, kind="stable")
    own, query, idf, begin = own[order], query[order], idf[order], np.cumsum(uses) - uses
    place = np.empty(len(keys.dictionary), dtype=np.int64)
    place[pc.sort_indices(keys.dictionary, null_placement="at_start").to_numpy()] = np.arange(len(place))
    weight = []
    for low in range(0, common, WIDTH):
        some = slice(*np.searchsorted(own, (low, min(low + WIDTH, common))))
        right = np.zeros((min(WIDTH, common - low), len(queries.dictionary)))
        np.add.at(right, (own[some] - low, query[some]), idf[some])
        weight.append(right)
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for low in range(0, len(place), HEIGHT):
        high = min(low + HEIGHT, len(place))
        score, hits = np.zeros((high - low, len(queries.dictionary))), slice(*np.searchsorted(doc, (low, high)))
        if hits.start == hits.stop:
            continue
        d, t, w = doc[hits] - low, term[hits], part[hits]
        rare = np.searchsorted(t >= common, True)
        for k, right in enumerate(weight):
            span = slice(*np.searchsorted(t[:rare] // WIDTH, (k, k + 1)))
            if span.start < span.stop:
                left = np.zeros((high - low, len(right)))
                np.add.at(left, (d[span], t[span] - k * WIDTH), w[span])
                score += left @ right
        n = uses[t[rare:]]
        ask = np.repeat(begin[t[rare:]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        cell = np.repeat(d[rare:].astype(np.int64) * score.shape[1], n) + query[ask]
        score += np.bincount(cell, np.repeat(w[rare:], n) * idf[ask], score.size).reshape(score.shape)
        # A rounded score of 0 is still a hit: every shared term adds something.
        cut = np.maximum(np.partition(score, len(score) - limit, axis=0)[len(score) - limit] - MARGIN, 0) if len(score) > limit else np.zeros(score.shape[1])
        y, x = np.nonzero((score >= cut) & (score > 0))
        value = score[y, x]
        y = y + low
        near = np.round(value, 11)
        order = np.lexsort((place[y], -near, x))
        x, y, value, near = x[order], y[order], value[order], near[order]
        first = np.ones(len(x), dtype=bool)
        first[1:] = (x[1:] != x[:-1]) | (near[1:] != near[:-1])
        begins = np.flatnonzero(first)
        kept = np.arange(len(x)) - begins[np.cumsum(first) - 1] < limit if len(x) else first
        found.append((x[kept], y[kept], value[kept]))
    x, y, value = (np.concatenate(c) for c in zip(*found))
    return pa.table({"query_id": queries.dictionary.take(pa.array(x)), "key": keys.dictionary.take(pa.array(y)), "score": pa.array(value)})


def top(df: DataFrame, by: str, order: list, limit: int) -> DataFrame:
    """The first ``limit`` rows of each group, with ``rank`` from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= limit)


def nearest(vectors: DataFrame, queries: DataFrame, key: str, limit: int, most: float | None = None, own: str | None = None) -> DataFrame:
    """``query_id, key, rank, distance``: cosine distance of every vector to the
    queries ``(query_id, vector)``; with ``own``, a query's column of that name
    is the key that it does not find. A vector of another length, null or zero
    is at distance 1.

    Both sides are dealt to blocks and every block of vectors meets every block
    of queries in one matrix product, of which the best ``limit`` a query go on.
    """
    n, m = (max(1, -(-side.count() // size)) for side, size in ((vectors, BLOCK), (queries, ASKING)))
    sound = lambda c: F.when(F.forall(c, lambda x: x.isNotNull()), F.col(c).cast("array<double>")).alias("v")
    block = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    answers = vectors.select(F.col(key).alias("key"), sound("embedding"), block(key, n).alias("j"), every(m).alias("i"))
    asks = queries.select("query_id", (F.lit(None).cast(vectors.schema[key].dataType) if own is None else F.col(own)).alias("own"), sound("vector"), block("query_id", m).alias("i"), every(n).alias("j"))
    if own is not None:
        answers, asks = answers.where("key IS NOT NULL"), asks.where("own IS NOT NULL")
    kinds = asks.schema["query_id"].dataType.simpleString(), answers.schema["key"].dataType.simpleString()
    near = answers.groupBy("i", "j").cogroup(asks.groupBy("i", "j")).applyInArrow(
        lambda left, right: _measured(left, right, limit), f"query_id {kinds[0]}, key {kinds[1]}, distance double"
    ).withColumn("distance", F.round("distance", 6)).withColumnRenamed("key", key)
    if most is not None:
        near = near.where(F.col("distance") <= most)
    return top(near, "query_id", [F.asc("distance"), F.asc(key)], limit).select("query_id", key, "rank", "distance")


def _measured(answers: pa.Table, asks: pa.Table, limit: int) -> pa.Table:
    """``query_id, key, distance`` of all that may be among the ``limit`` nearest
    of a query once distances are rounded: the product only chooses, distances
    are summed in the order of :func:`cosine`. Of equal ones the first keys stay."""
    room = max(pc.max(pc.list_value_length(t["v"])).as_py() or 0 for t in (answers, asks))
    (v, lengths), (q, wanted) = _matrix(answers["v"], room), _matrix(asks["v"], room)
    key, own, query = (t[c].combine_chunks() for t, c in ((answers, "key"), (asks, "own"), (asks, "query_id")))
    code = pa.chunked_array([key, own]).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    codes, owns = code[: len(key)], code[len(key) :]
    owns = np.where(owns < 0, -2, owns)
    place = np.empty(len(key), dtype=np.int64)
    place[pc.sort_indices(key, null_placement="at_start").to_numpy()] = np.arange(len(key))
    found: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if len(v) == 0:
        wanted = wanted[:0]
    with np.errstate(all="ignore"):
        for d in np.unique(wanted):
            same = np.flatnonzero((lengths == d) & (d >= 0))
            a, size, asked = v[: max(d, 0), same], _norm(v[: max(d, 0), same]), np.flatnonzero(wanted == d)
            odd = ~((size > 1e-100) & (size < 1e100))
            unit = np.where(odd, 0, a / size)
            for begin in range(0, len(asked), SLICE):
                some = asked[begin : begin + SLICE]
                b = q[: max(d, 0), some]
                length = _norm(b)
                far = np.ones((len(some), len(key)))
                far[:, same] = 1 - (b / length).T @ unit
                exact = ~((length > 1e-100) & (length < 1e100))
                for x in np.flatnonzero(exact):
                    far[x, same] = _distance(b[:, [x]], a, length[x], size)
                far[:, same[odd]] = np.stack([_distance(b[:, [x]], a[:, odd], length[x], size[odd]) for x in range(len(some))]) if odd.any() else far[:, same[odd]]
                mine = codes[None, :] == owns[some, None]
                far[mine] = np.nan
                cut = np.partition(far, limit - 1, axis=1)[:, limit - 1] if len(key) > limit else np.full(len(some), np.nan)
                x, y = np.nonzero(~(far > cut[:, None] + MARGIN) & ~mine)
                at = np.full(len(key), -1)
                at[same] = np.arange(len(same))
                met = at[y] >= 0
                value = np.ones(len(x))
                value[met] = _distance(b, a, length, size, x[met], at[y[met]])
                order = np.lexsort((place[y], value, x))
                x, y, value = x[order], y[order], value[order]
                first = np.ones(len(x), dtype=bool)
                first[1:] = (x[1:] != x[:-1]) | ((value[1:] != value[:-1]) & ~(np.isnan(value[1:]) & np.isnan(value[:-1])))
                begins = np.flatnonzero(first)
                kept = np.arange(len(x)) - begins[np.cumsum(first) - 1] < limit if len(x) else first
                found.append((some[x[kept]], y[kept], value[kept]))
    x, y, value = (np.concatenate(part) for part in zip(*found))
    return pa.table({"query_id": query.take(pa.array(x)), "key": key.take(pa.array(y)), "distance": pa.array(value, from_pandas=False)})


def _matrix(column: pa.ChunkedArray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as columns of ``room`` rows, and their lengths; null: -1."""
    lists = column.combine_chunks()
    lengths = pc.list_value_length(lists).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), room))
    out[np.arange(room)[None, :] < lengths[:, None]] = lists.flatten().to_numpy()
    return np.ascontiguousarray(out.T), lengths


def _norm(v: np.ndarray) -> np.ndarray:
    total = np.zeros(v.shape[1])
    for x in v:
        total += x * x
    return np.sqrt(total)


def _distance(b: np.ndarray, a: np.ndarray, length: np.ndarray, size: np.ndarray, x=slice(None), y=slice(None)) -> np.ndarray:
    """One minus the cosine of columns x of b and y of a, summed as Spark sums."""
    both = length[x] * size[y] if np.ndim(length) else length * size[y]
    total = np.zeros(len(both))
    for p, r in zip(b, a):
        total += p[x] * r[y]
    return 1 - np.where((both > 0) | np.isnan(both), total / both, 0.0)


def fused(by_vector: DataFrame, by_text: DataFrame, key: str) -> DataFrame:
    """Reciprocal rank fusion of two rankings, scaled to 0..1 within a query
    (0.5 if all are equal): ``query_id, key, rrf, similarity``."""
    both = by_vector.select("query_id", key, F.col("rank").alias("v")).join(by_text.select("query_id", key, F.col("rank").alias("t")), ["query_id", key], "full")
    weight = F.when(F.col("v").isNull(), TEXT_ONLY).otherwise(1.0)
    rrf = F.coalesce(1 / (RRF_K + F.col("v")), F.lit(0.0)) + F.coalesce(weight / (RRF_K + F.col("t")), F.lit(0.0))
    w = Window.partitionBy("query_id")
    spread = F.max("rrf").over(w) - F.min("rrf").over(w)
    scaled = F.when(spread <= 1e-12, 0.5).otherwise((F.col("rrf") - F.min("rrf").over(w)) / spread)
    return both.withColumn("rrf", rrf).withColumn("similarity", scaled).select("query_id", key, F.round("rrf", 9).alias("rrf"), F.round("similarity", 6).alias("similarity"))


def boosted(fusion: DataFrame, memories: DataFrame) -> DataFrame:
    """Hybrid score, lower is better: one minus similarity, less boosts for
    citations, activation and level, plus a penalty for the short tier."""
    boost = (
        F.least(0.01 * F.col("usage_count"), F.lit(0.06)) + F.least(0.02 * F.col("activation"), F.lit(0.08))
        + F.when(F.col("level") != "raw", 0.03).otherwise(0.0) - F.when(F.col("tier") == "short", 0.02).otherwise(0.0)
    )
    return fusion.join(memories.select("memory_id", "usage_count", "activation", "level", "tier"), "memory_id").select(
        "query_id", "memory_id", F.round(1 - F.col("similarity") - boost, 6).alias("score")
    )


def diffused(seeds: DataFrame, edges: DataFrame, now, depth: int = 3, budget: int = 25) -> DataFrame:
    """Bounded diffusion from ``seeds (query_id, memory_id, similarity)``.

    A node sends 0.85 of its mass along its out-edges in proportion to weight
    times conductance times freshness, over all of them; the first visit in
    frontier order wins; visits, seeds included, stop at ``budget`` a query.
    Returns ``query_id, memory_id, mass, depth``; seeds have depth 0.
    """
    age = (F.unix_timestamp(F.lit(now)) - F.unix_timestamp(F.col("last_fired").cast("timestamp"))) / 86400
    fresh = F.when(F.col("last_fired").isNull(), 0.4).when(age <= 7, 1.0).when(age <= 30, 0.8).when(age <= 90, 0.6).otherwise(0.4)
    strength = F.col("weight") * F.col("conductance") * fresh
    out = edges.select("source_id", "target_id", strength.alias("eff"))
    out = settled(out.withColumn("whole", F.sum("eff").over(Window.partitionBy("source_id"))).where("eff > 0"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "memory_id")
    seen = seeds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= budget).select("query_id", "memory_id", F.col("similarity").alias("mass"), F.lit(0).alias("depth"), "place")
    frontier = seen = settled(seen)
    for level in range(1, depth + 1):
        reached = frontier.join(out, frontier["memory_id"] == out["source_id"]).select(
            "query_id", F.col("target_id").alias("memory_id"), (F.col("mass") * 0.85 * F.col("eff") / F.col("whole")).alias("mass"), "place", F.round("eff", 9).alias("eff")
        ).join(seen.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti")
        one = Window.partitionBy("query_id", "memory_id").orderBy("place", F.desc("eff"))
        line = Window.partitionBy("query_id").orderBy("place", F.desc("eff"), "memory_id")
        used = seen.groupBy("query_id").agg(F.max("place").alias("used"))
        frontier = settled(
            reached.withColumn("k", F.row_number().over(one)).where("k = 1").drop("k").join(used, "query_id")
            .withColumn("new", F.row_number().over(line) + F.col("used")).where(F.col("new") <= budget)
            .select("query_id", "memory_id", "mass", F.lit(level).alias("depth"), F.col("new").alias("place"))
        )
        seen = seen.unionByName(frontier)
    return seen.select("query_id", "memory_id", "mass", "depth")


def with_diffusion(seeds: DataFrame, edges: DataFrame, now, depth: int = 3, budget: int = 25) -> DataFrame:
    """Recall candidates ``(query_id, memory_id, similarity, graph)``: the seeds,
    with no graph score, and what diffusion reaches beyond them, with its mass."""
    seeds = settled(seeds.select("query_id", "memory_id", "similarity"))
    reached = diffused(seeds, edges, now, depth, budget).where("depth > 0").join(seeds.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_anti")
    return seeds.withColumn("graph", F.lit(0.0)).unionByName(reached.select("query_id", "memory_id", F.lit(0.0).alias("similarity"), F.col("mass").alias("graph")))


def recall_scores(candidates: DataFrame, memories: DataFrame, confidence: DataFrame, superseded: DataFrame) -> DataFrame:
    """The weighted recall score of candidates ``(query_id, memory_id,
    similarity, graph)``: .45 similarity, .15 activation, .15 graph,
    .10 confidence, less .05 if an update supersedes the record."""
    return (
        candidates.join(memories.select("memory_id", "activation", "level", "collection", "tags"), "memory_id")
        .join(confidence, "memory_id", "left").join(superseded, "memory_id", "left")
        .withColumn("score", F.round(
            0.45 * F.col("similarity") + 0.15 * F.least(F.col("activation") / 8, F.lit(1.0)) + 0.15 * F.col("graph")
            + 0.10 * F.coalesce("confidence", F.lit(0.0)) - F.when(F.col("newest").isNotNull(), 0.05).otherwise(0.0), 9))
    )


def current_versions(ranked: DataFrame, memories: DataFrame) -> DataFrame:
    """The temporal policy for current facts: a superseded row becomes its
    newest version with the penalty refunded, obsolete records go, the best
    score of each record stays."""
    moved = ranked.select("query_id", F.coalesce("newest", "memory_id").alias("memory_id"), F.round(F.col("score") + F.when(F.col("newest").isNotNull(), 0.05).otherwise(0.0), 9).alias("score"))
    live = moved.join(memories.select("memory_id", "tags"), "memory_id").where(~F.array_contains("tags", "state:obsolete"))
    return live.groupBy("query_id", "memory_id").agg(F.max("score").alias("score"))


def best_per_parent(hits: DataFrame, parent: str = "parent_id") -> DataFrame:
    """Of several hits on one parent, the nearest."""
    return top(hits, parent, [F.asc("distance"), F.asc("key_id")], 1).drop("rank")


def merged_topics(hits: DataFrame) -> DataFrame:
    """Hits of one question's sub-topics merged: least adjusted score a record
    (0.003 a rank and 0.001 a topic are added)."""
    adjusted = F.col("score") + 0.003 * F.col("rank") + 0.001 * F.col("topic")
    return hits.groupBy("query_id", "memory_id").agg(F.round(F.min(adjusted), 6).alias("score"))
