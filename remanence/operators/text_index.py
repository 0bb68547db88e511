"""A kept inverted index: postings in segments, found by term, changed by commits.

Every update writes one segment of postings ``(term, key, tf, born)``, in folders
by a hash of the term and sorted by term, and the table of live documents
``(key, length, born)``; a commit makes both visible at once. A posting counts
while its document is live in the version that wrote it, so changed and removed
documents need no rewriting of old segments until :meth:`TextIndex.merge`. A
search reads the folders, and there the row groups, of the terms it asks for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as texts
from ..sources.snapshots import Snapshot, Store
from . import search

#: Folders of a segment, and tasks that may write one folder: a frequent term is dealt out.
BUCKETS, SPREAD = 64, 8
#: Asked terms that are pushed into the scan by name; more are met by a join alone.
PUSHED = 1000


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class TextIndex:
    """The index in one folder. ``tokenize``: from a text column to its tokens."""

    def __init__(self, spark: SparkSession, root: str, key: str = "doc_id", tokenize: Callable[[Column], Column] = texts.tokens):
        self.store, self.key, self.tokenize = Store(spark, root), key, tokenize

    def update(self, docs: DataFrame, removed: DataFrame | None = None) -> Snapshot:
        """Takes new and changed ``docs (key, text)``, and forgets ``removed
        (key)``. A key occurs once in ``docs``; null keys are left out."""
        base = self.store.snapshot()
        born = F.lit(base.version + 1).cast("long").alias("born")
        words = docs.where(F.col(self.key).isNotNull()).select(self.key, self.tokenize(F.col("text")).alias("words"))
        live = words.select(self.key, F.size("words").cast("long").alias("length"), born)
        if "docs" in base.tables:
            gone = live.select(self.key) if removed is None else live.select(self.key).union(removed.select(self.key))
            live = self.store.read("docs", base.version).join(gone, self.key, "left_anti").unionByName(live)
        postings = words.select(self.key, F.explode("words").alias("term")).groupBy("term", self.key).agg(F.count("*").alias("tf")).select("term", self.key, "tf", born)
        return self._commit({"docs": live}, postings, base, ())

    def merge(self) -> Snapshot:
        """All segments as one, without what is no longer live."""
        base = self.store.snapshot()
        return self._commit({}, self._live(self._postings(base), base).select("term", self.key, "tf", "born"), base, self._segments(base))

    def _commit(self, changed: dict, postings: DataFrame, base: Snapshot, dropped: tuple[str, ...]) -> Snapshot:
        name = f"postings/{base.version + 1}"
        dealt = postings.withColumn("bucket", bucket(F.col("term"))).repartition("bucket", F.pmod(F.xxhash64(self.key), F.lit(SPREAD))).sortWithinPartitions("bucket", "term")
        return self.store.commit(changed | {name: dealt}, dropped, base, by={name: ["bucket"]})

    def _segments(self, base: Snapshot) -> tuple[str, ...]:
        return tuple(sorted(name for name in base.tables if name.startswith("postings/")))

    def _postings(self, base: Snapshot) -> DataFrame:
        first, *rest = (self.store.read(name, base.version) for name in self._segments(base))
        for segment in rest:
            first = first.unionByName(segment)
        return first

    def _live(self, postings: DataFrame, base: Snapshot) -> DataFrame:
        return postings.join(self.store.read("docs", base.version), [self.key, "born"])

    def asked_postings(self, asked: DataFrame, base: Snapshot) -> DataFrame:
        """Postings of the terms in ``asked (term)``; no other folder is read."""
        terms = asked.select("term").distinct()
        few = [r["term"] for r in terms.limit(PUSHED + 1).collect()]
        folders = [r["b"] for r in terms.select(bucket(F.col("term")).alias("b")).distinct().collect()]
        found = self._postings(base).where(F.col("bucket").isin(folders))
        return found.where(F.col("term").isin(few)) if len(few) <= PUSHED else found.join(terms, "term", "left_semi")

    def search(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        """``query_id, key, rank, score`` as :func:`search.bm25` over the live
        documents ranks them."""
        base = self.store.snapshot()
        asked = queries.select("query_id", F.explode(F.array_distinct(self.tokenize(F.col("text")))).alias("term"))
        held = self._live(self.asked_postings(asked, base), base).select(self.key, "length", "term", "tf")
        corpus = self.store.read("docs", base.version).agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
        return search.scored(asked, search.packed(held, self.key), corpus, self.key, limit)
