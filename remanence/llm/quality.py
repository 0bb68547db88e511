"""Quality rules by distribution divergence (operator 3).

Every language has two references, learned from all its documents: a histogram
of character classes and one of its most common words. A document is compared
with the references by Jensen-Shannon distance (base 2, so 0 to 1); it fails if
even its nearest reference is too far, for words also if it is hardly nearer
than a text without any common word would be. Short documents have noisy histograms,
so each test has a least length below which it abstains.

Defined results: a null or empty text has no words and fails the base rule; with
no usable reference (empty table, no language with enough words) the method
abstains and the base rule decides. Null ``lang`` rows teach nothing but are
judged. Repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, removed, written

SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "other letter", "digit", "space", "line end", "sentence mark", "other")


@dataclass(frozen=True)
class Limits:
    """Thresholds of the verdict; distances are square roots of divergences."""

    common_words: int = 50
    class_distance: float = 0.30
    class_chars: int = 200
    word_distance: float = 0.45
    #: Share of the distance that a text without common words has from a reference.
    word_ceiling: float = 0.90
    word_words: int = 100
    #: Words below which a language is no reference.
    reference_words: int = 2000
    least_words: int = 50
    most_repeated: int = 50


def _class_table() -> np.ndarray:
    """Class of each code point below 0x30000; everything above is 'other'."""
    table = np.full(0x30001, 7, dtype=np.uint8)
    for point in range(0x30000):
        kind = unicodedata.category(chr(point))
        if kind == "Ll":
            table[point] = 0
        elif kind in ("Lu", "Lt"):
            table[point] = 1
        elif kind[0] in "LM":
            table[point] = 2
        elif kind == "Nd":
            table[point] = 3
        elif kind == "Zs" or point == 9:
            table[point] = 4
    table[[10, 13]] = 5
    table[[ord(c) for c in ".,;:!?"]] = 6
    return table


_TABLE: list[np.ndarray] = []


def class_histogram(text: str) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_class_table())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.bincount(_TABLE[0][np.minimum(points, 0x30000)], minlength=len(CLASSES))


def distances(histogram: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of one histogram to each reference row."""
    p = histogram / max(1, histogram.sum())
    middle = (p + references) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / middle), 0).sum(axis=1)
        right = np.where(references > 0, references * np.log2(references / middle), 0).sum(axis=1)
    return np.sqrt(np.maximum(0, (left + right) / 2))


@dataclass(frozen=True)
class References:
    languages: tuple[str, ...]
    classes: np.ndarray
    words: tuple[dict[str, int], ...]
    shares: tuple[np.ndarray, ...]
    #: Distance of a text without common words.
    ceilings: tuple[float, ...]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class and word counts of one partition, by language."""
    classes: dict[str, np.ndarray] = {}
    words: dict[str, Counter] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            classes[lang] = classes.get(lang, 0) + class_histogram(text)
            words.setdefault(lang, Counter()).update(text.lower().encode().split())
            if sum(map(len, words.values())) > 400_000:
                yield from _rows(classes, words)
                classes, words = {}, {}
    yield from _rows(classes, words)


def _rows(classes: dict, words: dict) -> Iterator[pa.RecordBatch]:
    for lang, counter in words.items():
        kinds = [f"{i}" for i in range(len(CLASSES))] + [None] * len(counter)
        keys = [None] * len(CLASSES) + [w.decode() for w in counter]
        counts = [int(n) for n in classes[lang]] + list(counter.values())
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(kinds, pa.string()), pa.array(keys, pa.string()), pa.array(counts, pa.int64())], names=["lang", "kind", "word", "n"])


def learn(docs: DataFrame, limits: Limits = Limits()) -> References:
    """References of all languages; the driver gets ``common_words`` + 9 rows a
    language."""
    counted = (
        docs.select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
        .mapInArrow(_count, "lang string, kind string, word string, n long")
        .groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))
    )
    counted = written(counted, "word-counts")
    words_of = counted.where("kind IS NULL")
    totals = {r["lang"]: r["n"] for r in words_of.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    # A rank alone under its limit: every task keeps its own best before the shuffle.
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    common_rows = words_of.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= limits.common_words).collect()
    class_rows = counted.where("kind IS NOT NULL").collect()
    removed(docs.sparkSession, counted)
    kept = sorted(lang for lang, n in totals.items() if n >= limits.reference_words)
    classes, words, shares = [], [], []
    for lang in kept:
        histogram = np.zeros(len(CLASSES))
        for r in class_rows:
            if r["lang"] == lang:
                histogram[int(r["kind"])] = r["n"]
        common = sorted((r for r in common_rows if r["lang"] == lang), key=lambda r: r["rank"])
        seen = np.array([r["n"] for r in common], dtype=float)
        classes.append(histogram / histogram.sum())
        words.append({r["word"]: i for i, r in enumerate(common)})
        shares.append(np.append(seen, totals[lang] - seen.sum()) / totals[lang])
    ceilings = tuple(float(distances(np.eye(len(s))[-1], s[None, :])[0]) for s in shares)
    return References(tuple(kept), np.array(classes).reshape(-1, len(CLASSES)), tuple(words), tuple(shares), ceilings)


def repeated_words(words: list) -> int:
    """Positions inside a three-word window that the text has more than once."""
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    upto, covered = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def measure(text: str | None, references: References, limits: Limits) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    repeated = repeated_words(words)
    failed = n < limits.least_words or 100 * repeated > limits.most_repeated * n
    class_far = word_far = None
    word_near = True
    if references.languages and n:
        if len(text) >= limits.class_chars:
            class_far = float(distances(class_histogram(text), references.classes).min())
        if n >= limits.word_words:
            seen = Counter(text.lower().encode("utf-8", "surrogatepass").split())
            word_far, word_near = 1.0, False
            for common, share, ceiling in zip(references.words, references.shares, references.ceilings):
                own = np.zeros(len(share))
                for w, i in common.items():
                    own[i] = seen.get(w.encode(), 0)
                own[-1] = n - own.sum()
                far = float(distances(own, share[None, :])[0])
                word_far = min(word_far, far)
                word_near |= far <= min(limits.word_distance, limits.word_ceiling * ceiling)
    kept = not failed and (class_far or 0) <= limits.class_distance and word_near
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, failed, kept, class_far, word_far


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Base measures and verdict of every row, with both distances (null where
    a test abstains)."""
    references = learn(docs, limits)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t, references, limits) for t in batch.column(1).to_pylist()]
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, t) for c, t in zip(columns, types)], names=names)

    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
    )
