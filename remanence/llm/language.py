"""Language identification by compression (operator 10).

Each language gets a zstandard raw-content dictionary: a bounded sample of its
training texts. A text is compressed against every dictionary, in pieces so that
a long text cannot become its own dictionary, and the language that leaves the
fewest bytes wins. Where the runner-up is nearly as small the text is rejected:
its language is still named, but ``rejected`` is true.

Learning takes a bounded sample of labelled rows: ``Learner.documents`` whole
texts a language, drawn by hash from those of at most ``Learner.usual``
characters, and from longer ones only where a language has too few of these.
Prediction reads whole texts. The driver holds a row and a sample per language;
languages are labels, and each worker must hold a dictionary of each.

Defined results: a null text, or one without a letter, is ``und`` with score 0
and is rejected; so is every text if no language was learned. Equal sizes go to
the smaller language name. A null doc_id counts as '' in the fold. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold


@dataclass(frozen=True)
class Learner:
    """Bounds of the training sample and of compression."""

    documents: int = 128
    #: Characters up to which texts are drawn first; no text is cut.
    usual: int = 2000
    piece: int = 4096
    level: int = 6
    #: Least share of the runner-up's bytes that the winner must save.
    margin: float = 0.005
    folds: int = 5


def learn(docs: DataFrame, options: Learner = Learner()) -> dict[str, bytes]:
    """Dictionaries by language from the training folds of ``docs``.

    The sample is the texts of smallest hash within each language. Counts by
    language come first, so that only about four times the sample is ever
    shuffled, however large a language is.
    """
    train = docs.select("doc_id", "text", "lang").where(
        (fold(F.col("doc_id"), options.folds) != 0) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    ).withColumn("long", F.length("text") > options.usual)
    draw = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 30))
    counts = train.groupBy("lang", "long").count().collect()
    usual = {r["lang"]: r["count"] for r in counts if not r["long"]}
    shares = [(r["lang"], r["long"], 4.0 * options.documents / r["count"]) for r in counts if not r["long"] or usual.get(r["lang"], 0) < options.documents]
    wanted = docs.sparkSession.createDataFrame(shares, "lang string, long boolean, share double")
    few = train.withColumn("draw", draw).join(F.broadcast(wanted), ["lang", "long"]).where(F.col("draw") <= F.lit(float(1 << 30)) * F.col("share"))
    first = Window.partitionBy("lang").orderBy("long", "draw", "text")
    rows = few.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= options.documents).select("lang", "rank", "text").collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return {k: "\n".join(v).lower().encode() for k, v in samples.items()}


class Classifier:
    """Compressors of one process, built on first use."""

    def __init__(self, dictionaries: dict[str, bytes], options: Learner):
        self.names, self.piece, self.margin = sorted(dictionaries), options.piece, options.margin
        self.press = []
        for name in self.names:
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=options.level)
            self.press.append(zstandard.ZstdCompressor(level=options.level, dict_data=content, write_checksum=False, write_content_size=False, write_dict_id=False))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.names or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        data = text.lower().encode("utf-8", "replace")
        pieces = [data[i : i + self.piece] for i in range(0, len(data), self.piece)]
        sizes = sorted((sum(len(p.compress(x)) for x in pieces), k) for k, p in enumerate(self.press))
        if len(sizes) == 1:
            return self.names[0], 1.0, False
        (least, k), (next_, _) = sizes[:2]
        saved = (next_ - least) / next_
        return self.names[k], min(1.0, saved), saved < self.margin


def judge(dictionaries: dict[str, bytes], options: Learner = Learner()):
    """A vectorised function text -> struct(lang_pred, score, rejected).

    The dictionaries travel with the function: at most one sample a language.
    """

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classify = Classifier(dictionaries, options)
        for texts in batches:
            yield pd.DataFrame([classify(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return predict


def identify(docs: DataFrame, options: Learner = Learner()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every row."""
    predict = judge(learn(docs, options), options)
    return docs.select("doc_id", (fold(F.col("doc_id"), options.folds) == 0).alias("held_out"), predict(F.col("text")).alias("said")).select(
        "doc_id", "held_out", "said.lang_pred", "said.score", "said.rejected"
    )


def accepted(docs: DataFrame, options: Learner = Learner()) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is not rejected."""
    predict = judge(learn(docs, options), options)
    kept: Column = ~predict(F.col("text"))["rejected"]
    return docs.where(kept)
