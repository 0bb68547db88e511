"""Words of scripts that put no blanks between them.

Runs of such a script are cut by the most probable path through a dictionary of
words and their counts; characters that no word covers fall back to bigrams, so
a text is found even where the dictionary knows nothing. The dictionary is data:
a table ``(word, uses)``, given or learned from the texts themselves.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scripts without blanks, as ranges of code points: fixed values.
RANGES = [(0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x0E00, 0x0E7F), (0x20000, 0x2FA1F)]
SCRIPT = "".join(f"{chr(a)}-{chr(b)}" for a, b in RANGES)
JAVA_SCRIPT = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in RANGES)
PIECES = re.compile(rf"[{SCRIPT}]+|[^\W_{SCRIPT}]+")
UNSPACED = re.compile(rf"[{SCRIPT}]")
#: A dictionary goes to every executor; this bounds its words.
LARGEST = 1_000_000
#: Texts whose tokens a task holds at once.
TEXTS = 200


class Words:
    """A dictionary as an automaton, with the log probability of each word."""

    def __init__(self, words: dict[str, int]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        total = math.log(max(1, sum(words.values())) + 1)
        for word, uses in words.items():
            if word:
                self.automaton.add_word(word, (len(word), math.log(max(uses, 1)) - total))
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()
        #: A character that no word covers is less probable than any word.
        self.unknown = -total - 10.0

    def path(self, run: str) -> list[str]:
        """The most probable words of a run; ties: the longer last word."""
        ending: list[list[tuple[int, float]]] = [[] for _ in range(len(run) + 1)]
        if self.any:
            for last, (size, weight) in self.automaton.iter(run):
                ending[last + 1].append((size, weight))
        best, back = [0.0] + [-math.inf] * len(run), [0] * (len(run) + 1)
        for at in range(1, len(run) + 1):
            best[at], back[at] = best[at - 1] + self.unknown, 1
            for size, weight in sorted(ending[at]):
                if best[at - size] + weight >= best[at]:
                    best[at], back[at] = best[at - size] + weight, size
        out, at = [], len(run)
        while at:
            out.append(run[at - back[at] : at])
            at -= back[at]
        return out[::-1]

    def tokens(self, run: str, search: bool) -> Iterator[str]:
        """Words of two characters and more; bigrams of what is left between
        them. For ``search`` also the shorter words inside long ones."""
        rest = ""
        for word in [*self.path(run), None]:
            if word is not None and len(word) == 1:
                rest += word
                continue
            yield from (rest[k : k + 2] for k in range(len(rest) - 1))
            rest = ""
            if word is None:
                return
            if search:
                for size in (2, 3):
                    if len(word) > size:
                        yield from (p for p in (word[k : k + size] for k in range(len(word) - size + 1)) if self.any and p in self.automaton)
            yield word


def tokens_of(text: str | None, words: Words, search: bool = False, least: int = 2) -> list[str]:
    """Lower-cased tokens in order: runs of letters and digits of at least
    ``least`` characters, and the words of runs without blanks."""
    out = []
    for piece in PIECES.findall((text or "").lower()):
        if UNSPACED.match(piece):
            out += words.tokens(piece, search)
        elif len(piece) >= least:
            out.append(piece)
    return out


def segmenter(dictionary: DataFrame | None = None, search: bool = False):
    """A function from a text column to its tokens. ``dictionary``: ``(word,
    uses)`` of at most ``LARGEST`` rows, or none."""
    known: dict[str, int] = {}
    if dictionary is not None:
        rows = dictionary.where("word IS NOT NULL").groupBy("word").agg(F.max("uses").alias("uses")).limit(LARGEST + 1).collect()
        if len(rows) > LARGEST:
            raise ValueError(f"the dictionary has more than {LARGEST} words")
        known = {r["word"].lower(): r["uses"] for r in rows}

    @F.pandas_udf("array<string>")
    def segmented(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = Words(known)
        for series in texts:
            # Tokens take many times the room of their text, so few are held at once.
            for begin in range(0, len(series), TEXTS):
                yield series[begin : begin + TEXTS].map(lambda t: tokens_of(t, words, search))

    return segmented


def runs(text: Column) -> Column:
    """The runs without blanks in a text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"[{JAVA_SCRIPT}]+"), F.lit(0))


def learned(docs: DataFrame, text: str = "text", longest: int = 4, least: int = 5, cohesion: float = 8.0) -> DataFrame:
    """``word, uses``: strings of two to ``longest`` characters that occur
    ``least`` times, and whose parts meet ``cohesion`` times as often as chance
    would have it, however they are cut. Counts cover all texts."""
    run = docs.select(F.explode(runs(F.col(text))).alias("run"))
    at = lambda n: F.transform(F.sequence(F.lit(1), F.length("run") - n + 1), lambda i: F.substring(F.col("run"), i, F.lit(n)))
    grams = F.concat(*[F.when(F.length("run") >= n, at(n)).otherwise(F.array().cast("array<string>")) for n in range(1, longest + 1)])
    counted = run.select(F.explode(grams).alias("word")).groupBy("word").agg(F.count("*").alias("uses")).where((F.col("uses") >= least) | (F.length("word") == 1))
    total = counted.where("length(word) = 1").agg(F.sum("uses").alias("total"))
    cuts = counted.where("length(word) > 1").withColumn("cut", F.explode(F.sequence(F.lit(1), F.length("word") - 1)))
    halves = cuts.select("word", "uses", F.substring(F.col("word"), F.lit(1), F.col("cut")).alias("left"), F.substring(F.col("word"), F.col("cut") + 1, F.length("word")).alias("right"))
    one, two = counted.toDF("left", "ul"), counted.toDF("right", "ur")
    met = halves.join(one, "left").join(two, "right").crossJoin(F.broadcast(total)).withColumn("lift", F.col("uses") * F.col("total") / (F.col("ul") * F.col("ur")))
    return met.groupBy("word").agg(F.max("uses").alias("uses"), F.min("lift").alias("lift")).where(F.col("lift") >= cohesion).select("word", "uses")
