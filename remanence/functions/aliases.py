"""Names and private words in questions, by one automaton over all of them.

A dictionary is a table ``(canonical, kind, alias)``. Aliases of two characters
and more are found anywhere in a text, white space and case aside, so names of
several words and of scripts without blanks are found too; aliases of one
character only where they stand by themselves. Of overlapping finds the longest
counts, and the first of those: ``Anna Maria`` is not also ``Anna``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A dictionary goes to every executor; this bounds its aliases.
LARGEST = 1_000_000
FOUND = "array<struct<canonical:string,kind:string,alias:string>>"


def compact(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", ""))


class Aliases:
    """Aliases as an automaton; a name that several records share is each one's."""

    def __init__(self, rows: list[tuple[str, str, str]]):
        import ahocorasick

        self.automaton, self.single = ahocorasick.Automaton(), {}
        for canonical, kind, alias in rows:
            key = re.sub(r"\s+", "", alias).lower()
            if len(key) >= 2:
                found = self.automaton.get(key, None)
                if found is None:
                    self.automaton.add_word(key, found := (len(key), []))
                found[1].append((canonical, kind, alias))
            elif key:
                self.single.setdefault(key, []).append((canonical, kind, alias))
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[str, str, str]]:
        body = re.sub(r"\s+", "", text).lower()
        found = [(last - size + 1, last + 1, records) for last, (size, records) in self.automaton.iter(body)] if self.any else []
        taken: list[tuple[int, int]] = []
        chosen = []
        for begin, end, records in sorted(found, key=lambda f: (f[0] - f[1], f[0])):
            if all(end <= b or e <= begin for b, e in taken):
                taken.append((begin, end))
                chosen.append((begin, records))
        for _, records in sorted(chosen, key=lambda c: c[0]):
            yield from records
        if self.single:
            for word in re.findall(r"\w+", text.lower()):
                yield from self.single.get(word, ())


def matcher(dictionary: DataFrame):
    """A function from a text column to the records of ``dictionary (canonical,
    kind, alias)`` that the text names, each once, in the order of their first
    mention. Null and blank aliases are left out."""
    rows = dictionary.where("trim(alias) <> '' AND canonical IS NOT NULL").select("canonical", F.coalesce("kind", F.lit("")).alias("kind"), "alias").distinct()
    rows = [tuple(r) for r in rows.limit(LARGEST + 1).collect()]
    if len(rows) > LARGEST:
        raise ValueError(f"the dictionary has more than {LARGEST} aliases")
    rows.sort()

    @F.pandas_udf(FOUND)
    def named(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Aliases(rows)

        def one(text) -> list[dict]:
            seen: dict = {}
            for canonical, kind, alias in known.matches(text or ""):
                seen.setdefault((canonical, kind), alias)
            return [{"canonical": c, "kind": k, "alias": a} for (c, k), a in seen.items()]

        for series in texts:
            yield series.map(one)

    return named
