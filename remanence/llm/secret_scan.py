"""Secret scanning by a battery of randomness tests (operator 8), DataFrame
functions only.

Base kinds are patterns: key assignments, access keys, long hexadecimal runs.
The method adds kind ``random``: runs of encoding characters that look drawn at
random. For each run the encoding is inferred (decimal, hexadecimal, base32,
letters and digits, base64) and gives the alphabet for three tests: chi-squared
uniformity, runs above and below the alphabet's middle, and lag-one serial
correlation. Each statistic is read in two ways:

- as a test of randomness: none of the three may reject a uniform random run;
- as evidence against text: a p-value under what words do. Words and joined words,
  whatever their case and marks, draw their letters with the frequencies of a
  language; the log likelihood ratio of a run's letters, which is the chi-squared
  test turned round, is normal with known mean and variance if it is text. A run
  with too few letters is read by how often its symbols coincide, which they do
  more often in numbers and codes that people write.

Where an encoding has several classes of symbols (cases, digits, marks), the runs
of one class are counted as well, a capital going with the small letters after
it: words and joined words have few, random symbols many. The two p-values are
combined by Fisher's method. Those of all runs of one length class are put to
Benjamini-Hochberg at rate ``q``: short runs, of which there are many, need
stronger evidence than long ones. The rate holds for names made of words of a
language; of names made of rare letters alone (``JvmZipProxyFuzzy``) more pass.

The false-discovery step sees counts by length class and p-value bin only, so
its state is a few hundred rows at any corpus size.

Defined results: a null text is empty and has no spans; repeated rows are
scanned alike; an empty table gives no rows. Spans are in code points, end
exclusive; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

_SPAN = "array<struct<start:int,end:int,text:string>>"


@dataclass(frozen=True)
class Battery:
    least: int = 20
    #: Rate of false discoveries within a length class.
    q: float = 0.01
    #: Each randomness test passes while |z| is at most this.
    z: float = 3.5
    #: Fewer letters than these are read by coincidence.
    letters: int = 12
    #: Share of symbol pairs that coincide in codes that people write: at least
    #: this, and this many times the share of uniform symbols.
    codes: float = 0.065
    codes_times: float = 1.73
    #: Share of a text's letters that is like no language: names, abbreviations.
    foreign: float = 0.12
    #: Runs of one class of symbols that names and text have at most, a symbol.
    pieces: float = 0.3
    bins: int = 400
    step: float = 0.1


#: Percent of a text's letters that are a, b, c and so on to z: fixed values.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)


def letter_weights(foreign: float) -> tuple[list[float], float, float]:
    """Log ratio of every letter's frequency in text to a uniform one; mean and
    variance of the ratio of one letter of text."""
    share = [(1 - foreign) * x / sum(LETTERS) + foreign / 26 for x in LETTERS]
    weights = [math.log(26 * p) for p in share]
    mean = sum(p * w for p, w in zip(share, weights))
    return weights, mean, sum(p * w * w for p, w in zip(share, weights)) - mean * mean


#: Matches whose places are summed one after another.
STRETCH = 256


def _spans(text: Column, pattern: str) -> Column:
    """Matches with their places: the text between matches, from split(), and
    the matches alternate, so running lengths give every start. They are summed
    in stretches, so a text of very many matches costs little more than each."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    paired = F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).alias("skip"), F.length(m).alias("size"), m.alias("text")))
    width = lambda x: x["skip"] + x["size"]

    def placed(stretch: Column, begin: Column) -> Column:
        empty = F.struct(begin.alias("at"), F.array().cast(_SPAN).alias("found"))
        return F.aggregate(
            stretch, empty,
            lambda s, x: F.struct(
                (s["at"] + width(x)).alias("at"),
                F.concat(s["found"], F.array(F.struct((s["at"] + x["skip"]).alias("start"), (s["at"] + width(x)).alias("end"), x["text"].alias("text")))).alias("found"),
            ),
            lambda s: s["found"],
        )

    def whole(all_: Column) -> Column:
        last = F.floor((F.size(all_) - 1) / STRETCH).cast("int")
        stretches = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(all_, k * STRETCH + 1, F.lit(STRETCH)))
        begins = F.aggregate(
            F.transform(stretches, lambda x: F.aggregate(x, F.lit(0), lambda s, y: s + width(y))), F.array(F.lit(0)),
            lambda s, n: F.concat(s, F.array(F.element_at(s, -1) + n)),
        )
        return F.flatten(F.transform(F.sequence(F.lit(0), last), lambda k: placed(F.slice(all_, k * STRETCH + 1, F.lit(STRETCH)), F.get(begins, k))))

    found = F.when(F.size(paired) > STRETCH, F.transform(F.array(paired), whole)[0]).otherwise(placed(paired, F.lit(0)))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def _alphabet(run: Column) -> tuple[Column, Column]:
    """Symbols of the inferred encoding, in order, and their number."""
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = (
        F.when(run.rlike(r"^[0-9]+$"), digits)
        .when(run.rlike(r"^[0-9a-f]+$"), digits + "abcdef")
        .when(run.rlike(r"^[0-9A-F]+$"), digits + "ABCDEF")
        .when(run.rlike(r"^[a-z]+$"), lower)
        .when(run.rlike(r"^[A-Z]+$"), upper)
        .when(run.rlike(r"^[A-Z2-7]+$"), upper + "234567")
        .when(run.rlike(r"^[A-Za-z]+$"), upper + lower)
        .when(run.rlike(r"^[A-Z0-9]+$"), digits + upper)
        .when(run.rlike(r"^[a-z0-9]+$"), digits + lower)
        .when(run.rlike(r"^[A-Za-z0-9]+$"), digits + upper + lower)
        .otherwise(upper + lower + digits + "+/-_")
    )
    return found, F.length(found)


def _log_lower_tail(z: Column) -> Column:
    """Logarithm of the normal distribution at z <= 0, by the Mills-ratio bound
    2 / (x + sqrt(x^2 + 8/pi)); at z > 0 it is log(1/2), which is no evidence."""
    x = F.greatest(-z, F.lit(0.0))
    ratio = F.lit(2.0) / (x + F.sqrt(x * x + 8 / 3.141592653589793))
    return -(x * x) / 2 + F.log(ratio) - 0.9189385332046727


def _log_fisher(one: Column, two: Column) -> Column:
    """Logarithm of Fisher's combined p-value of two: twice the sum of their
    negative logarithms is chi-squared with four degrees of freedom, whose upper
    tail is exp(-h) (1 + h), h being the sum."""
    h = -(one + two)
    return -h + F.log(1 + h)


ONE_CLASS = r"^([0-9]+|[a-z]+|[A-Z]+|[0-9a-f]+|[0-9A-F]+|[A-Z2-7]+)$"
PIECE = r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[+/_-]"


def _tested(span: Column, b: Battery) -> Column:
    """The span with its verdict of randomness, length class and p-value bin."""
    run = F.rtrim(span["text"], F.lit("="))
    symbols, k = _alphabet(run)
    n = F.length(run).cast("double")
    used = F.array_distinct(F.split(run, ""))
    square = F.aggregate(
        F.filter(used, lambda c: c != ""), F.lit(0.0),
        lambda s, c: s + F.pow((F.length(run) - F.length(F.replace(run, c))).cast("double"), F.lit(2.0)),
    )
    values = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: (F.instr(symbols, c) - 1).cast("double"))
    # Position of every letter in the alphabet, whatever its case; 0 for other symbols.
    letters = F.filter(F.transform(F.filter(F.split(F.lower(run), ""), lambda c: c != ""), lambda c: F.instr(F.lit("abcdefghijklmnopqrstuvwxyz"), c)), lambda i: i > 0)
    # Hexadecimal letters are digits, not words.
    letters = F.when(run.rlike(r"^([0-9a-f]+|[0-9A-F]+)$"), F.array().cast("array<int>")).otherwise(letters)
    pieces = F.when(~run.rlike(ONE_CLASS), F.regexp_count(run, F.lit(PIECE)).cast("double"))
    return F.transform(F.array(F.struct(span["start"].alias("start"), span["end"].alias("end"), n.alias("n"), k.alias("k"), square.alias("sq"), values.alias("v"), letters.alias("letters"), pieces.alias("pieces"))), lambda x: _verdict(x, b))[0]


def _verdict(x: Column, b: Battery) -> Column:
    n, k, v = x["n"], x["k"].cast("double"), x["v"]
    m = F.size(v)
    nexts = F.slice(v, F.lit(2), F.greatest(m - 1, F.lit(0)))
    firsts = F.slice(v, F.lit(1), F.greatest(m - 1, F.lit(0)))
    chi = (k / n * x["sq"] - n - (k - 1)) / F.sqrt(2 * (k - 1))
    high = F.aggregate(v, F.lit(0.0), lambda s, y: s + (y >= k / 2).cast("double"))
    runs = 1 + F.aggregate(F.zip_with(firsts, nexts, lambda y, z: ((y >= k / 2) != (z >= k / 2)).cast("double")), F.lit(0.0), lambda s, y: s + y)
    expected = 1 + 2 * high * (n - high) / n
    spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / F.greatest(n - 1, F.lit(1.0)), F.lit(1e-9)))
    mean = F.aggregate(v, F.lit(0.0), lambda s, y: s + y) / n
    variance = F.aggregate(v, F.lit(0.0), lambda s, y: s + (y - mean) * (y - mean))
    lagged = F.aggregate(F.zip_with(firsts, nexts, lambda y, z: (y - mean) * (z - mean)), F.lit(0.0), lambda s, y: s + y)
    serial = F.when(variance > 0, lagged / variance * F.sqrt(n)).otherwise(F.lit(1e9))
    pairs = n * (n - 1) / 2
    same = (x["sq"] - n) / 2
    share = F.greatest(F.lit(b.codes), b.codes_times / k)
    crowded = (same - pairs * share) / F.sqrt(F.greatest(pairs * share * (1 - share), F.lit(1e-9)))
    weights, text_mean, text_variance = letter_weights(b.foreign)
    table = F.array(*[F.lit(w) for w in weights])
    many = F.size(x["letters"]).cast("double")
    ratio = F.aggregate(x["letters"], F.lit(0.0), lambda s, i: s + F.get(table, i - 1))
    unlike = (ratio - many * text_mean) / F.sqrt(F.greatest(many * text_variance, F.lit(1e-9)))
    evidence = _log_lower_tail(F.when(many >= b.letters, unlike).otherwise(crowded))
    broken = _log_lower_tail((b.pieces * n - x["pieces"]) / F.sqrt(b.pieces * (1 - b.pieces) * n))
    evidence = F.when(x["pieces"].isNotNull(), _log_fisher(evidence, broken)).otherwise(evidence) / 2.302585092994046
    passes = (F.abs(chi) <= b.z) & (F.abs((runs - expected) / spread) <= b.z) & (F.abs(serial) <= b.z) & (n >= b.least)
    return F.struct(
        x["start"].alias("start"), x["end"].alias("end"), passes.alias("passes"),
        F.floor(F.log2(F.greatest(n, F.lit(1.0)))).cast("int").alias("size_class"),
        F.greatest(F.lit(0), F.least(F.floor(-evidence / b.step), F.lit(b.bins))).cast("int").alias("bin"),
    )


def found(docs: DataFrame, text: str = "text", b: Battery = Battery()) -> DataFrame:
    """``docs`` with ``__base`` (all base spans, each with its kind) and
    ``__runs`` (candidate runs with their tests)."""
    body = F.coalesce(F.col(text), F.lit(""))
    kind = lambda n, spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end")))
    assign = F.filter(_spans(body, ASSIGN), lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 1)) >= 6)
    access = F.filter(_spans(body, ACCESS), lambda s: F.length(s["text"]) >= 20)
    runs = _spans(body, rf"[A-Za-z0-9+/_-]{{{b.least},}}={{0,2}}")
    return docs.withColumns({
        "__base": F.concat(kind(0, assign), kind(1, access), kind(2, _spans(body, HEX))),
        "__runs": F.transform(runs, lambda s: _tested(s, b)),
    })


def discovery_limits(scanned: DataFrame, b: Battery = Battery()) -> dict[int, int]:
    """By length class, the least p-value bin that Benjamini-Hochberg rejects."""
    counts = scanned.select(F.explode("__runs").alias("r")).groupBy("r.size_class", "r.bin").count()
    down = Window.partitionBy("size_class").orderBy(F.desc("bin"))
    whole = Window.partitionBy("size_class")
    rows = (
        counts.withColumn("upto", F.sum("count").over(down)).withColumn("tests", F.sum("count").over(whole))
        .where(F.pow(F.lit(10.0), -F.col("bin") * b.step) * F.col("tests") <= b.q * F.col("upto"))
        .groupBy("size_class").agg(F.min("bin").alias("bin")).collect()
    )
    return {r["size_class"]: r["bin"] for r in rows}


def random_spans(limits: dict[int, int]) -> Column:
    """The runs of ``__runs`` that are secrets under ``limits``."""
    if not limits:
        hit = lambda r: F.lit(False)
    else:
        least = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair])
        hit = lambda r: r["passes"] & F.coalesce(r["bin"] >= F.try_element_at(least, r["size_class"]), F.lit(False))
    return F.transform(F.filter("__runs", hit), lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def scan(docs: DataFrame, b: Battery = Battery()) -> DataFrame:
    """Counts of base spans, their digest and all spans of every row."""
    scanned = written(found(docs.select("doc_id", "text"), "text", b).drop("text"), "secrets")
    limits = discovery_limits(scanned, b)
    count = lambda n: F.size(F.filter("__base", lambda s: s["kind"] == n)).cast("long")
    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("__base")), 256).alias("base_sha256"),
        _joined(F.concat("__base", random_spans(limits))).alias("spans"),
    )


def redacted(docs: DataFrame, mark: str = "[SECRET]", b: Battery = Battery()) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; overlapping
    spans give one mark. ``n_chars``, if there is one, follows the text."""
    # The columns go along as one, so that none of them clashes with the scan's own.
    packed = docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("__row"), "text")
    scanned = written(found(packed, "text", b), "secrets")
    limits = discovery_limits(scanned, b)
    spans = F.array_sort(F.concat("__base", random_spans(limits)))
    # Pieces between spans, joined once: the text is copied once, not at every span.
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    clean = F.aggregate(
        spans, start,
        lambda s, x: F.when(x["start"] >= s["at"], F.struct(
            x["end"].alias("at"), F.array_append(s["out"], F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"])).alias("out"),
        )).otherwise(F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out"))),
        lambda s: F.array_join(F.array_append(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))), mark),
    )
    clean_docs = scanned.withColumn("text", F.when(F.size(spans) > 0, clean).otherwise(F.col("text")))
    follows = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        follows["n_chars"] = F.when(F.col("text").isNull(), F.col("__row")["n_chars"]).otherwise(F.length("text").cast("long"))
    return clean_docs.select(*[(follows[c] if c in follows else F.col("__row")[c]).alias(c) for c in docs.columns])
