"""Text expressions: tokens, terms, clipping, masking, spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS, BETWEEN = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"
STOP_WORDS = ("the", "and", "of", "to", "in", "is", "that", "it", "was", "for")


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-cased runs of letters and digits of at least ``least`` characters."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda t: F.length(t) >= max(least, 1))


def query_terms(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def any_term_expression(text: Column, most: int = 24) -> Column:
    """Quoted terms joined by OR."""
    return F.array_join(F.transform(F.slice(salient_terms(text), 1, most), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def salient_terms(text: Column, most: int = 12) -> Column:
    """Distinct words that are no stop words, digits or parts of a longer kept
    word, longest first, at most ``most``."""
    words = F.filter(query_terms(text), lambda t: ~t.isin(*STOP_WORDS) & ~t.rlike(r"^\p{N}+$") & (F.length(t) >= 3))
    whole = F.filter(words, lambda t: ~F.exists(words, lambda u: (u != t) & F.contains(u, t)))
    ordered = F.transform(F.array_sort(F.transform(whole, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda s: s["t"])
    return F.slice(ordered, 1, most)


def bigrams(text: Column) -> Column:
    """The distinct pairs of neighbouring characters. The text is cut into
    characters once, so the work grows with its length."""
    n, chars = F.length(text), F.split(text, "")
    rest = F.greatest(n - 1, F.lit(0))
    pairs = F.zip_with(F.slice(chars, F.lit(1), rest), F.slice(chars, F.lit(2), rest), lambda x, y: F.concat(x, y))
    return F.when(n >= 2, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clipped(text: Column, most: int = 240, mark: str = "…") -> Column:
    """White space collapsed, cut to ``most`` characters with a mark."""
    flat = collapsed(text)
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most)), F.lit(mark))).otherwise(flat)


def cut(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def first_line(text: Column, most: int = 120) -> Column:
    line = redacted(collapsed(F.substring_index(F.ltrim(text), "\n", 1)))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 1), F.lit("…"))).otherwise(line)


def redacted(text: Column) -> Column:
    """Bearer tokens, sk- keys, long tokens and IPv4 addresses masked."""
    for pattern, mark in ((r"(?i)bearer\s+[a-z0-9._-]+", "[bearer]"), (r"\bsk-[A-Za-z0-9_-]{8,}", "[key]"), (r"\b[A-Za-z0-9_-]{36,}\b", "[token]"), (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "[ip]")):
        text = F.regexp_replace(text, pattern, mark)
    return text


def title(text: Column) -> Column:
    """The name in book brackets, else the start of the first line."""
    named = F.regexp_extract(text, "《([^》]{1,40})》", 1)
    return F.when(named != "", named).otherwise(F.substring(F.trim(F.substring_index(text, "\n", 1)), 1, 24))


def span(text: Column, quote: Column) -> Column:
    """Half-open place of ``quote``, or of it trimmed; null if absent."""
    place = lambda q: F.when((F.length(q) > 0) & (F.instr(text, q) > 0), F.struct((F.instr(text, q) - 1).alias("start"), (F.instr(text, q) - 1 + F.length(q)).alias("end")))
    return F.coalesce(place(quote), place(F.trim(quote)))


def sentence_span(text: Column, start: Column, end: Column, pad: int = 1) -> Column:
    """[start, end) widened to whole sentences and ``pad`` more on each side."""
    left, right = F.substring(text, F.lit(1), start), F.substring(text, end + 1, F.length(text))
    heads = F.split(left, r"(?<=[.!?。！？\n])")
    tails = F.split(right, r"(?<=[.!?。！？\n])")
    size = lambda parts: F.aggregate(parts, F.lit(0), lambda s, p: s + F.length(p))
    keep = F.slice(heads, F.greatest(F.size(heads) - pad, F.lit(1)), F.lit(pad + 1))
    return F.struct((start - size(keep)).alias("start"), (end + size(F.slice(tails, 1, pad + 1))).alias("end"))


def evidence_terms(query: Column, body: Column, most: int = 12) -> Column:
    """Query terms that occur in the body, longest first."""
    held = F.filter(query_terms(query), lambda t: F.contains(F.lower(body), t))
    return F.slice(F.transform(F.array_sort(F.transform(held, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda s: s["t"]), 1, most)


def evidence_window(query: Column, body: Column, width: int = 420) -> Column:
    """At most ``width`` characters around the first evidence term."""
    first = F.coalesce(F.instr(F.lower(body), F.get(evidence_terms(query, body), F.lit(0))), F.lit(1))
    return F.substring(body, F.greatest(F.lit(1), first - width // 2), F.lit(width))


def independent(a: Column, b: Column, most: float = 0.72) -> Column:
    """Whether two texts share too few character bigrams to be one statement."""
    x, y = bigrams(a), bigrams(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least == 0, F.lit(True)).otherwise(F.size(F.array_intersect(x, y)) / least < most)


def listed(value: Column) -> Column:
    """Comma-separated text to its distinct trimmed parts, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != ""))


def letters_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")


def unfenced(text: Column) -> Column:
    """The body of a Markdown fence, or the text if there is none."""
    body = F.regexp_extract(text, r"(?s)^\s*```[a-zA-Z]*\s*\n(.*?)\n?```\s*$", 1)
    return F.when(body != "", body).otherwise(text)


def topics(query: Column, most: int = 4, least: int = 18) -> Column:
    """Sub-questions of a long question: split at hard punctuation, and pieces
    that stay long at commas before a conjunction; short pieces go."""
    pieces = F.flatten(F.transform(F.split(query, r"[.!?;。！？；\n]+"), lambda p: F.when(F.length(p) > 60, F.split(p, r",\s*(?=(?:and|but|so|also)\b)")).otherwise(F.array(p))))
    kept = F.filter(F.transform(pieces, lambda p: F.trim(p)), lambda p: F.length(p) >= 6)
    whole = F.array(F.trim(query))
    return F.when((F.length(query) < least) | (F.size(kept) == 0), whole).otherwise(F.slice(F.array_distinct(kept), 1, most))


def unwrapped(query: Column) -> Column:
    """A question without channel tags, attachments and outer punctuation."""
    bare = F.regexp_replace(F.regexp_replace(query, r"(?s)<(\w+)[^>]*>(.*?)</\1>", "$2"), r"\[(?:image|file|sticker)[^\]]*\]", "")
    return F.regexp_replace(F.trim(bare), r"^[\s\p{Punct}]+|[\s\p{Punct}]+$", "")


def unquoted(body: Column) -> Column:
    return F.trim(F.regexp_replace(body, "[\"“«「『][^\"”»」』]*[\"”»」』]", ""))


def expanded(query: Column, classes: dict[str, str]) -> Column:
    """A question with the anchor words of the classes whose pattern it matches."""
    return F.concat_ws(" ", query, *[F.when(query.rlike(pattern), F.lit(words)) for pattern, words in classes.items()])


def contextual(query: Column, context: Column, most: int = 120) -> Column:
    """An anaphoric question with the end of its context."""
    refers = query.rlike(r"(?i)\b(it|that|this|they|them|he|she|then)\b") & (F.length(F.coalesce(context, F.lit(""))) > 0)
    return F.when(refers, F.concat_ws(" ", query, F.substring(context, F.greatest(F.lit(1), F.length(context) - most + 1), F.lit(most)))).otherwise(query)


def context_terms(context: Column, tail: int = 360, most: int = 4) -> Column:
    """The last distinct terms of a context that are no stop words."""
    words = F.filter(tokens(F.substring(context, F.greatest(F.lit(1), F.length(context) - tail + 1), F.lit(tail))), lambda t: ~t.isin(*STOP_WORDS))
    return F.reverse(F.slice(F.array_distinct(F.reverse(words)), 1, most))


def concept(title_: Column, tags: Column, body: Column) -> Column:
    """A word for a record: of its title, else its first domain tag, else its
    first long word."""
    tag = F.get(F.transform(F.filter(tags, lambda t: t.startswith("domain:")), lambda t: F.substring_index(t, ":", -1)), F.lit(0))
    named = F.regexp_extract(title_, "《([^》]{1,40})》", 1)
    return F.coalesce(F.when(named != "", named), tag, F.get(F.filter(tokens(body), lambda t: F.length(t) >= 4), F.lit(0)))


def variants(query: Column, context: Column) -> Column:
    """A question alone and with its context, distinct in 500 characters."""
    return F.array_distinct(F.transform(F.array(query, F.concat_ws(" ", context, query)), lambda t: F.substring(F.trim(t), 1, 500)))
