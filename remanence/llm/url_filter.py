"""URL rules by expression hashing (operator 5), DataFrame functions only.

A URL is expanded into host suffixes times path prefixes. Each expression is
hashed; URLs meet rules on a short prefix of the digest, which is cheap to
shuffle and to compare, and only then is the whole digest confirmed. Only
suffixes and prefixes of a shape that some rule has are expanded, so a host of
thousands of labels costs no more than one of three.

Defined results: a null URL, or one without ``://``, has an empty host and path
and fits no rule. Repeated rows are judged alike. An empty rule table leaves
every URL to ``default``. If two rules of one length fit, ``block`` wins, then
the smaller rule text. Null or host-less rules are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Hex digits of the digest on which URLs and rules meet.
SHORT = 8


def with_host_path(df: DataFrame, url: str) -> DataFrame:
    """Adds ``host`` (lower-cased A-Z) and ``path`` of the URL column."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.col(url).substr(at + 3, F.length(url)))
    return df.withColumns({
        "host": F.coalesce(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit("")),
        "path": F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")),
    })


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Rules ``(action, rule)`` with their parts, digest and short digest."""
    return (
        rules.select("action", "rule")
        .where(F.col("rule").contains("/") & ~F.col("rule").startswith("/") & F.col("action").isNotNull())
        .distinct()
        .withColumns({
            "labels": F.size(F.split(F.substring_index("rule", "/", 1), r"\.")),
            "prefix": F.length("rule") - F.length(F.substring_index("rule", "/", 1)),
            "digest": _digest(F.col("rule")),
        })
        .withColumn("short", F.substring("digest", 1, SHORT))
    )


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: ``key``, host, path, rule (null if none
    fits) and verdict. See the module for nulls, ties and empty tables."""
    prepared = prepare_rules(rules)
    # At most as many rows as rules have label counts and path lengths: a few dozen.
    shapes = prepared.select("labels", "prefix").distinct().collect()
    base = pages.select(F.col(key).alias(key), F.col(url).alias("__url"))
    parsed = with_host_path(base, "__url")
    if not shapes:
        return parsed.select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    suffix = {n: F.substring_index("host", ".", -n) for n in {s.labels for s in shapes}}
    labels = F.size(F.split("host", r"\."))
    expressions = F.array_compact(F.array(*[
        F.when((labels >= s.labels) & (F.length("path") >= s.prefix), F.concat(suffix[s.labels], F.col("path").substr(1, s.prefix)))
        for s in sorted(shapes)
    ]))
    best = (
        parsed.select("__url", "host", "path").where(F.col("host") != "").distinct()
        .select("__url", F.explode(expressions).alias("expression"))
        .select("__url", _digest(F.col("expression")).alias("full"))
        .withColumn("short", F.substring("full", 1, SHORT))
        .join(prepared.select("short", "digest", "action", "rule"), "short")
        .where(F.col("full") == F.col("digest"))
        .groupBy("__url")
        .agg(F.min(F.struct((-F.length("rule")).alias("shortness"), (F.col("action") != "block").alias("lenient"), "rule", "action")).alias("best"))
    )
    return parsed.join(best, "__url", "left").select(
        key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )
