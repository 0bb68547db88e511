"""Scoring signals, gates and decision tables of ranking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamped(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def distance_signal(distance: Column) -> Column:
    return clamped((distance - 0.2) / 0.6)


def activation_signal(activation: Column) -> Column:
    return clamped(F.coalesce(activation, F.lit(0.0)) / 5)


def tier_level_signal(tier: Column, level: Column) -> Column:
    return clamped(
        F.lit(0.5) + F.when(level.isin("understanding", "cognition"), 0.3).otherwise(0.0)
        + F.when(tier == "core", 0.2).otherwise(0.0) - F.when(tier == "short", 0.2).otherwise(0.0)
    )


def evidence_coverage(terms: Column) -> Column:
    return F.least(F.size(terms) / 4, F.lit(1.0))


def temporal_mode(text: Column) -> Column:
    """'historical' for questions about the past, else 'current'."""
    return F.when(text.rlike(r"(?i)\b(before|earlier|used to|back then|previously|last (week|month|year))\b|以前|昔"), "historical").otherwise("current")


def temporal_label(tags: Column, superseded: Column) -> Column:
    return F.when(F.arrays_overlap(tags, F.array(F.lit("state:past"), F.lit("state:obsolete"))) | superseded, "past").otherwise("current")


def low_signal(text: Column) -> Column:
    """Why a question is too poor to search for, or null."""
    body = F.trim(F.coalesce(text, F.lit("")))
    letters = F.regexp_replace(body, r"[^\p{L}\p{N}]", "")
    return (
        F.when(body == "", "empty").when(letters == "", "symbols").when(body.rlike(r"(?i)^(go on|continue|next|more)[.!]*$"), "continue")
        .when(body.rlike(r"(?i)^(h+m+|a+h+|o+h+|lol|ha(ha)+|uh+)[.!~]*$"), "interjection").when(F.length(letters) < 2, "fragment")
    )


def domain(text: Column) -> Column:
    """The first matching subject of a question, or 'general'."""
    table = (
        ("technical", r"(?i)\b(code|bug|error|server|deploy|query)\b"), ("health", r"(?i)\b(sleep|pain|doctor|sick)\b"), ("work", r"(?i)\b(work|meeting|project|deadline)\b"),
        ("people", r"(?i)\b(friend|mother|father|family)\b"), ("feeling", r"(?i)\b(sad|happy|angry|afraid)\b"),
    )
    found = F.when(text.rlike(table[0][1]), table[0][0])
    for name, pattern in table[1:]:
        found = found.when(text.rlike(pattern), name)
    return found.otherwise("general")


def rerank_score(rerank: Column, tag: Column, emotion: Column, recency: Column, activation: Column, tier: Column, evidence: Column, todo: Column, repeated: Column) -> Column:
    """.70 rerank, .12 tag, .05 emotion, .05 recency, .03 activation, .03 tier,
    .02 evidence; times .85 for unwanted todos; less .30 if shown lately."""
    base = 0.70 * rerank + 0.12 * tag + 0.05 * emotion + 0.05 * recency + 0.03 * activation + 0.03 * tier + 0.02 * evidence
    return base * F.when(todo, 0.85).otherwise(1.0) - F.when(repeated, 0.30).otherwise(0.0)


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 0.0).otherwise(F.round(100 * part / whole, 1))


def human_bytes(n: Column) -> Column:
    out = F.format_string("%d B", n)
    for unit, size in (("KB", 1 << 10), ("MB", 1 << 20), ("GB", 1 << 30)):
        out = F.when(n >= size, F.format_string(f"%.1f {unit}", F.bround(n / size, 1))).otherwise(out)
    return out


def should_index(text: Column, level: Column, collection: Column) -> Column:
    """Whether a record has enough facets to be indexed by search keys."""
    facets = (
        text.rlike("[①-⑳]") | (F.regexp_count(text, F.lit(r"(?m)^\s*\d+[.)、]")) >= 2) | (F.regexp_count(text, F.lit(r"(?m)^\s*[-*•]\s")) >= 2)
        | (F.regexp_count(text, F.lit("【[^】]+】")) >= 2) | (F.regexp_count(text, F.lit("→|->")) >= 2) | (F.regexp_count(text, F.lit("、")) >= 3)
        | ((F.regexp_count(text, F.lit(r"[.!?。！？]")) >= 4) & (F.length(text) >= 150))
    )
    return (level == "raw") & (collection != "library") & F.coalesce(facets, F.lit(False))


def chunk_policy(role: Column, relationship: Column, adds: Column) -> Column:
    """'meta', 'index' or 'context_only' for a chunk of a long text."""
    return F.when(role == "meta", "meta").when((relationship == "echo") & ~adds, "context_only").otherwise("index")


def step_penalty(age_minutes: Column, count: Column) -> Column:
    """Penalty for a record shown lately: a step of its age, plus 0.04 a showing
    up to four."""
    step = F.when(age_minutes < 45, 0.30).when(age_minutes < 120, 0.18).when(age_minutes < 360, 0.08).otherwise(0.0)
    return step + 0.04 * F.least(count, F.lit(4))
