"""The question router: an ordered rule table, first match wins.

The vocabularies are the engine's own and small; a deployment passes its own
table. Every rule is a predicate expression, so a batch of questions is routed
in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signals

OPT_OUT = r"(?i)\b(don'?t|do not|no need to) (recall|remember|look)\b"
RECALL = r"(?i)\b(remember|recall|what did i|last time|did we|you said)\b|記得|记得"
TECHNICAL_ACT = r"(?i)\b(fix|deploy|install|run|write|debug|restart)\b"
TECHNICAL_THING = r"(?i)\b(code|server|script|query|database|test|config)\b"
DISTRESS = r"(?i)\b(panic|crying|scared|can'?t sleep|overwhelmed)\b"
BID = r"(?i)\b(hug|stay with me|talk to me|comfort)\b"
PATTERN = r"(?i)\b(every time|always|keep (doing|happening)|again and again)\b"
SYMPTOM = r"(?i)\b(fever|headache|bleeding|dizzy)\b"
PERSON = r"(?i)\bwho is\b|\bwho'?s\b"
STATUS = r"(?i)\b(how is|status of|where is|what happened to)\b"
PRESENT = r"(?i)\b(right now|at the moment|i am|i'm)\b"

#: (class, decision, lanes, pattern or None) in order of precedence.
RULES = (
    ("G", "suppress", (), OPT_OUT), ("H", "mixed", ("anchor", "person"), None), ("F", "tool", (), None), ("E", "retrieve", ("anchor", "person"), PERSON),
    ("D", "retrieve", ("anchor", "cold"), RECALL), ("A", "support", ("anchor",), BID), ("C", "retrieve", ("anchor", "library"), PATTERN), ("C", "suppress", (), SYMPTOM),
    ("E", "retrieve", ("anchor",), STATUS), ("B", "suppress", (), PRESENT),
)


def _matches(text: Column, name: str, pattern: str | None) -> Column:
    if pattern is not None:
        return text.rlike(pattern)
    if name == "F":
        return text.rlike(TECHNICAL_ACT) & text.rlike(TECHNICAL_THING)
    return text.rlike(PERSON) & text.rlike(DISTRESS)


def routed(questions: DataFrame, text: str = "text") -> DataFrame:
    """Questions with ``plan``: class, decision, lanes, reason."""
    body = F.trim(F.coalesce(F.col(text), F.lit("")))
    plan = lambda c, d, lanes, why: F.struct(F.lit(c).alias("class"), F.lit(d).alias("decision"), F.array(*[F.lit(x) for x in lanes]).cast("array<string>").alias("lanes"), why.alias("reason"))
    low = signals.low_signal(body)
    found = F.when(low.isNotNull(), plan("G", "suppress", (), low))
    for name, decision, lanes, pattern in RULES:
        found = found.when(_matches(body, name, pattern), plan(name, decision, lanes, F.lit(f"rule {name}")))
    return questions.withColumn("plan", found.otherwise(plan("U", "retrieve", ("anchor",), F.lit("fallback"))))


def prototype_route(similarities: DataFrame, least: float = 0.70, margin: float = 0.10) -> DataFrame:
    """``query_id, decision`` from similarities to class prototypes
    ``(query_id, class, similarity)``: none if 'immediate' is near and clear of
    the others, else full."""
    best = similarities.groupBy("query_id").agg(
        F.max(F.when(F.col("class") == "immediate", F.col("similarity"))).alias("now"), F.max(F.when(F.col("class") != "immediate", F.col("similarity"))).alias("rest")
    )
    skip = (F.col("now") >= least) & (F.col("now") - F.coalesce("rest", F.lit(0.0)) >= margin)
    return best.select("query_id", F.when(skip, "none").otherwise("full").alias("decision"))


def alias_table(dictionary: DataFrame) -> DataFrame:
    """``alias, canonical, relation`` rows of an alias dictionary."""
    return dictionary.select("canonical", "relation", F.explode(F.array_distinct(F.concat("aliases", F.array("canonical")))).alias("alias")).where(F.length("alias") >= 2)


def people_in(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """``query_id, canonical`` of the aliases that a question holds as words."""
    words = questions.select("query_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("word"))
    return words.join(aliases.select(F.lower("alias").alias("word"), "canonical"), "word").select("query_id", "canonical").distinct()


def allowed_lanes(lanes: Column) -> Column:
    """Names of the lanes that a map of switches allows."""
    return F.array_sort(F.map_keys(F.map_filter(lanes, lambda _, on: on)))


def plan_id(plan: Column) -> Column:
    """A stable name of a plan."""
    return F.substring(F.sha2(F.to_json(plan), 256), 1, 20)


def answer_contract(required: Column, shown: Column) -> Column:
    """What an answer must rest on, and whether it was found among the shown
    evidence."""
    return F.struct(required.alias("requires"), F.exists(shown, lambda s: F.array_contains(required, s)).alias("direct_evidence_found"))


def entity_groups(entities: Column) -> Column:
    """Distinct variants, of two letters at least, of each entity."""
    return F.transform(entities, lambda group: F.array_distinct(F.filter(F.transform(group, lambda v: F.lower(F.trim(v))), lambda v: F.length(v) >= 2)))


def required_actions(actions: Column, known: tuple[str, ...] = ("asked", "bought", "decided", "finished", "moved", "started")) -> Column:
    return F.array_intersect(actions, F.array(*[F.lit(a) for a in known]))
