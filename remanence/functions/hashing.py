"""Stable names: digests of parts, fingerprints, UUIDs, sampling buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the URL namespace of name-based UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def proposal_id(kind: Column, a: Column, b: Column) -> Column:
    return F.concat(F.lit("up_"), F.substring(F.sha2(F.concat_ws("|", kind, a, b), 256), 1, 16))


def group_fingerprint(ids: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.array_sort(F.array_distinct(ids))), 256)


def candidate_fingerprint(ids: Column, kind: Column) -> Column:
    return F.sha2(F.concat_ws("\n", group_fingerprint(ids), kind), 256)


def link_fingerprint(family: Column, role: Column, a: Column, b: Column, evidence: Column) -> Column:
    """Same for both orders of a flow link, not for a semantic one."""
    first = F.when(family == "flow", F.least(a, b)).otherwise(a)
    second = F.when(family == "flow", F.greatest(a, b)).otherwise(b)
    return F.concat(F.lit("link_"), F.substring(F.sha2(F.concat_ws("\x1f", family, role, first, second, evidence), 256), 1, 24))


def named_uuid(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """A version 5 UUID of ``name``."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    part = lambda start, size: F.substring(h, start, size)
    variant = F.lower(F.hex((F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def edge_id(source: Column, target: Column, role: Column) -> Column:
    return named_uuid(F.concat_ws("\x1f", source, target, role))


def case_id(belief: Column, kind: Column, ordinal: Column) -> Column:
    return F.concat(F.lit("bc-"), F.substring(named_uuid(F.concat_ws("\x1f", belief, kind, ordinal.cast("string"))), 1, 18))


def heat_event_id(query: Column, context: Column, ts: Column) -> Column:
    bucket = F.floor(F.unix_timestamp(ts.cast("timestamp")) / 300).cast("string")
    return F.substring(F.sha2(F.concat_ws("|", query, context, bucket), 256), 1, 24)


def sampled(key: Column, percent: int) -> Column:
    """Whether a key's digest falls in the first ``percent`` of 100 buckets."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % 100 < percent
