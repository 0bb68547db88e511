"""Vector expressions over array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def normalised(a: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    size = norm(a)
    return F.when(size > 0, F.transform(a, lambda x: x / size)).otherwise(a)


def hash_vector(text: Column, dims: int = 32) -> Column:
    """A deterministic offline embedding: SHA-256 bytes centred and scaled."""
    digest = F.sha2(text, 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: (F.conv(F.substring(digest, i % 32 * 2 + 1, F.lit(2)), 16, 10).cast("double") - 127.5) / 127.5)
    return normalised(raw)
