"""Vector functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 for null or empty vectors, different lengths or a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fit = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fit & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def stub_embedding(text: Column, dim: int = 8) -> Column:
    """Deterministic vector of a text: bytes of its SHA-256 digest, repeated, divided by 255."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0)


def parse_vector(text: Column) -> Column:
    """'[1,2]' as an array of doubles; blank and null give the empty array."""
    return F.coalesce(F.from_json(F.nullif(F.trim(text), F.lit("")), "array<double>"), F.array().cast("array<double>"))
