"""Expressions on vectors, and the deterministic embedder used offline."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    """The distance of the engine: squared, so that for unit vectors it is 2 - 2 cos."""
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0.0 where either vector is all zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n))


def hash_embedding(text: Column) -> Column:
    """Eight numbers from the SHA-256 of the text, at length one: equal texts get equal vectors."""
    digest = F.sha2(text.cast("binary"), 256)
    raw = F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("double") / 4294967296.0 - 0.5 for i in range(8)])
    return unit(raw)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(True)
