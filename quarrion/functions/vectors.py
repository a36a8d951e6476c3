"""Vector similarities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(column: Column, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(column, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda acc, x: acc + x)


def square_distance(column: Column, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.aggregate(F.zip_with(column, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda acc, x: acc + x)


def norm(column: Column) -> Column:
    return F.sqrt(F.aggregate(column, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def score(column: Column, query: list[float], similarity: str) -> Column:
    """Higher is nearer: cosine (1 + c) / 2, dotProduct (1 + d) / 2, euclidean 1 / (1 + d²)."""
    if similarity == "cosine":
        length = sum(x * x for x in query) ** 0.5
        if not length:
            raise ValueError("a zero vector has no cosine")
        return (1 + dot(column, query) / (norm(column) * length)) / 2
    if similarity == "dotProduct":
        return (1 + dot(column, query)) / 2
    if similarity == "euclidean":
        return 1 / (1 + square_distance(column, query))
    raise ValueError(f"unknown similarity {similarity}")


def byte_score(column: Column, query: list[int], similarity: str) -> Column:
    """Scores of vectors of bytes: the dot product is taken as a share of its largest value, 2^15 for each dimension."""
    if similarity == "dotProduct":
        return 0.5 + dot(column, query) / F.lit(float(len(query) << 15))
    return score(column, query, similarity)


def signs(column: Column) -> Column:
    """One bit for each component, set where it is positive, as longs of up to 32 bits."""
    starts = F.sequence(F.lit(1), F.size(column), F.lit(32))
    word = lambda s: F.aggregate(F.slice(column, s, 32), F.lit(0).cast("long"), lambda acc, x: acc * 2 + F.when(x > 0, 1).otherwise(0))
    return F.transform(starts, word)


def sign_words(query: list[float]) -> list[int]:
    out = []
    for s in range(0, len(query), 32):
        word = 0
        for x in query[s : s + 32]:
            word = word * 2 + (x > 0)
        out.append(word)
    return out


def hamming(words: Column, query: list[int]) -> Column:
    q = F.array(*[F.lit(x).cast("long") for x in query])
    return F.aggregate(F.zip_with(words, q, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda acc, x: acc + x)


def bit_score(words: Column, query: list[int], dim: int) -> Column:
    return (F.lit(dim) - hamming(words, query)) / F.lit(float(dim))
