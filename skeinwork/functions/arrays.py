"""Functions of lists and vectors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def mapped_list(c: Column, table: Mapping[str, str]) -> Column:
    """Every element through the table, unknown ones as they are, then each once in order."""
    m = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.array_distinct(F.transform(c, lambda x: F.coalesce(m[x], x)))


def multi_hot(c: Column, vocabulary: Sequence[str], prefix: str = "") -> list[Column]:
    """One 0/1 column a word of the vocabulary; a null list has none."""
    return [F.coalesce(F.array_contains(c, w), F.lit(False)).cast("int").alias(f"{prefix}{w.lower().replace('-', '_').replace(' ', '_')}") for w in vocabulary]


def one_hot(c: Column, values: Sequence[str], prefix: str = "") -> list[Column]:
    return [F.coalesce(c == v, F.lit(False)).cast("int").alias(f"{prefix}{v.lower()}") for v in values]


def jaccard(a: Column, b: Column) -> Column:
    """0 if both lists are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def unit(a: Column) -> Column:
    """Of length 1; a vector without length stays as it is."""
    n = norm(a)
    lengths = F.array_repeat(F.when(n > 0, n).otherwise(1.0), F.size(a))  # once a row, not once an element
    return F.zip_with(a, lengths, lambda x, y: x.cast("double") / y)


def _times(weight: float):
    return lambda x: x.cast("double") * weight


def weighted_mean_vector(parts: Sequence[tuple[Column, float]], dims: int) -> Column:
    """Mean of several vectors, weights scaled up over those that are there; zeros if none is."""
    total = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
    zero = F.array_repeat(F.lit(0.0), dims)
    out = zero
    for c, w in parts:
        scaled = F.transform(F.coalesce(c, zero), _times(w))
        out = F.zip_with(out, scaled, lambda s, x: s + x)
    return F.when(total > 0, F.transform(out, lambda x: x / total)).otherwise(zero)
