"""Vector similarity as columns, for rescoring small joined sets in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    pairs = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def norm(vec: Column) -> Column:
    return F.sqrt(dot(vec, vec))


def cosine_similarity(left: Column, right: Column) -> Column:
    """Null when a side is null, empty of length or of another size."""
    scale = norm(left) * norm(right)
    return F.when((F.size(left) == F.size(right)) & (scale > 0), dot(left, right) / scale)


def cosine_distance(left: Column, right: Column) -> Column:
    return 1 - cosine_similarity(left, right)


def as_vector(col: Column, dimension: int) -> Column:
    """Cast to floats and fail the job on any other length."""
    vec = col.cast("array<float>")
    wrong = col.isNotNull() & (F.size(col) != dimension)
    message = F.concat(F.lit(f"expected {dimension} values, got "), F.size(col).cast("string"))
    return F.when(wrong, F.raise_error(message).cast("array<float>")).otherwise(vec)
