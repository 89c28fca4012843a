"""Vector expressions over ``array<float|double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import let


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, value: acc + value,
    )


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def normalize(vector: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return let(
        norm(vector),
        lambda n: F.transform(
            vector, lambda x: x.cast("double") / F.when((n == 0) | n.isNull(), F.lit(1.0)).otherwise(n)
        ),
    )


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity, 0 for a zero vector."""
    scale = norm(left) * norm(right)
    return F.when(scale > 0, dot(left, right) / scale).otherwise(F.lit(0.0))


def cosine_strict(left: Column, right: Column) -> Column:
    """Cosine that fails on unequal dimensions or a zero vector."""
    scale = norm(left) * norm(right)
    return (
        F.when(F.size(left) != F.size(right), F.raise_error(F.lit("vector dimensions differ")).cast("double"))
        .when(scale == 0, F.raise_error(F.lit("zero vector has no direction")).cast("double"))
        .otherwise(dot(left, right) / scale)
    )


def safe_double(column: Column) -> Column:
    """Missing or unreadable numbers count as 0."""
    return F.coalesce(column.cast("string").try_cast("double"), F.lit(0.0))


def finite(column: Column) -> Column:
    """NaN and infinities count as 0."""
    value = F.coalesce(column.cast("double"), F.lit(0.0))
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), F.lit(0.0)).otherwise(value)
