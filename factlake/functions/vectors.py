"""Vector expressions evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Distances are rounded to this many digits before they are ranked, so that
# equal vectors tie (and fall back to their ids) whatever the summation order.
DISTANCE_DIGITS = 9


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity; NULL for a NULL or zero vector."""
    similarity = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.round(F.lit(1.0) - similarity, DISTANCE_DIGITS)
