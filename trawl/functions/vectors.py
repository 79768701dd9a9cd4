"""Vector arithmetic on arrays, in double precision and on the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-9


def literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def length(values: Sequence[float]) -> float:
    return math.sqrt(sum(float(v) ** 2 for v in values))


def cosine(a: Column, query: Sequence[float]) -> Column:
    """Cosine of a column's vectors to a query; a tiny term in the divisor keeps zero vectors at 0."""
    return dot(a, literal(query)) / (norm(a) * F.lit(length(query)) + F.lit(TINY))
