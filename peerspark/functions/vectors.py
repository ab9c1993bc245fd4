"""Array arithmetic kept inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _d(c) -> Column:
    return F.transform(F.col(c) if isinstance(c, str) else c, lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine similarity, 0 when either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def l2_distance(a, b) -> Column:
    sq = F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, x: s + x))


def doubles(c) -> Column:
    return _d(c)


def cosine_of(a: str, b: str, norm_a: str, norm_b: str) -> Column:
    """``cosine`` of arrays of doubles whose norms are known."""
    n = F.col(norm_a) * F.col(norm_b)
    return F.when(n > 0, F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / n).otherwise(F.lit(0.0))


def distance_of(a: str, b: str) -> Column:
    """``l2_distance`` of arrays of doubles."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def subtract(a, b) -> Column:
    return F.zip_with(_d(a), _d(b), lambda x, y: x - y)
