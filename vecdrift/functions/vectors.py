"""Vector expressions over ``array<double>`` columns.

With ``dim`` known the sums are unrolled left to right, which whole-stage codegen compiles; without it they are
higher-order functions, which work for any length but are interpreted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def dot(a: Column, b: Column, dim: int | None = None) -> Column:
    if dim:
        return _total([a[i] * b[i] for i in range(dim)])
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column, dim: int | None = None) -> Column:
    if dim:
        return _total([(a[i] - b[i]) * (a[i] - b[i]) for i in range(dim)])
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def negative_ip(a: Column, b: Column, dim: int | None = None) -> Column:
    return -dot(a, b, dim)


def squared_norm(v: Column, dim: int | None = None) -> Column:
    return dot(v, v, dim)


def mahalanobis_diagonal(a: Column, b: Column, weights: list[float]) -> Column:
    """Squared Mahalanobis distance under a diagonal inverse covariance."""
    return _total([(a[i] - b[i]) * (a[i] - b[i]) * F.lit(float(w)) for i, w in enumerate(weights)])


def l2_normalize(v: Column, floor: float = 1e-12) -> Column:
    """x / sqrt(max(sum of squares, floor)): a zero vector stays zero."""
    norm = F.sqrt(F.greatest(squared_norm(v), F.lit(floor)))
    return F.transform(v, lambda x: x / norm)


def mse(a: Column, b: Column) -> Column:
    return squared_l2(a, b) / F.size(a)


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b)), F.lit(eps))


def weighted_channel_difference(a: Column, b: Column, weights: list[float], eps: float = 1e-10) -> Column:
    """One layer of a learnt perceptual distance: unit-normalised channels, squared difference, linear weights."""
    na, nb = F.sqrt(squared_norm(a)) + F.lit(eps), F.sqrt(squared_norm(b)) + F.lit(eps)
    return _total([F.lit(float(w)) * F.pow(a[i] / na - b[i] / nb, F.lit(2)) for i, w in enumerate(weights)])


def true_distance(d: Column, metric: str) -> Column:
    """Euclidean distance from what the search returns: squared L2, or negative dot of unit rows."""
    if metric == "l2":
        return F.sqrt(F.greatest(d, F.lit(0.0)))
    if metric == "ip":
        return F.sqrt(F.greatest(F.lit(2.0) + F.lit(2.0) * d, F.lit(0.0)))
    raise ValueError(f"no true distance for {metric!r}")


def quantize(v: Column, bits: Column) -> Column:
    """Keep ``bits`` binary places of every component."""
    scale = F.pow(F.lit(2.0), bits)
    return F.transform(v, lambda x: F.round(x * scale) / scale)
