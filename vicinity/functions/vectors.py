"""Vector expressions over ``array<double>`` columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _zero() -> Column:
    return F.lit(0.0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), _zero(), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), _zero(), lambda s, x: s + x)


def distance(a: Column, b: Column, least: float = 1e-12) -> Column:
    """Euclidean, with the square clamped from below."""
    return F.sqrt(F.greatest(squared_distance(a, b), F.lit(least)))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    """(1 - cos) / 2."""
    return (1 - cosine(a, b)) / 2


def normalize(a: Column, eps: float = 0.0, clamp: bool = False) -> Column:
    """Unit length; ``eps`` is added to the norm, or bounds it from below with ``clamp``."""
    n = F.greatest(norm(a), F.lit(eps)) if clamp else norm(a) + eps
    return F.transform(a, lambda x: x / n)


def flip_average(a: Column) -> Column:
    """The mean of a vector and its mirror image."""
    return F.zip_with(a, F.reverse(a), lambda x, y: (x + y) / 2)


def symmetric_kl(p: Column, q: Column, eps: float = 1e-6) -> Column:
    """Mean of the Kullback-Leibler divergences both ways, of values clipped to [eps, 1]."""
    clip = lambda v: F.transform(v, lambda x: F.least(F.greatest(x, F.lit(eps)), F.lit(1.0)))
    one = lambda a, b: F.aggregate(F.zip_with(clip(a), clip(b), lambda x, y: x * F.log(x / y)), _zero(), lambda s, x: s + x)
    return (one(p, q) + one(q, p)) / 2


def softmax(a: Column) -> Column:
    top = F.array_max(a)
    total = F.aggregate(F.transform(a, lambda x: F.exp(x - top)), _zero(), lambda s, x: s + x)
    return F.transform(a, lambda x: F.exp(x - top) / total)


def power_mean(a: Column, p: float = 3.0, eps: float = 1e-6, after: float = 0.0) -> Column:
    """(mean(max(x, eps)^p) + after)^(1/p)."""
    total = F.aggregate(F.transform(a, lambda x: F.pow(F.greatest(x, F.lit(eps)), F.lit(p))), _zero(), lambda s, x: s + x)
    return F.pow(total / F.size(a) + after, F.lit(1.0 / p))
