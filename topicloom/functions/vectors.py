"""Vector expressions over ``array<double>`` columns; JVM-side, no Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, not again for each element of a lambda in body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def scale(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x * by)


def l2(v: Column) -> Column:
    """Unit vector; a zero vector stays zero."""
    return let(v, lambda u: let(norm(u), lambda n: F.when(n > 0, F.transform(u, lambda x: x / n)).otherwise(u)))


def cosine(a: Column, b: Column) -> Column:
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def blend(v: Column, c: Column, beta: Column) -> Column:
    """(1 - beta) v + beta c, scaled to unit length."""
    return l2(let(beta, lambda b: F.zip_with(v, c, lambda x, y: x * (F.lit(1.0) - b) + y * b)))


def hstack(*weighted: tuple[Column, float]) -> Column:
    """Concatenation of weighted vectors, scaled to unit length."""
    return l2(F.concat(*(F.transform(v, lambda x, w=w: x * F.lit(w)) for v, w in weighted)))


def softmax(sims: Column, temperature: float = 5.0) -> Column:
    """Softmax of an array of similarities."""
    powers = let(F.array_max(sims), lambda top: F.transform(sims, lambda s: F.exp(F.lit(temperature) * (s - top))))
    return let(powers, lambda p: let(F.aggregate(p, F.lit(0.0), lambda s, x: s + x), lambda total: F.transform(p, lambda x: x / total)))


def entropy(probs: Column) -> Column:
    """-sum p ln p with p clipped to [1e-12, 1]."""
    clipped = F.transform(probs, lambda p: F.greatest(F.lit(1e-12), F.least(F.lit(1.0), p)))
    return -F.aggregate(clipped, F.lit(0.0), lambda s, p: s + p * F.log(p))
