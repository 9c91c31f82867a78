"""Vector column expressions over ``array<float|double>``.

All are higher-order SQL functions (``zip_with``, ``aggregate``,
``transform``), so they stay inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value of the reference: the guard added to every norm.
NORM_EPS = 1e-12


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(a) -> Column:
    return _c(a).cast("array<double>")


def dot(a, b) -> Column:
    prods = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def sq_norm(a) -> Column:
    return F.aggregate(as_double(a), F.lit(0.0), lambda acc, x: acc + x * x)


def norm(a) -> Column:
    return F.sqrt(sq_norm(a))


def l2_normalize(a) -> Column:
    """``x / (||x|| + 1e-12)``; a zero vector stays zero, null stays null."""
    arr = as_double(a)
    # the norm as an array beside the vector: inside the lambda it would be
    # computed again for every component
    norms = F.array_repeat(norm(arr), F.size(arr))
    return F.zip_with(arr, norms, lambda x, n: x / (n + F.lit(NORM_EPS)))


def sq_distance(a, b) -> Column:
    diffs = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a, b) -> Column:
    """Cosine of two vectors, each guarded by the norm epsilon."""
    return dot(a, b) / ((norm(a) + F.lit(NORM_EPS)) * (norm(b) + F.lit(NORM_EPS)))


def round_array(a, digits: int = 6) -> Column:
    return F.transform(as_double(a), lambda x: F.round(x, digits))
