"""Inner product, cosine and Euclidean distance of arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "euclidean", "dot")


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _doubles(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Smaller is nearer: 1 - cosine, the Euclidean distance, or the negative inner product."""
    if metric == "cosine":
        return 1 - dot(a, b) / (norm(a) * norm(b))
    if metric == "euclidean":
        return euclidean(a, b)
    if metric == "dot":
        return -dot(a, b)
    raise ValueError(f"metric must be one of {METRICS}")


def require_dimension(c: Column, n: int) -> Column:
    """The array, or an error where its length isn't ``n``."""
    return F.when(c.isNull() | (F.size(c) == n), c).otherwise(F.raise_error(F.lit(f"a vector must have {n} components")))
