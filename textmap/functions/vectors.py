"""Vector columns: arrays of doubles."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from textmap.functions.common import let


def doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, v: acc + v
    )


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, v: acc + v * v))


def unit(vec: Column) -> Column:
    """Row scaled to length one; a zero row stays zero."""
    return let(norm(vec), lambda n: F.transform(vec, lambda v: F.when(n > 0, v / n).otherwise(v)))


def clip_below(vec: Column, epsilon: float = 1e-4) -> Column:
    return F.transform(vec, lambda v: F.when(v < epsilon, F.lit(0.0)).otherwise(v))


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded, with minus zero turned into zero."""
    return F.round(value, digits) + F.lit(0.0)
