"""Vector algebra over array columns with higher-order functions; all sums in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a * b))


def distance2(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)))


def scaled(x: Column, by: Column) -> Column:
    return F.transform(x, lambda a: a * by)


def added(x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda a, b: a + b)


def normalized(x: Column, least: float = 1e-8) -> Column:
    """x over its length, or over ``least`` where that is larger."""
    return scaled(x, 1 / F.greatest(F.sqrt(dot(x, x)), F.lit(least)))


def rounded(x: Column, places: int = 6) -> Column:
    return F.transform(x, lambda a: F.round(a, places) + 0.0)


def sign_projection(x: Column, out_dim: int, seed: int = 1) -> Column:
    """x times a matrix of signs over the root of ``out_dim``; the sign of (i, j) is the parity of a linear hash."""
    def signed(j: int) -> Column:
        return F.transform(x, lambda a, i: a * (1 - 2 * (((i * 7919 + j * 104729 + seed * 31) % 101) % 2)))

    return F.array(*[total(signed(j)) / float(out_dim) ** 0.5 for j in range(out_dim)])


def padded(x: Column, dim: int) -> Column:
    """x with zeros up to ``dim``."""
    return F.when(F.size(x) >= dim, x).otherwise(F.concat(x, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), dim - F.size(x)))))
