"""Column expressions over dense vectors stored as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(a: Column) -> Column:
    return a.cast("array<double>")


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """L2-normalised copy; a zero vector stays NULL-free as zeros."""
    n = norm(a)
    return F.transform(as_double(a), lambda v: F.coalesce(F.try_divide(v, n), F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def pair_features(img: Column, txt: Column) -> Column:
    """[img, txt, img*txt, |img-txt|] of two vectors (normalise them first)."""
    return F.concat(
        img,
        txt,
        F.zip_with(img, txt, lambda a, b: a * b),
        F.zip_with(img, txt, lambda a, b: F.abs(a - b)),
    )


def min_max(a: Column, eps: float = 1e-8) -> Column:
    lo, hi = F.array_min(a), F.array_max(a)
    return F.transform(
        a, lambda v: F.when(hi - lo < eps, F.lit(0.0)).otherwise((v - lo) / F.nullif(hi - lo, F.lit(0.0)))
    )


def standardize(a: Column, mean: float, std: float) -> Column:
    return F.transform(a, lambda v: (v - F.lit(mean)) / F.lit(std))


def value_range(a: Column) -> Column:
    return F.array_max(a) - F.array_min(a)
