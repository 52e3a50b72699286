"""Numeric Column helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """``c`` as a double, or null where it is no finite number."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; null for a whole of 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def scaled(c: Column, scale: float = 1.0, digits: int = 4) -> Column:
    """A finite number scaled and rounded half to even, for display."""
    return F.bround(finite(c) * scale, digits)


def first_number(*candidates: Column) -> Column:
    """The first candidate that is a finite number."""
    return F.coalesce(*map(finite, candidates))


def logistic(z: Column) -> Column:
    """1 / (1 + exp(-z)) without overflow."""
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def weighted_present(parts: list[tuple[float, Column]]) -> Column:
    """Weighted mean over the parts that are present; weights are renormalised over them."""
    add = lambda a, b: a + b
    total = reduce(add, (F.when(c.isNotNull(), w * c).otherwise(0.0) for w, c in parts))
    return F.try_divide(total, reduce(add, (F.when(c.isNotNull(), F.lit(w)).otherwise(0.0) for w, c in parts)))


def noisy_or(probabilities: Column) -> Column:
    """1 - product of (1 - p) over an array."""
    return 1 - F.aggregate(probabilities, F.lit(1.0), lambda acc, p: acc * (1 - p))


def f1_or_null(precision: Column, recall: Column) -> Column:
    return F.try_divide(2 * precision * recall, precision + recall)


def f1_or_zero(precision: Column, recall: Column) -> Column:
    return F.coalesce(f1_or_null(precision, recall), F.lit(0.0))


def similarity(a: Column, b: Column, top: float = 255.0) -> Column:
    """Structural similarity of two equally long arrays of grey values, over all of them at once; null for other lengths.

    The two constants are the usual shares 0.01 and 0.03 of the greatest value, squared.
    """
    add = lambda acc, v: acc + v
    mean = lambda x: F.aggregate(x, F.lit(0.0), add) / F.size(x)
    ma, mb = mean(a), mean(b)
    moment = lambda x, y, mx, my: mean(F.zip_with(x, y, lambda p, q: (p - mx) * (q - my)))
    light, contrast = (0.01 * top) ** 2, (0.03 * top) ** 2
    value = (2 * ma * mb + light) * (2 * moment(a, b, ma, mb) + contrast) / ((ma * ma + mb * mb + light) * (moment(a, a, ma, ma) + moment(b, b, mb, mb) + contrast))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.greatest(F.least(value, F.lit(1.0)), F.lit(-1.0)))
