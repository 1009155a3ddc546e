"""Numeric columns: stable exponentials, similarities and likelihood pieces."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import let, total

# Fixed value: exponents are clamped from below here.
EXP_FLOOR = -300.0


def compound(total: Column, alpha: float = 15.0) -> Column:
    """Normalise a valence sum to (-1, 1)."""
    return total / F.sqrt(total * total + F.lit(float(alpha)))


def softmax(vec: Column) -> Column:
    """Softmax of an array, shifted by its largest entry."""
    shifted = let(F.array_max(vec), lambda top: F.transform(vec, lambda x: F.exp(x - top)))
    return let(shifted, lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def log_sum_exp(vec: Column) -> Column:
    def shifted_sum(top: Column) -> Column:
        return F.aggregate(vec, F.lit(0.0), lambda s, x: s + F.exp(F.greatest(x - top, F.lit(EXP_FLOOR))))

    return let(F.array_max(vec), lambda top: top + F.log(shifted_sum(top)))


def _shifted(a: Column, b: Column) -> tuple[Column, Column, Column]:
    top = F.greatest(a, b)
    floor = F.lit(EXP_FLOOR)
    return top, F.exp(F.greatest(a - top, floor)), F.exp(F.greatest(b - top, floor))


def log_add(a: Column, b: Column) -> Column:
    """log(exp a + exp b)."""
    top, ea, eb = _shifted(a, b)
    return top + F.log(ea + eb)


def log_sub(a: Column, b: Column) -> Column:
    """log(exp a - exp b); the larger argument where the difference is not positive."""
    top, ea, eb = _shifted(a, b)
    return F.when(ea - eb <= 0, top).otherwise(top + F.log(ea - eb))


def _lgamma(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    fn = np.frompyfunc(math.lgamma, 1, 1)
    for batch in values:
        yield pd.Series(fn(batch.to_numpy(dtype=float)).astype(float), index=batch.index)


def lgamma(value: Column) -> Column:
    """Natural log of the gamma function, Arrow batch at a time."""
    return F.pandas_udf(_lgamma, T.DoubleType())(value)


def euclid_similarity(left: list[Column], right: list[Column]) -> Column:
    dist = sum(((a - b) * (a - b) for a, b in zip(left, right)), F.lit(0.0))
    return 1 / (1 + F.sqrt(dist))


def bhattacharyya_similarity(m1: Column, m2: Column, v1: Column, v2: Column) -> Column:
    """1/(1+sqrt(D)) with D the distance of two normals given by mean and variance."""
    v = (v1 + v2) / 2
    dist = (m1 - m2) * (m1 - m2) / (8 * v) + 0.5 * F.log(v / F.sqrt(v1 * v2))
    return 1 / (1 + F.sqrt(F.greatest(dist, F.lit(0.0))))


def mean_shift(mu: Column, mu0: Column) -> tuple[Column, Column]:
    return mu - mu0, F.abs(mu - mu0)


def interval(mu: Column, sigma: Column) -> tuple[Column, Column]:
    return mu - sigma, mu + sigma


def max_abs(values: Column) -> Column:
    """Entry of largest magnitude, first wins; 0 if all are 0, null if empty."""
    return F.when(
        F.size(values) > 0,
        F.aggregate(values, F.lit(0.0), lambda acc, x: F.when(F.abs(x) > F.abs(acc), x).otherwise(acc)),
    )
