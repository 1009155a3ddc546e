"""Small helpers for array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Needed where the body holds a lambda: an expression inside a lambda is
    evaluated again for every element.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def total(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x)


def dense(entries: Column, size: Column, default: Column) -> Column:
    """Array of the given length from (index, value) entries."""
    return let(
        F.map_from_entries(entries),
        lambda m: F.transform(
            F.sequence(F.lit(0), size.cast("int") - 1), lambda i: F.coalesce(F.try_element_at(m, i), default)
        ),
    )


def patched(base: Column, entries: Column) -> Column:
    """The base array with the (index, value) entries put over it."""
    return let(
        F.map_from_entries(entries),
        lambda m: F.transform(base, lambda b, i: F.coalesce(F.try_element_at(m, i), b)),
    )
