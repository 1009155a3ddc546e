"""Joins and set operations.

No side is broadcast by hint: the planner compares the side's known size (file
size, or the size measured at run time by AQE) with its threshold and else
shuffles, splitting hot partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GEO_KEYS = ["state", "county", "tract", "block_group"]


def join_geo(users: DataFrame, areas: DataFrame) -> DataFrame:
    """Inner join on the four area keys."""
    return users.join(areas, GEO_KEYS, "inner")


def join_user_attr(users: DataFrame, attrs: DataFrame, user: str = "uid") -> DataFrame:
    return users.join(attrs, user, "inner")


def join_identity_names(df: DataFrame, names: DataFrame, key: str = "identity_id") -> DataFrame:
    return df.join(names, key, "inner")


def natural_join(left: DataFrame, right: DataFrame) -> DataFrame:
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("natural join needs a shared column")
    return left.join(right, shared)


def merge_lexicons(left: DataFrame, right: DataFrame, key: str = "term") -> DataFrame:
    """Both sides: mean of the two; one side only: kept as is."""
    values = [c for c in left.columns if c != key]
    l = left.select(key, *[F.col(c).alias(f"_l_{c}") for c in values])
    r = right.select(key, *[F.col(c).alias(f"_r_{c}") for c in values])

    def merged(c: str) -> Column:
        a, b = F.col(f"_l_{c}"), F.col(f"_r_{c}")
        both = F.col("_in_l").isNotNull() & F.col("_in_r").isNotNull()
        return F.when(both, (a + b) / 2).when(F.col("_in_l").isNotNull(), a).otherwise(b).alias(c)

    both = l.withColumn("_in_l", F.lit(1)).join(r.withColumn("_in_r", F.lit(1)), key, "full")
    return both.select(key, *[merged(c) for c in values])


def semi_join(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.join(known.select(key), key, "left_semi")


def anti_join(df: DataFrame, words: DataFrame, key: str = "term") -> DataFrame:
    return df.join(words.select(key), key, "left_anti")


def pairwise_enrich(pairs: DataFrame, attrs: DataFrame, name: str = "name", a: str = "name", b: str = "variable") -> DataFrame:
    """Join attributes to both ends of a pair, suffixes ``N`` and ``V``."""
    cols = [c for c in attrs.columns if c != name]
    first = attrs.select(F.col(name).alias(a), *[F.col(c).alias(f"{c}N") for c in cols])
    second = attrs.select(F.col(name).alias(b), *[F.col(c).alias(f"{c}V") for c in cols])
    return pairs.join(first, a).join(second, b)


def left_join_default(
    values: DataFrame, keys: list[str], user_values: DataFrame, population: DataFrame, default: Column, col: str = "value"
) -> DataFrame:
    """User value, else population value, else a constant.

    ``keys`` names the identity keys shared by all three; the user column is
    what ``values`` and ``user_values`` share beyond them.
    """
    user_keys = [c for c in values.columns if c in user_values.columns and c != col]
    u = user_values.select(*user_keys, F.col(col).alias("_u"))
    p = population.select(*keys, F.col(col).alias("_p"))
    joined = values.join(u, user_keys, "left").join(p, keys, "left")
    return joined.withColumn(col, F.coalesce("_u", "_p", default)).drop("_u", "_p")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def term_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def term_except(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def term_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def ordered_distinct(array: Column) -> Column:
    """Distinct entries in order of first appearance."""
    return F.array_distinct(array)
