"""Row filters and small projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import DIMS
from ..session import materialize


def filter_candidate_units(
    units: DataFrame, words: DataFrame, unit: str = "unit_id", tokens: str = "tokens", word: str = "term"
) -> DataFrame:
    """Units of more than four tokens that hold a word of the list (or word+s).

    Multiword entries count by their parts.  A repost flag column, if present,
    drops reposts.
    """
    parts = words.select(F.explode(F.split(word, " ")).alias("_w")).distinct()
    kept = units.where(F.size(tokens) > 4)
    if "reposted" in units.columns:
        kept = kept.where(~F.col("reposted"))
    token = F.explode(F.array_distinct(F.col(tokens)))
    seen = kept.select(unit, token.alias("_t"))
    forms = F.array_compact(F.array(F.col("_t"), F.when(F.col("_t").endswith("s"), F.expr("left(_t, length(_t) - 1)"))))
    hits = seen.select(unit, F.explode(forms).alias("_w")).join(parts, "_w", "left_semi").select(unit).distinct()
    return kept.join(hits, unit, "left_semi")


def filter_labelled_units(tokens: DataFrame, unit: str = "unit_id", label: str = "label") -> DataFrame:
    """All tokens of the units in which some token label is not ``O``."""
    labelled = tokens.where(F.col(label) != "O").select(unit).distinct()
    return tokens.join(labelled, unit, "left_semi")


def filter_units_with_identity(units: DataFrame, identities: str = "identities") -> DataFrame:
    return units.where(F.size(identities) > 0)


def filter_min_units(units: DataFrame, n: int, user: str = "user_id") -> DataFrame:
    """Units of users with at least n units; counting combines before the shuffle."""
    enough = units.groupBy(user).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).select(user)
    return units.join(enough, user, "left_semi")


def filter_min_mentions(counts: DataFrame, n: float, user: str = "user_id", value: str = "n") -> DataFrame:
    """Counts of users whose total is strictly above n."""
    enough = counts.groupBy(user).agg(F.sum(value).alias("_n")).where(F.col("_n") > n).select(user)
    return counts.join(enough, user, "left_semi")


def search_units(units: DataFrame, keyword: str, lines: str = "lines") -> DataFrame:
    return units.where(F.exists(F.col(lines), lambda x: F.contains(x, F.lit(keyword))))


def rename_and_cast(df: DataFrame, names: dict[str, str], doubles: list[str]) -> DataFrame:
    """Select and rename; the listed source columns become doubles."""
    return df.select(
        *[F.col(old).cast("double").alias(new) if old in doubles else F.col(old).alias(new) for old, new in names.items()]
    )


def split_block_code(code: Column) -> dict[str, Column]:
    """Parts of a 15-digit area code."""
    return {
        "state": F.substring(code, 1, 2),
        "county": F.substring(code, 3, 3),
        "tract": F.substring(code, 6, 6),
        "block_group": F.substring(code, 12, 1),
        "block": F.substring(code, 13, 3),
    }


def filter_positive(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col) > 0)


def assign_cells(df: DataFrame, num: str, category: str, levels: tuple[str, str], out: str = "cell") -> DataFrame:
    """2x2 cells 1-4: above / at-or-below the global mean by two levels; else 0."""
    df = materialize(df, "cells")  # read twice
    mean = df.select(F.avg(num)).scalar()
    high = F.col(num) > mean
    first, second = (F.col(category) == lv for lv in levels)
    cell = (
        F.when(high & first, 1).when(high & second, 2).when(~high & first, 3).when(~high & second, 4).otherwise(0)
    )
    return df.withColumn(out, cell)


def split_label(label: Column) -> tuple[Column, Column]:
    """(id, dim) of an id+dim label."""
    return F.substring(label, F.lit(1), F.length(label) - 1), F.right(label, F.lit(1))


def join_label(name: Column, dim: Column) -> Column:
    return F.concat_ws("_", name, dim)


def filter_names(df: DataFrame, names: DataFrame, col: str = "name", drop_dim: str | None = None) -> DataFrame:
    """Rows whose name is in the list, without one dimension if asked."""
    out = df.join(names.select(col).distinct(), col, "left_semi")
    return out.where(F.col("dim") != drop_dim) if drop_dim else out


def filter_dim(df: DataFrame, dim: str, col: str = "dim") -> DataFrame:
    if dim not in DIMS:
        raise ValueError(dim)
    return df.where(F.col(col) == dim)


def recode(value: Column, labels: dict[str, str], default: Column | None = None) -> Column:
    """Relabel listed levels; others keep ``default`` (the value itself if not given)."""
    out = None
    for level, name in labels.items():
        out = F.when(value == level, name) if out is None else out.when(value == level, name)
    return out.otherwise(value if default is None else default)


def label_where(cond: Column, name: Column) -> Column:
    """The name where the condition holds, else null."""
    return F.when(cond, name)


def drop_weak(pairs: DataFrame, eps: float = 0.01, a: str = "name", b: str = "variable", value: str = "value") -> DataFrame:
    """Drop the diagonal, nulls, NaN and values smaller than eps."""
    v = F.col(value)
    return pairs.where((F.col(a) != F.col(b)) & v.isNotNull() & ~F.isnan(v) & (F.abs(v) >= eps))


def filter_extremes(
    mentions: DataFrame, no_below: int, identity: str = "identity", user: str = "user_id"
) -> DataFrame:
    """Mentions of identities seen by at least ``no_below`` users."""
    pairs = mentions.select(identity, user).distinct()
    kept = pairs.groupBy(identity).agg(F.count("*").alias("_n")).where(F.col("_n") >= no_below).select(identity)
    return mentions.join(kept, identity, "left_semi")
