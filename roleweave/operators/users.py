"""User shaping: count matrices, vectors and exports.  A user is never one object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import dense


def units_by_user(units: DataFrame, uid: str = "unit_id") -> DataFrame:
    """Split ``user \\t unit`` ids into ``user_id`` and ``unit_id``."""
    parts = F.split(uid, "\t")
    return units.withColumns({"user_id": parts[0], "unit_id": parts[1]})


def count_matrix(mentions: DataFrame, vocab: DataFrame, user: str = "user_id") -> DataFrame:
    """Long counts ``user_id, idx, split, n``; ``vocab`` maps identity to idx."""
    n = mentions.groupBy(user, "identity", "split").agg(F.count("*").alias("n"))
    return n.join(vocab, "identity").select(user, "idx", "split", "n")


def count_vectors(counts: DataFrame, size: Column, user: str = "user_id") -> DataFrame:
    """One row per user with dense ``train`` and ``test`` arrays.

    The counts are already one row per user and identity, so a group holds at
    most two entries per vocabulary word.
    """
    def entries(split: str) -> Column:
        e = F.struct(F.col("idx").cast("int").alias("idx"), F.col("n").cast("double").alias("n"))
        return F.collect_list(F.when(F.col("split") == split, e)).alias(f"_{split}")

    per = counts.groupBy(user).agg(entries("train"), entries("test")).withColumn("_k", size)
    zero = F.lit(0.0)
    return per.select(user, *[dense(F.col(f"_{s}"), F.col("_k"), zero).alias(s) for s in ("train", "test")])


def user_constraints(coefs: DataFrame, split: DataFrame, unit: str = "unit_id") -> DataFrame:
    """Long coefficients with the split of their unit: ``user, target, dim, split, c0, c1``."""
    return coefs.join(split.select(unit, "split"), unit)


def unit_text_export(units: DataFrame) -> DataFrame:
    """``user_id, ids, text`` of training units."""
    return units.where(F.col("split") == "train").select("user_id", F.array_join("identities", ",").alias("ids"), "text")
