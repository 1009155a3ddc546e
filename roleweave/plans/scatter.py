"""Moments of user vectors: partial matrices per partition, summed on executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FANOUT = 32


def _add_rows(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Row i of the centred cross product of all parts, from theirs and their means."""
    i, n = pdf["i"].iloc[0], pdf["n"].to_numpy(dtype=float)
    means = np.stack(pdf["mean"].to_numpy())
    mean = n @ means / n.sum()
    apart = means - mean
    out = pdf.iloc[:1].copy()
    out["n"] = pdf["n"].sum()
    out["mean"] = [mean]
    out["vec"] = [np.stack(pdf["vec"].to_numpy()).sum(0) + (n * apart[:, i]) @ apart]
    return out[[*keys, "n", "mean", "vec"]]


def moment_rows(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """(i, n, mean, vec): row i of the centred cross product, with the mean vector.

    Each partition reduces its vectors to one p x p matrix around its own mean;
    matrices are then merged row by row in two rounds, so no task sees all
    partitions, and nothing cancels where a mean is far from 0.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, mean, cross = 0, 0.0, 0.0
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["vec"].to_numpy()).astype(float)
                m = x.mean(0)
                apart, both = m - mean, n + len(x)
                cross = cross + (x - m).T @ (x - m) + np.outer(apart, apart) * (n * len(x) / both)
                n, mean = both, mean + apart * (len(x) / both)
        if n:
            part = TaskContext.get().partitionId() % FANOUT
            yield pd.DataFrame({"i": range(len(cross)), "part": part, "n": n, "mean": [mean] * len(cross), "vec": list(cross)})

    shape = "n long, mean array<double>, vec array<double>"
    parts = vectors.select(F.col(vec).alias("vec")).mapInPandas(partial, f"i int, part int, {shape}")
    first = parts.groupBy("i", "part").applyInPandas(lambda pdf: _add_rows(pdf, ["i", "part"]), f"i int, part int, {shape}")
    return first.groupBy("i").applyInPandas(lambda pdf: _add_rows(pdf, ["i"]), f"i int, {shape}")


def scatter_stats(vectors: DataFrame, vec: str = "vec") -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, centred cross product) on the driver; p x p numbers only."""
    pdf = moment_rows(vectors, vec).orderBy("i").toPandas()
    return int(pdf["n"].iloc[0]), np.asarray(pdf["mean"].iloc[0], dtype=float), np.stack(pdf["vec"].to_numpy())


def covariance(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """Long (i, j, cov) population covariance, without a visit to the driver."""
    rows = moment_rows(vectors, vec).select("i", "n", F.posexplode("vec").alias("j", "x"))
    return rows.select("i", "j", (F.col("x") / F.col("n")).alias("cov"))
