"""Gaussian kernel densities at the points themselves, by tiles (a fast Gauss transform).

In units of the bandwidth the plane is cut into tiles of side ``SIDE``.  The
points of a tile become the moments of a Hermite expansion about its centre;
the expansions of all tiles within reach are turned into one Taylor expansion
about the centre of a target tile; a point evaluates that of its tile.  Moments
add up, so tiles are summed before they are shuffled; tiles meet in blocks of
bounded size; no pair of points is ever formed.

By Cramer's inequality a kernel of height 1 is met within ``error_bound()``, so a
density is within ``error_bound() / (2 pi hx hy)`` of the exact sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import exact_quantiles

SIDE = 0.5
TERMS = 14
REACH = 15  # tiles on each side
BLOCK = 32  # tiles along a side of a block

CRAMER = 1.0866


def error_bound(side: float = SIDE, terms: int = TERMS, reach: int = REACH) -> float:
    """Largest error of a kernel of height 1: both expansions cut off, and tiles out of reach left out."""
    half, many = side / 2, range(terms, terms + 60)
    one = CRAMER * sum(half**j / sqrt(factorial(j)) for j in many)
    grown = [(sqrt(2) * half) ** j / sqrt(factorial(j)) for j in range(terms + 60)]
    two = CRAMER * sum(grown[:terms]) * sum(grown[terms:])
    each = one + two  # of one coordinate; the other is at most 1 and off by as much
    return each * (2 + each) + exp(-0.5 * (reach * side) ** 2)


def _bandwidth(df: DataFrame, by: str, col: str) -> DataFrame:
    """Normal-reference bandwidth from quartiles, deviation and count."""
    q = exact_quantiles(df, [by], col, [0.25, 0.75]).groupBy(by).agg(
        F.min(F.when(F.col("prob") == 0.25, F.col("quantile"))).alias("_q1"),
        F.min(F.when(F.col("prob") == 0.75, F.col("quantile"))).alias("_q3"),
    )
    m = df.groupBy(by).agg(F.stddev_samp(col).alias("_sd"), F.count("*").alias("n"), F.min(col).alias(f"lo{col}"))
    h = 4 * 1.06 * F.least("_sd", (F.col("_q3") - F.col("_q1")) / 1.34) * F.pow(F.col("n"), F.lit(-0.2)) / 4
    return m.join(q, by).select(by, h.alias(f"h{col}"), f"lo{col}", "n")


def _powers(x: np.ndarray) -> np.ndarray:
    return x[:, None] ** np.arange(TERMS)


def _moments(kind: str):
    """Moments of the tiles of a batch: sums of dx^j dy^k / (j! k!)."""
    scale = 1 / np.array([factorial(j) for j in range(TERMS)], float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf.sort_values(["g", "i", "j"], ignore_index=True)
            tile = pdf[["g", "i", "j"]]
            begin = np.flatnonzero((tile != tile.shift()).any(axis=1).to_numpy())
            px, py = _powers(pdf["dx"].to_numpy()) * scale, _powers(pdf["dy"].to_numpy()) * scale
            sums = [px[a:b].T @ py[a:b] for a, b in zip(begin, np.append(begin[1:], len(pdf)))]
            out = tile.iloc[begin].copy()
            out["m"] = pd.Series([s.reshape(-1) for s in sums], dtype=object, index=out.index)
            yield out

    return run


def _hermite(t: np.ndarray) -> np.ndarray:
    """He_j(t) exp(-t^2 / 2) for j below 2 TERMS."""
    h = np.zeros((2 * TERMS, len(t)))
    h[0] = np.exp(-0.5 * t * t)
    h[1] = t * h[0]
    for j in range(2, 2 * TERMS):
        h[j] = t * h[j - 1] - (j - 1) * h[j - 2]
    return h


def _shifts() -> np.ndarray:
    """For each distance of tiles the matrix from moments to Taylor coefficients of one coordinate."""
    h = _hermite(np.arange(-REACH, REACH + 1) * SIDE)
    j, m = np.arange(TERMS)[:, None], np.arange(TERMS)[None, :]
    sign = (-1.0) ** m / np.array([factorial(int(x)) for x in range(TERMS)], float)[None, :]
    return np.moveaxis(h[j + m], 2, 0) * sign


def _local(pdf: pd.DataFrame) -> pd.DataFrame:
    """Taylor coefficients of the tiles of one block from the moments of the tiles in its reach."""
    shifts = _shifts()
    bi, bj = int(pdf["bi"].iat[0]), int(pdf["bj"].iat[0])
    size = BLOCK + 2 * REACH
    i, j = (pdf[c].to_numpy() - b * BLOCK + REACH for c, b in (("i", bi), ("j", bj)))
    grid = np.zeros((size, size, TERMS, TERMS))
    i, j = i.astype(int), j.astype(int)
    grid[i, j] = np.stack(pdf["m"].to_numpy()).reshape(-1, TERMS, TERMS)
    rows = np.flatnonzero(np.bincount(i, minlength=size))
    along = np.zeros((size, BLOCK, TERMS, TERMS))
    for d in range(-REACH, REACH + 1):  # a target tile d places after its source
        along[rows] += (grid[rows, REACH - d : REACH - d + BLOCK].reshape(-1, TERMS) @ shifts[d + REACH]).reshape(len(rows), BLOCK, TERMS, TERMS)
    turned = np.ascontiguousarray(along.swapaxes(2, 3))
    out = np.zeros((BLOCK, BLOCK, TERMS, TERMS))
    for d in range(-REACH, REACH + 1):
        out += (turned[REACH - d : REACH - d + BLOCK].reshape(-1, TERMS) @ shifts[d + REACH]).reshape(out.shape)
    out = out.swapaxes(2, 3)
    own = (i >= REACH) & (i < REACH + BLOCK) & (j >= REACH) & (j < REACH + BLOCK)
    found = pdf.loc[own, ["g", "i", "j"]].copy()
    found["c"] = pd.Series([x.reshape(-1) for x in out[i[own] - REACH, j[own] - REACH]], dtype=object, index=found.index)
    return found


def _evaluate(c: pd.Series, dx: pd.Series, dy: pd.Series) -> pd.Series:
    known = c.notna().to_numpy()
    out = np.full(len(c), np.nan)
    if known.any():
        table = np.stack(c[known].to_numpy()).reshape(-1, TERMS, TERMS)
        out[known] = np.einsum("nj,njk,nk->n", _powers(dx[known].to_numpy()), table, _powers(dy[known].to_numpy()))
    return pd.Series(out)


def density_at_points(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """Add ``density``: at each point the mean Gaussian kernel of its group's points, over the area.

    Null where a group has no spread in x or y, or the point or its group is null.
    """
    points = df.select(F.col(by).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    points = points.where("x IS NOT NULL AND y IS NOT NULL AND g IS NOT NULL")
    frame = _bandwidth(points, "g", "x").join(_bandwidth(points, "g", "y").drop("n"), "g").where("hx > 0 AND hy > 0")

    def placed(rows: DataFrame) -> DataFrame:
        tile = lambda c: F.floor((F.col(c) - F.col(f"lo{c}")) / F.col(f"h{c}") / SIDE).cast("long")
        rows = rows.withColumns({"i": tile("x"), "j": tile("y")})
        off = lambda c, t: (F.col(c) - F.col(f"lo{c}")) / F.col(f"h{c}") - (F.col(t) + 0.5) * SIDE
        return rows.withColumns({"dx": off("x", "i"), "dy": off("y", "j")})

    kind = points.schema["g"].dataType.simpleString()
    tiled = placed(points.join(frame, "g")).select("g", "i", "j", "dx", "dy")
    parts = tiled.mapInPandas(_moments(kind), f"g {kind}, i long, j long, m array<double>")
    total = F.array(*[F.sum(F.col("m")[k]) for k in range(TERMS * TERMS)])
    tiles = parts.groupBy("g", "i", "j").agg(total.alias("m"))
    # A tile goes to each block that holds a tile in its reach.
    blocks = lambda t: F.sequence(F.floor((F.col(t) - REACH) / BLOCK).cast("long"), F.floor((F.col(t) + REACH) / BLOCK).cast("long"))
    spread = tiles.withColumn("bi", F.explode(blocks("i"))).withColumn("bj", F.explode(blocks("j")))
    local = spread.groupBy("g", "bi", "bj").applyInPandas(_local, f"g {kind}, i long, j long, c array<double>")
    at = df.select(F.struct(*df.columns).alias("_row"), F.col(by).alias("g"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    at = placed(at.join(frame, "g", "left")).join(local, ["g", "i", "j"], "left")
    value = F.pandas_udf(_evaluate, "double")("c", "dx", "dy") / (2 * np.pi * F.col("n") * F.col("hx") * F.col("hy"))
    return at.select("_row.*", F.when(F.col("c").isNotNull(), value).alias("density"))
