"""Predictive models of a mention's identity.

Candidates are never crossed with mentions as rows.  A model gives each mention
an array of log weights over the candidates, from one vector per user (or one
for everyone); probabilities, ranks and top lists are read off in that row.
Vectors are as long as the identity list.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import DIMS
from ..functions.arrays import dense, let, patched, total
from ..functions.stats import EXP_FLOOR, log_sum_exp
from ..operators import coefficients as co

# -- vectors -------------------------------------------------------------------


def vector_of(long: DataFrame, size: Column, idx: str = "idx", value: str = "value", default: float = 0.0) -> Column:
    """Dense array of a long (idx, value) table as a scalar subquery.

    The table holds one row per identity of the list.
    """
    entries = F.collect_list(F.struct(F.col(idx).cast("int").alias("i"), F.col(value).alias("v")))
    one = long.agg(entries.alias("e")).withColumn("k", size)
    return one.select(dense(F.col("e"), F.col("k"), F.lit(default))).scalar()


def global_multinomial(counts: DataFrame, idx: str = "idx", n: str = "n") -> DataFrame:
    """(idx, p): total counts over their sum."""
    total = counts.select(F.sum(n)).scalar()
    return counts.groupBy(idx).agg(F.sum(n).alias("_n")).select(idx, (F.col("_n") / total).alias("p"))


def smoothed_user_multinomial(vectors: DataFrame, train: str = "train", alpha: float = 1.0) -> DataFrame:
    """Add ``p``: (n + alpha) / (sum + alpha * K) for every identity of the list."""
    vec = F.col(train)
    p = let(total(vec) + alpha * F.size(vec), lambda t: F.transform(vec, lambda x: (x + alpha) / t))
    return vectors.withColumn("p", p)


def user_sent_vectors(user_means: DataFrame, base: Column, rescale: float | None = 1.0, user: str = "user_id") -> DataFrame:
    """One row per user: the base vector with the user's own means, rescaled to ±rescale."""
    entries = F.collect_list(F.struct(F.col("idx").cast("int").alias("i"), F.col("val").alias("v")))
    own = user_means.groupBy(user).agg(entries.alias("_own")).withColumn("_base", base)
    out = own.select(user, patched(F.col("_base"), F.col("_own")).alias("vec"))
    return out.select(user, rescaled("vec", rescale).alias("vec")) if rescale else out


def rescaled(vec: str | Column, half_range: float) -> Column:
    vec = F.col(vec) if isinstance(vec, str) else vec
    bounds = F.struct(F.array_min(vec).alias("lo"), F.array_max(vec).alias("hi"))
    return let(
        bounds,
        lambda b: F.transform(vec, lambda v: (v - b["lo"]) * (2 * half_range) / (b["hi"] - b["lo"]) - half_range),
    )


# -- log weights ------------------------------------------------------------------


def log_weights(p: Column) -> Column:
    return F.transform(p, lambda x: F.log(x))


def distance_weights(vec: Column, score: Column, power: float = 1.0) -> Column:
    """Log weights -|v - s|^power of every candidate."""
    return F.transform(vec, lambda v: -F.pow(F.abs(v - score), F.lit(float(power))))


def deflection_weights(mentions: DataFrame, forms: DataFrame, vectors: DataFrame, vec: str = "vec", out: str = "weights") -> DataFrame:
    """Log weights minus the unit's deflection with the mention replaced by each
    candidate; null where no constraint of the unit holds the mention.

    ``forms`` is from `coefficients.target_forms`; ``vectors`` (user_id and
    ``vec``) holds the values of all candidates.  Mentions and forms meet on
    narrow rows; the vector of the user comes last.
    """
    rows = mentions.join(forms, ["unit_id", "user_id", "target"], "left")
    return form_weights(rows.join(vectors, "user_id"), vec, out)


def form_weights(rows: DataFrame, vec: str = "vec", out: str = "weights") -> DataFrame:
    """The same for rows that hold their form and the vector."""
    expr = co.form_deflection_sql([f"x.{d}" for d in DIMS])
    weights = F.expr(f"CASE WHEN k IS NOT NULL THEN transform({vec}, x -> -({expr})) END")
    return rows.withColumn(out, weights).drop(*co.FORM, "extra")


# -- scores of forms in blocks of a user ----------------------------------------

# Mentions of one user that a task holds at once, beside one vector.
BLOCK_ROWS = 8192

# Mentions times candidates that are evaluated at once.
CELLS = 1 << 16


def _form_scores(form: np.ndarray, vec: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability and rank of the truth; the terms are those of ``form_deflection_sql``, in its order."""
    log_prob, rank = np.empty(len(form)), np.empty(len(form))
    step, places = max(1, CELLS // len(vec)), np.arange(len(vec))
    for lo in range(0, len(form), step):
        f, t = form[lo : lo + step, :, None], truth[lo : lo + step, None]
        w = np.repeat(f[:, 9], len(vec), axis=1)
        for c, (i, j) in enumerate(co.FORM_PAIRS):
            term = f[:, c] * vec[:, i]
            term *= vec[:, j]
            w += term
        for i in range(3):
            w += f[:, 6 + i] * vec[:, i]
        np.negative(w, out=w)
        own, top = np.take_along_axis(w, t, 1), w.max(axis=1, keepdims=True)
        rank[lo : lo + step] = ((w > own) | ((w == own) & (places < t))).sum(1)
        w -= top
        log_prob[lo : lo + step] = (own - (top + np.log(np.exp(np.maximum(w, EXP_FLOOR, out=w)).sum(1, keepdims=True))))[:, 0]
    return log_prob, rank


def _scored_block(rows: pa.Table, vectors: pa.Table) -> pa.Table:
    """Mentions of one block of a user with their scores; one row of ``vectors``."""
    values = vectors["vec"].combine_chunks().flatten() if vectors.num_rows else None
    names = [c for c in rows.column_names if c not in co.FORM]
    if not rows.num_rows or values is None:
        log_prob, rank = np.empty(0), np.empty(0)
        rows = rows.slice(0, 0)
    else:
        vec = np.stack([values.field(d).to_numpy(zero_copy_only=False).astype(float) for d in DIMS], axis=1)
        form = np.stack([rows[c].to_numpy() for c in co.FORM], axis=1).astype(float)
        log_prob, rank = _form_scores(form, vec, rows["target"].to_numpy().astype(int))
    out = rows.select([c for c in names if c != "block"])
    return out.append_column("log_prob", pa.array(log_prob, from_pandas=True)).append_column("rank", pa.array(rank, from_pandas=True))


def scored_forms(forms: DataFrame, users: DataFrame, keys: list[str], vec: str = "vec", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, unit_id, target, log_prob, rank) of `coefficients.target_forms` without ``extra``.

    ``keys`` name a user; ``users`` has the vector of each once, ``struct<e, p, a>``
    of all candidates.  A user's mentions are dealt to blocks by their unit, as
    many as their number asks for, so the vector is copied to a block and not to
    a mention, and no task holds all mentions of a user.  ``forms`` are read twice.
    """
    counted = forms.groupBy(*keys).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_blocks"))
    block = F.pmod(F.xxhash64("unit_id"), F.col("_blocks")).cast("int")
    dealt = forms.join(counted, keys).select(*keys, "unit_id", "target", *co.FORM, block.alias("block"))
    held = users.join(counted, keys).select(*keys, F.col(vec).alias("vec"), F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"))
    # A number of its own: blocks are small but slow, and would be gathered into few tasks by their size.
    parts = int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    on = [*keys, "block"]
    both = [x.repartition(parts, *on).groupBy(*on) for x in (dealt, held)]
    kind = lambda c: forms.schema[c].dataType.simpleString()
    schema = ", ".join([*[f"`{c}` {kind(c)}" for c in [*keys, "unit_id", "target"]], "log_prob double", "rank double"])
    return both[0].cogroup(both[1]).applyInArrow(_scored_block, schema)


# -- reading off ------------------------------------------------------------------


def true_log_prob(weights: Column, truth: Column) -> Column:
    return F.get(weights, truth) - log_sum_exp(weights)


def true_rank(weights: Column, truth: Column) -> Column:
    """0-based place of the truth by descending weight; ties by candidate index."""
    own = F.get(weights, truth)
    return F.size(F.filter(weights, lambda w, i: (w > own) | ((w == own) & (i < truth))))


def top_candidates(weights: Column, k: int) -> Column:
    """Indices of the k heaviest candidates."""
    pairs = F.transform(weights, lambda w, i: F.struct((-w).alias("w"), i.alias("i")))
    return F.transform(F.slice(F.sort_array(pairs), 1, k), lambda p: p["i"])


def multinomial_log_lik(x: Column, p: Column) -> Column:
    """sum x log p; the count terms are added by `log_count_term`."""
    parts = F.zip_with(x, p, lambda a, b: F.when(a > 0, a * F.log(b)).otherwise(0.0))
    return F.aggregate(parts, F.lit(0.0), lambda s, v: s + v)


def log_count_term(df: DataFrame, x: str, out: str, key: str = "user_id") -> DataFrame:
    """log(n!) - sum log(x!) of a count vector; lgamma runs Arrow batch-wise on
    distinct counts only."""
    from ..functions.stats import lgamma

    sized = df.withColumn("_n", total(F.col(x)))
    values = sized.select(F.explode(F.concat(F.col(x), F.array("_n"))).alias("n")).distinct()
    table = values.select("n", lgamma(F.col("n") + 1).alias("g"))
    parts = sized.select(key, F.explode(x).alias("n")).groupBy(key, "n").agg(F.count("*").alias("c"))
    spent = parts.join(table, "n").groupBy(key).agg(F.sum(F.col("c") * F.col("g")).alias("_s"))
    whole = sized.join(table.withColumnRenamed("n", "_n"), "_n").join(spent, key)
    return whole.withColumn(out, F.col("g") - F.col("_s")).drop("_n", "g", "_s")
