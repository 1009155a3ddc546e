"""Aggregations.  Global figures enter rows as scalar subqueries, not joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import BIAS, SCALE
from ..session import materialize


def sum_count_by(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(value).alias("total"), F.count(value).alias("n"))


def mean_by_key(df: DataFrame, keys: list[str], value: str = "value", out: str = "val") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(out))


def mean_of_means(per_user: DataFrame, key: str = "identity", value: str = "val") -> DataFrame:
    """Unweighted mean over users of the per-user mean."""
    return per_user.groupBy(key).agg(F.avg(value).alias("mean_val"))


def mean_of_ratios(df: DataFrame, keys: list[str], total: str = "total", n: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.col(total) / F.col(n)).alias("value"))


def bias_scale(df: DataFrame, dim: str = "dim", value: str = "value", out: str = "scaled") -> DataFrame:
    """(value - offset) * 4.3 / max|value| per dimension; the max is of unshifted values.

    Three groups only, so the maxima are found by a combining aggregate and
    joined back instead of windowed.
    """
    peak = df.groupBy(dim).agg(F.max(F.abs(value)).alias("_peak"))
    offset = F.lit(None).cast("double")
    for d, o in BIAS.items():
        offset = F.when(F.col(dim) == d, F.lit(o)).otherwise(offset)
    joined = df.join(peak, dim)
    return joined.withColumn(out, (F.col(value) - offset) * SCALE / F.col("_peak")).drop("_peak")


def support_by_word(df: DataFrame, word: str = "word", n: str = "n") -> DataFrame:
    return df.groupBy(word).agg((F.sum(n) / 3).alias("support"))


def minmax_rescale(df: DataFrame, cols: list[str], half_range: float = SCALE) -> DataFrame:
    """Each column to [-half_range, half_range] by its global range; the input is written once, as it is read twice."""
    df = materialize(df, "rescaled")
    bounds = df.select(
        F.struct(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    ).scalar()
    out = df.withColumn("_b", bounds)
    for c in cols:
        lo, hi = F.col(f"_b.lo_{c}"), F.col(f"_b.hi_{c}")
        out = out.withColumn(c, (F.col(c) - lo) * (2 * half_range) / (hi - lo) - half_range)
    return out.drop("_b")


def group_mean_skipna(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Means that skip nulls and NaN."""
    return df.groupBy(key).agg(
        *[F.avg(F.when(~F.isnan(F.col(v).cast("double")), F.col(v))).alias(v) for v in values]
    )


def zscore_diff(df: DataFrame, a: str, b: str) -> DataFrame:
    """Population z-scores of two columns and their absolute difference; the input is written once, as it is read twice."""
    df = materialize(df, "scored")
    m = df.select(
        F.struct(
            F.avg(a).alias("ma"), F.stddev_pop(a).alias("sa"), F.avg(b).alias("mb"), F.stddev_pop(b).alias("sb")
        )
    ).scalar()
    out = df.withColumn("_m", m)
    za = (F.col(a) - F.col("_m.ma")) / F.col("_m.sa")
    zb = (F.col(b) - F.col("_m.mb")) / F.col("_m.sb")
    return out.select(*df.columns, za.alias(f"z_{a}"), zb.alias(f"z_{b}"), F.abs(za - zb).alias("diffv"))


def shrunk_mean(user_values: DataFrame, base: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(sum over users + base) / (count + 1); base where no user has a value."""
    sums = user_values.groupBy(*keys).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    joined = base.select(*keys, F.col(value).alias("_b")).join(sums, keys, "left")
    c = F.coalesce("_c", F.lit(0))
    return joined.select(*keys, ((F.coalesce("_s", F.lit(0.0)) + F.col("_b")) / (c + 1)).alias(value), c.alias("n_users"))


def margin(counts: DataFrame, key: str, value: str = "n", floor: float = 175.0) -> DataFrame:
    """Sums along one side of a count matrix with their logs."""
    s = F.col("total")
    sums = counts.groupBy(key).agg(F.sum(value).alias("total"))
    return sums.withColumn("log_total", F.log(s)).withColumn("log_above", F.when(s > floor, F.log(s - floor)))


def margin_summary(margins: DataFrame, value: str = "total") -> DataFrame:
    """min, median, max and population deviation of one margin (one row)."""
    from .ranking import exact_quantiles

    middle = exact_quantiles(margins, [], value, [0.5]).select("quantile").scalar()
    return margins.agg(
        F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_pop(value).alias("sd")
    ).withColumn("median", middle)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias("n"))


def concat_by_group(df: DataFrame, key: str, name: str = "name", sep: str = ", ") -> DataFrame:
    """Names of a cluster joined in order; for vocabulary-sized tables."""
    return df.groupBy(key).agg(F.array_join(F.sort_array(F.collect_set(name)), sep).alias("names"))


def pool_counters(per_user: DataFrame, keys: list[str], values: list[str], n_obs: str = "n_obs") -> DataFrame:
    """Key-wise sums over users divided by the number of observations."""
    sums = per_user.groupBy(*keys).agg(
        *[F.sum(v).alias(v) for v in values], F.sum(n_obs).alias(n_obs)
    )
    return sums.select(*keys, *[(F.col(v) / F.col(n_obs)).alias(v) for v in values], n_obs)


def distinct_sets(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*cols).distinct()


def mean_rank_by_model(results: DataFrame) -> DataFrame:
    return results.groupBy("model").agg(F.avg("rank").alias("mean_rank"))


def relative_gain(results: DataFrame, ours: str, baseline: str, value: str, run: str = "run") -> DataFrame:
    """Per run ``|ours - baseline| / baseline`` and the signed form."""
    wide = results.groupBy(run).pivot("model", [ours, baseline]).agg(F.avg(value))
    a, b = F.col(ours), F.col(baseline)
    return wide.select(run, (F.abs(a - b) / b).alias("gain"), ((a - b) / b).alias("signed_gain"))


def unpivot_measures(df: DataFrame, ids: list[str], measures: list[str], var: str = "variable", val: str = "value") -> DataFrame:
    """Several measures to long form."""
    return df.unpivot(ids, measures, var, val)


def spread(df: DataFrame, ids: list[str], key: str, value: str, levels: list[str]) -> DataFrame:
    """Long form to one column per level."""
    return df.groupBy(*ids).pivot(key, levels).agg(F.first(value))
