"""Ranks, indices, quantiles, splits and top-k that hold up under hot keys.

A plain ``row_number() over (partition by user ...)`` puts a hot user's rows in
one task.  Here a hot group is first cut into buckets that follow the sort
order; bucket counts are small and give each bucket its offset, and only the
rows of one bucket are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, materialize

BINS = 256


def bucketed_row_number(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column, out: str = "rn", total: str | None = None
) -> DataFrame:
    """1-based rank per ``keys`` by ``order``, and the key's row count.

    ``bucket`` must not decrease along ``order``: only one bucket's rows are
    sorted together, and bucket counts, which are small, give its offset.  Null
    keys are a key like any other.
    """
    # One struct as the key: equal with null fields, and the join reuses the window's shuffle.
    tagged = df.withColumn("_group", F.struct(*keys, bucket.alias("_bucket")))
    counts = tagged.groupBy("_group").agg(F.count("*").alias("_n"))
    key = [F.col(f"_group.`{k}`") for k in keys]
    before = Window.partitionBy(*key).orderBy("_group._bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"), F.sum("_n").over(Window.partitionBy(*key)).alias("_total")
    )
    local = tagged.withColumn("_rn", F.row_number().over(Window.partitionBy("_group").orderBy(*order)))
    ranked = local.join(offsets, "_group")
    cols = [*df.columns, (F.col("_offset") + F.col("_rn")).alias(out)]
    if total:
        cols.append(F.col("_total").alias(total))
    return ranked.select(*cols)


def stable_index(terms: DataFrame, col: str, out: str = "idx", prefix: str | None = None) -> DataFrame:
    """Dense 0-based index of distinct terms, in order of their md5.

    The first hash digits are evenly filled buckets, so numbering a large
    vocabulary never sorts it in one task, and the index does not depend on
    file or partition order.
    """
    distinct = terms.select(col).where(F.col(col).isNotNull()).distinct()
    hashed = distinct.withColumn("_h", F.md5(F.col(col).cast("string")))
    ranked = bucketed_row_number(hashed, [], ["_h"], F.substring("_h", 1, 3), out)
    index = F.col(out) - 1
    named = F.concat(F.lit(prefix), index.cast("string")) if prefix else index
    return ranked.select(col, named.alias(out))


def split_train_test(
    units: DataFrame,
    frac: float,
    user: str = "user_id",
    order: list[str] | None = None,
    bucket: Column | None = None,
    unit: str = "unit_id",
    seed: int | None = None,
    off_by_one: bool = True,
) -> DataFrame:
    """Per user, ``n_test = int(frac * n)``; the first units train, the rest test.

    With ``off_by_one`` the train part takes one unit more, as published
    results did.  A seed replaces the order by a hash shuffle.
    """
    if seed is not None:
        units = units.withColumn("_shuffle", F.xxhash64(F.lit(seed), F.col(unit)))
        order = ["_shuffle", unit]
        bucket = F.shiftright(F.col("_shuffle"), 52)
    ranked = bucketed_row_number(units, [user], order, bucket, "_rn", "_n")
    n_test = F.floor(F.lit(frac) * F.col("_n"))
    n_train = F.col("_n") - n_test + (1 if off_by_one else 0)
    split = F.when(F.col("_rn") <= n_train, "train").otherwise("test")
    return ranked.withColumn("split", split).drop("_rn", "_n", "_shuffle")


def balanced_bins(rows: DataFrame, key: str, value: str, bins: int = BINS) -> DataFrame:
    """Add ``_bin``, which follows the order of ``value`` and holds about as many rows as any other bin of the key.

    Borders come from a mergeable quantile sketch of each key, so a long tail
    fills no bin more than another.  ``bins`` is a power of two.
    """
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    borders = rows.groupBy(key).agg(F.percentile_approx(value, shares, 8 * bins).alias("_borders"))
    depth = bins.bit_length() - 1

    def halve(at: Column, step: Column) -> Column:
        width = F.element_at(F.array(*[F.lit(bins >> (i + 1)) for i in range(depth)]), step + 1)
        return F.when(F.get("_borders", at + width - 1) <= F.col(value), at + width).otherwise(at)

    place = F.aggregate(F.sequence(F.lit(0), F.lit(depth - 1)), F.lit(0), halve)
    return rows.join(borders, key).withColumn("_bin", place).drop("_borders")


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], bins: int = BINS, small: int = 200_000
) -> DataFrame:
    """Exact interpolated quantiles per key: columns ``keys, prob, quantile``.

    Equal values are counted together first.  While a group of values is not
    ``small``, it is cut into balanced bins, exact counts tell which bins hold
    the wanted ranks, and only those go on; the rest is a window over small
    groups.  Null values do not count; null keys are a key like any other.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.struct(*keys, F.lit(0).alias("_all")).alias("_k"), F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    rows = materialize(counts.withColumn("_g", F.struct("_k", F.lit("").alias("path"))), "values")
    ranks = F.array(*[F.struct(F.lit(float(p)).alias("prob"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("pos")) for p in probs])
    wanted = rows.groupBy("_g").agg(F.sum("_c").alias("_n")).select("_g", F.explode(ranks).alias("_r"))
    wanted = wanted.select(
        "_g", F.col("_r.prob").alias("prob"), F.col("_r.pos").alias("_pos"),
        F.explode(F.array_distinct(F.array(F.floor("_r.pos"), F.ceil("_r.pos")))).alias("_rank"),
    )
    wanted = materialize(wanted.withColumn("_rel", F.col("_rank")), "ranks")
    while True:
        largest = rows.groupBy("_g").agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0]
        if largest is None or largest <= small:
            break
        binned = materialize(balanced_bins(rows, "_g", "_v", bins), "bins")
        hist = binned.groupBy("_g", "_bin").agg(F.sum("_c").alias("_bc"))
        upto = F.sum("_bc").over(Window.partitionBy("_g").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
        hist = hist.select("_g", "_bin", "_bc", (upto - F.col("_bc")).alias("_base"))
        inner = F.struct(F.col("_g._k").alias("_k"), F.concat_ws(".", "_g.path", F.col("_bin").cast("string")).alias("path")).alias("_g")
        held = wanted.join(hist, "_g").where("_rel >= _base AND _rel < _base + _bc")
        next_wanted = materialize(held.select(inner, "prob", "_pos", "_rank", (F.col("_rel") - F.col("_base")).alias("_rel")), "ranks")
        inside = binned.select("_k", "_v", "_c", inner).join(next_wanted.select("_g").distinct(), "_g")
        next_rows = materialize(inside.select("_k", "_v", "_c", "_g"), "values")
        discard(rows, wanted, binned)
        rows, wanted = next_rows, next_wanted
    cum = Window.partitionBy("_g").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_to", F.sum("_c").over(cum))
    hits = wanted.join(placed, "_g").where("_rel < _to AND _rel >= _to - _c")
    low, high = F.min(F.struct("_rank", "_v")), F.max(F.struct("_rank", "_v"))
    out = hits.groupBy("_k", "prob").agg(low.alias("_l"), high.alias("_h"), F.first("_pos").alias("_pos"))
    frac = F.col("_pos") - F.col("_l._rank")
    return out.select(*[F.col(f"_k.`{k}`") for k in keys], "prob", (F.col("_l._v") + frac * (F.col("_h._v") - F.col("_l._v"))).alias("quantile"))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, salt: Column | None = None) -> DataFrame:
    """First k rows per key.  With ``salt`` each hot group is cut to k per salt first."""
    if salt is not None:
        pre = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_salt", salt).withColumn("_r", F.row_number().over(pre))
        df = df.where(F.col("_r") <= k).drop("_salt", "_r")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def neighbour_top_k(
    pairs: DataFrame, name: str, k: int = 6, a: str = "name", b: str = "variable", value: str = "value"
) -> DataFrame:
    """Strongest k pairs that hold ``name`` on either end."""
    hit = (F.col(a) == name) | (F.col(b) == name)
    return pairs.where(hit).orderBy(F.col(value).desc(), a, b).limit(k)
