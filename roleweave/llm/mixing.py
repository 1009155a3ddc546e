"""Operator 9: mixing sources to target weights by temperature.

A source's weight is its share of all tokens to the power of an exponent,
normalised.  The exponent is bisected, many cuts at a time, until the weights
have the target entropy or no source is repeated more often than the limit.
The weights are realised within a token budget: whole passes over a source,
then a part of a permutation of its blocks, shuffled again inside each block.

All of it is DataFrame work.  Sums are aggregated before they are shuffled;
a large source is cut into blocks of a bounded size, so that only sums of
blocks are ordered by source, and rows only inside a block.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import WORD, Scratch, query, row_key, table

CUTS = 64


def exponent(
    shares: DataFrame, entropy: float | None, repeats: float | None, budget_share: float | None = None, rounds: int = 4
) -> float:
    """Exponent in 0 .. 1 for sources with shares ``p`` (column) of all tokens.

    ``entropy``: of the weights, as a part of the largest possible; the largest
    exponent that still reaches it.  ``repeats``: passes over any source, at a
    budget of ``budget_share`` times all tokens (None: the budget of one pass
    over the source that is scaled down most); the least exponent that keeps to
    it.  With both, the limit on repeats goes first.
    """
    shares = shares.filter("p > 0")

    def at(points: list[float]):
        p = F.col("p")
        rows = shares.select("p", F.explode(F.array(*map(F.lit, points))).alias("e"))
        rows = rows.groupBy("e").agg(
            F.sum(F.pow(p, F.col("e"))).alias("z"),
            F.sum(F.pow(p, F.col("e")) * F.log(p)).alias("s"),
            F.max(F.pow(p, F.col("e") - 1)).alias("m"),
            F.max(F.pow(p, 1 - F.col("e"))).alias("d"),
            F.count("*").alias("k"),
        )
        for r in rows.orderBy("e").collect():  # one row for each cut
            h = 1.0 if r["k"] == 1 else (math.log(r["z"]) - r["e"] * r["s"] / r["z"]) / math.log(r["k"])
            yield r["e"], h, r["m"] * (r["d"] if budget_share is None else budget_share / r["z"])

    def search(holds_low) -> float:
        """Largest point up to which ``holds_low`` is true, to the width of the last round."""
        lo, hi = 0.0, 1.0
        for _ in range(rounds):
            points = [lo + (hi - lo) * i / CUTS for i in range(CUTS + 1)]
            held = [e for e, h, m in at(points) if holds_low(h, m)]
            if len(held) == len(points):
                return hi
            lo, hi = (max(held), max(held) + (hi - lo) / CUTS) if held else (lo, lo)
        return lo

    least = 0.0
    if repeats is not None:
        least = search(lambda h, m: m > repeats + 1e-12)
        if least > 0 or next(at([0.0]), (0, 0, 0.0))[2] > repeats:
            least = min(1.0, least + CUTS ** -float(rounds))
    return max(least, search(lambda h, m: h >= entropy - 1e-12)) if entropy is not None else (least if repeats is not None else 1.0)


def mix_sources(
    docs: DataFrame,
    entropy: float | None = 0.97,
    repeats: float | None = 4.0,
    budget_share: float | None = None,
    block_tokens: int = 1_000_000,
    seed: int = 7,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """How often, and where, each text enters the mixture.

    Rows: key (hash of id, source and text), source, n_tokens, weight of the
    source, passes (whole passes over the source), copies (of this text),
    block and place (tokens before the text in the permutation of its source);
    one for each distinct row: repeated rows share one and are taken alike.

    Tokens are words ``[^\\x20\\x09-\\x0D]+``.  The budget is ``budget_share``
    times all tokens; a source's part is its weight times the budget, met from
    below, by less than one text.  Null is a source of its own.  Null and empty
    texts have no tokens: they have one copy for each pass and take no budget.
    Ties in the permutation go by the row's hash.  An empty table gives an empty
    result; further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(
        row_key(id_col, source_col, text_col).alias("key"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"),
    ).withColumn("s", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    rows = rows.groupBy("key", "s", "source", "n_tokens").agg(F.count("*").alias("rows"))
    rows = scratch.write(rows.withColumn("tokens", F.col("n_tokens") * F.col("rows")), "rows")
    sources = scratch.write(rows.groupBy("s").agg(F.sum("tokens").alias("t")), "sources")
    total = sources.agg(F.sum("t")).first()[0] or 0
    if total == 0:
        e, z, budget_share = 1.0, 1.0, 0.0
    else:
        shares = sources.select((F.col("t") / total).alias("p"))
        e = exponent(shares, entropy, repeats, budget_share)
        z, most = shares.filter("p > 0").agg(F.sum(F.pow("p", F.lit(e))), F.max(F.pow("p", F.lit(1 - e)))).first()
        budget_share = most * z if budget_share is None else budget_share
    weight = F.when(F.col("t") > 0, F.pow(F.col("t") / max(total, 1), F.lit(e)) / z).otherwise(0.0)
    part = F.round(F.col("weight") * budget_share * total)
    plan = sources.withColumn("weight", weight).withColumns(
        {
            "passes": F.when(F.col("t") > 0, F.floor(part / F.col("t"))).otherwise(1).cast("long"),
            "rest": F.when(F.col("t") > 0, part % F.col("t")).otherwise(0).cast("long"),
            "n_blocks": F.greatest(F.ceil(F.col("t") / block_tokens), F.lit(1)).cast("long"),
        }
    )
    placed = rows.join(plan, "s").withColumn("block", F.pmod(F.xxhash64("key"), "n_blocks"))
    inside = Window.partitionBy("s", "block").orderBy(F.xxhash64(F.lit(seed), "key"), "key")
    blocks = placed.groupBy("s", "block").agg(F.sum("tokens").alias("b"))
    before = Window.partitionBy("s").orderBy(F.xxhash64(F.lit(seed), "s", "block"), "block")
    blocks = blocks.withColumn("start", F.sum("b").over(before) - F.col("b")).drop("b")
    placed = placed.withColumn("here", F.sum("tokens").over(inside))
    placed = placed.join(blocks, ["s", "block"]).withColumn("end", F.col("start") + F.col("here"))
    extra = F.when((F.col("end") <= F.col("rest")) & (F.col("n_tokens") > 0), 1).otherwise(0)
    return placed.select(
        "key", "source", "n_tokens", "weight", "passes", (F.col("passes") + extra).alias("copies"), "block", (F.col("end") - F.col("tokens")).alias("place")
    )


def realise(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with a row for each copy, and copy, mix_weight, mix_block and mix_place."""
    plan = plan.filter("copies > 0").select(
        F.col("key").alias("_key"), F.col("weight").alias("mix_weight"), F.col("block").alias("mix_block"), F.col("place").alias("mix_place"),
        F.expr("sequence(1L, copies)").alias("_copies"),
    )
    out = docs.withColumn("_key", row_key(id_col, source_col, text_col)).join(plan, "_key")
    return out.withColumn("copy", F.explode("_copies")).drop("_key", "_copies")


@query("op9_mixing")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    plan = mix_sources(docs).select("key", "n_tokens", "weight", "copies", "block", "place")
    ids = docs.select("doc_id", "source", row_key("doc_id", "source", "text").alias("key"))
    return ids.join(plan, "key").drop("key")
