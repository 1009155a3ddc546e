"""Operator 5: quality rules as a learned decision list.

Statistics of every text are column expressions.  Sequential covering learns,
from labelled statistics, an ordered list of rules that reject: each rule is a
conjunction of thresholds, grown condition by condition on one part of the
labelled rows by information gain, pruned on the other part, and kept if it is
pure enough there.  The list is emitted as one ``CASE WHEN``.  Everything runs
as DataFrame operations; the driver sees counts by feature and bin only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import SPACES, WORD, Scratch, query, row_key, table

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = "!?"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_marks", "n_lines", "n_distinct_words")


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns ``COUNTS`` of its text (null: no words).

    The hashes of five-word windows are compared inside their row; the sort
    that finds which words lie in repeated windows is done only for texts that
    have one.
    """
    t = F.coalesce(F.col(text), F.lit(""))

    def without(chars: str) -> Column:
        return F.char_length(F.translate(F.col("_t"), chars, ""))

    docs = docs.withColumn("_t", t).withColumn("_h", F.expr(f"transform(regexp_extract_all(_t, r'{WORD}', 0), w -> xxhash64(w))"))
    docs = docs.withColumn(
        "_w",
        F.expr(
            "CASE WHEN size(_h) < 5 THEN array() ELSE transform(sequence(0, size(_h) - 5), i -> "
            "xxhash64(get(_h, i), get(_h, i + 1), get(_h, i + 2), get(_h, i + 3), get(_h, i + 4))) END"
        ).cast("array<bigint>"),
    )
    docs = docs.withColumn(
        "_p",
        F.expr(
            "CASE WHEN size(array_distinct(_w)) < size(_w) THEN sort_array(transform(_w, (x, i) -> struct(x AS h, i AS i))) END"
        ),
    )
    docs = docs.withColumn(
        "_r",
        F.expr(
            "sort_array(transform(filter(transform(_p, (x, j) -> struct(x.i AS i, "
            "coalesce(x.h = get(_p, j - 1).h, false) OR coalesce(x.h = get(_p, j + 1).h, false) AS twice)), x -> x.twice), x -> x.i))"
        ),
    )
    docs = docs.withColumn("_l", F.expr(f"filter(split(_t, '\\n'), x -> x rlike r'{WORD}')"))
    docs = docs.withColumns(
        {
            "n_words": F.size("_h").cast("long"),
            "word_chars": without(SPACES).cast("long"),
            "n_symbols": (F.char_length("_t") - without(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": F.coalesce(
                F.expr("aggregate(transform(_r, (x, j) -> least(5, coalesce(get(_r, j + 1) - x, 5))), 0L, (a, x) -> a + x)"), F.lit(0)
            ).cast("long"),
            "n_capitals": (F.char_length("_t") - without(CAPITALS)).cast("long"),
            "n_marks": (F.char_length("_t") - without(MARKS)).cast("long"),
            "n_lines": F.size("_l").cast("long"),
            "n_distinct_words": F.size(F.array_distinct("_h")).cast("long"),
        }
    )
    return docs.drop("_t", "_h", "_w", "_p", "_r", "_l")


def features() -> dict[str, Column]:
    """What rules test: counts and shares."""

    def share(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1))

    return {
        "words": F.col("n_words").cast("double"),
        "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "mark_share": share("n_marks", "word_chars"),
        "capital_share": share("n_capitals", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct_words", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    limit: float

    def column(self, of: dict[str, Column] | None = None) -> Column:
        value = F.col(self.feature) if of is None else of[self.feature]
        return value > self.limit if self.above else value <= self.limit

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.limit:.6g}"


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def _best(rows: DataFrame, cuts: dict[str, list[float]], bad: int, good: int) -> tuple[float, Condition | None]:
    """The condition of most information gain (FOIL) from counts by feature and bin."""
    def place(feature: str, limits: list[float]) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, limits)), lambda x: x < F.col(feature)))

    bins = [F.struct(F.lit(f).alias("f"), place(f, c).alias("b")) for f, c in cuts.items()]
    counts: dict[str, list[list[int]]] = {f: [[0, 0] for _ in range(len(c) + 1)] for f, c in cuts.items()}
    table = rows.select("label", F.explode(F.array(*bins)).alias("x")).groupBy("x.f", "x.b", "label").count()
    for r in table.collect():  # features times bins times two rows at most
        counts[r["f"]][r["b"]][r["label"]] += r["count"]
    now = math.log2(bad / (bad + good))
    best, choice = 0.0, None
    for f, c in cuts.items():
        total = [sum(x[i] for x in counts[f]) for i in (0, 1)]
        below = [0, 0]
        for limit, x in zip(c, counts[f]):
            below = [below[0] + x[0], below[1] + x[1]]
            for above, (n0, n1) in ((False, below), (True, (total[0] - below[0], total[1] - below[1]))):
                if n0 and (gain := n0 * (math.log2(n0 / (n0 + n1)) - now)) > best + 1e-9:
                    best, choice = gain, Condition(f, above, limit)
    return best, choice


def learn_rules(
    labelled: DataFrame,
    feature_names: list[str],
    max_rules: int = 6,
    max_conditions: int = 3,
    purity: float = 0.95,
    support: int = 4,
    bins: int = 32,
) -> list[list[Condition]]:
    """Rules that reject, in order, learned from rows (features, label 0 or 1, prune).

    A rule is kept if, on the pruning rows that no earlier rule covers, it
    covers ``support`` rows of label 0 and a share of ``purity`` of those it
    covers is of label 0.  Rows without a label are ignored; with one label or
    no rows, there are no rules.
    """
    labelled = labelled.filter("label in (0, 1)")
    shares = [i / bins for i in range(1, bins)] + [0.005, 0.01, 0.99, 0.995]
    points = labelled.agg(
        *[F.percentile_approx(F.when(F.col("label") == k, F.col(f)), sorted(shares), 10_000).alias(f"{f}{k}") for f in feature_names for k in (0, 1)]
    ).first()
    cuts = {f: sorted({x for k in (0, 1) for x in points[f"{f}{k}"] or () if x is not None}) for f in feature_names}
    rules: list[list[Condition]] = []
    left = labelled
    while len(rules) < max_rules:
        rule: list[Condition] = []
        grow = left.filter("not prune")
        while len(rule) < max_conditions:
            n = {r["label"]: r["count"] for r in grow.filter(_all(rule)).groupBy("label").count().collect()}
            if not n.get(0) or not n.get(1):
                break
            _, choice = _best(grow.filter(_all(rule)), cuts, n[0], n[1])
            if choice is None:
                break
            rule.append(choice)
        if not rule:
            break
        tests = [F.count_if(_all(rule[:k]) & (F.col("label") == v)).alias(f"c{k}_{v}") for k in range(1, len(rule) + 1) for v in (0, 1)]
        got = left.filter("prune").agg(*tests).first()
        value = {k: (got[f"c{k}_0"] - got[f"c{k}_1"]) / max(1, got[f"c{k}_0"] + got[f"c{k}_1"]) for k in range(1, len(rule) + 1)}
        k = max(value, key=lambda k: (value[k], -k))
        if got[f"c{k}_0"] < support or got[f"c{k}_0"] < purity * (got[f"c{k}_0"] + got[f"c{k}_1"]):
            break
        rules.append(rule[:k])
        left = left.filter(~_all(rule[:k]))
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """The decision list as one conditional expression: false where a rule covers the row."""
    out, of = None, features()
    for rule in rules:
        test = F.lit(True)
        for c in rule:
            test = test & c.column(of)
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Statistics of each text, base_failed and kept (base rules, then the learned list).

    Rows: id, the columns ``COUNTS``, base_failed, kept, rule (number of the
    rule that rejects, from 1); one for each input row, and ``key`` (hash of id and text).

    ``labels`` has id and ``quality`` (0 or 1; others and null are ignored).
    Null texts have no words and fail the base rules.  Null ids have no label.
    Repeated rows are answered each.  Without usable labels only the base rules
    count.  Empty tables give empty results; further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))
    stats = scratch.write(text_statistics(rows).drop("text"), "stats")
    of = features()
    named = stats.select("id", *[c.alias(n) for n, c in of.items()])
    known = labels.select(F.col(id_col).alias("id"), F.col("quality").alias("label")).filter("label in (0, 1) and id is not null")
    labelled = named.join(known, "id").withColumn("prune", F.crc32(F.col("id").cast("string")) % 3 == 0)
    labelled = scratch.write(labelled.drop("id"), "labelled")
    rules = learn_rules(labelled, list(of), **options)
    number = F.lit(None).cast("int")
    for i in range(len(rules), 0, -1):
        number = F.when(~verdict([rules[i - 1]]), F.lit(i)).otherwise(number)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", F.when(~F.col("base_failed"), number))
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))


@query("op5_quality_rules")
def op5(spark, sf_dir):
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(F.col("id").alias("doc_id"), *counts, "base_failed", "kept")
