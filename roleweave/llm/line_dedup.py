"""Operator 6: line dedup by pairwise alignment.

Overlapping texts are found through shared runs: a run is adjacent lines that
just reach the least number of words, from a first line on or up to a last one,
and every block to be deleted is covered by its runs.  Each run has a first
holder, and every later text that holds it is paired with that one, so pairs
grow with the lines, not with the square of a run's holders.  A pair's line
hashes are aligned by patience diff, and common blocks are deleted from the
later text; so are the runs of the earlier text that the alignment leaves,
as their lines are repeated or moved.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from . import arrays as A
from .base import WORD, Scratch, query, row_key, table


def _unique(lines: list, lo: int, hi: int) -> dict:
    seen: dict = {}
    for i in range(lo, hi):
        seen[lines[i]] = i if lines[i] not in seen else -1
    return seen


def _increasing(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of (i, j), sorted by i, in which j increases too."""
    tops: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for n, (_, j) in enumerate(places):
        k = bisect_left(tops, j)
        back.append(ends[k - 1] if k else -1)
        if k == len(tops):
            tops.append(j)
            ends.append(n)
        else:
            tops[k], ends[k] = j, n
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(places[n])
        n = back[n]
    return out[::-1]


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places (i, j) of equal lines: common ends, then lines unique on both sides, and so on between them."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        left, right = _unique(a, alo, ahi), _unique(b, blo, bhi)
        fixed = _increasing([(i, right[x]) for x, i in left.items() if i >= 0 and right.get(x, -1) >= 0])
        if not fixed:
            continue
        i0, j0 = alo, blo
        for i, j in [*fixed, (ahi, bhi)]:
            todo.append((i0, i, j0, j))
            if i < ahi:
                out.append((i, j))
            i0, j0 = i + 1, j + 1
    return sorted(out)


def blocks(aligned: list[tuple[int, int]], words: list[int], least: int) -> list[tuple[int, int]]:
    """Runs of aligned lines, as ranges of the later text, that have ``least`` words."""
    out, n = [], 0
    while n < len(aligned):
        m = n
        while m + 1 < len(aligned) and aligned[m + 1] == (aligned[m][0] + 1, aligned[m][1] + 1):
            m += 1
        lo, hi = aligned[n][0], aligned[m][0] + 1
        if sum(words[lo:hi]) >= least:
            out.append((lo, hi))
        n = m + 1
    return out


def runs(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of lines with ``least`` words that have fewer without their last line, or without their first."""
    n = len(words)
    total = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))
    place = np.arange(n)
    end = np.searchsorted(total, total[:-1] + least)
    start = np.searchsorted(total, total[1:] - least, "right") - 1
    lo = np.concatenate((place[end <= n], start[start >= 0]))
    hi = np.concatenate((end[end <= n], place[start >= 0] + 1))
    both = np.unique(lo * (n + 1) + hi)
    return both // (n + 1), both % (n + 1)


def _run_names(lines: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return A.RunHash(lines.astype(np.int64).view(np.uint64))(lo, hi).view(np.int64)


def _runs(least: int, schema: pa.Schema):
    """Name of each run of each text, once."""

    def run(batches):
        for batch in batches:
            h, w = A.Lists(batch.column("h")), A.Lists(batch.column("w"))
            names = [np.unique(_run_names(h[r], *runs(w[r], least))) for r in range(len(batch))]
            rows = pa.array(np.repeat(np.arange(len(batch)), [len(x) for x in names]))
            run = pa.array(np.concatenate([np.zeros(0, np.int64), *names]))
            yield pa.RecordBatch.from_arrays([run if n == "run" else batch.column(n).take(rows) for n in schema.names], schema=schema)

    return run


def left_over(a: np.ndarray, words: np.ndarray, b: np.ndarray, found: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Blocks of ``a`` made of runs that ``b`` has too and that are not inside ``found``."""
    lo, hi = runs(words, least)
    gone = A.cover(len(a), *(np.array([x[n] for x in found], np.int64) for n in (0, 1)))
    todo = np.concatenate(([0], np.cumsum(~gone)))
    todo = todo[hi] > todo[lo]
    if not todo.any():
        return []
    known, at = np.unique(a, return_index=True)
    place = np.minimum(np.searchsorted(known, b), len(known) - 1)
    other = np.where(known[place] == b, words[at[place]], least)  # a run with a line that a lacks equals none of a
    lo, hi = lo[todo], hi[todo]
    same = np.isin(_run_names(a, lo, hi), _run_names(b, *runs(other, least)))
    return [(int(x), int(y)) for x, y in zip(*A.spans(A.cover(len(a), lo[same], hi[same])))]


def _align(least: int):
    kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def run(batches):
        for batch in batches:
            later, words, first = (A.Lists(batch.column(n)) for n in ("h", "w", "fh"))
            found = []
            for r in range(len(batch)):
                aligned = blocks(patience(later[r].tolist(), first[r].tolist()), words[r].tolist(), least)
                aligned += left_over(later[r], words[r], first[r], aligned, least)
                found.append([{"lo": a, "hi": b} for a, b in aligned])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, kind)], names=["key", "blocks"])

    return run


def remove_shared_lines(
    docs: DataFrame, min_words: int = 5, common_share: float = 1.0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with three columns more: n_lines, removed (line ranges), kept_text.

    Lines are parts between newlines, compared without outer spaces.  A text
    loses every block of adjacent lines with at least ``min_words`` words (one
    at least) that a text of smaller id has too.  All are judged on the input,
    so what an earlier text loses does not matter.  Where two texts share a run
    whose first holder is a third, both are paired with that one.

    ``common_share`` below 1 keeps boilerplate: runs that more than this share
    of the texts have (and more than two) name no candidates.  By default none
    is left out.

    Null texts have no lines and stay null.  Rows of null id, and rows of one
    id among each other, are not paired.  Repeated rows are answered alike.  An
    empty table gives an empty result; further columns are kept as they are.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    keyed = docs.withColumn("_key", row_key(id_col, text_col))
    text = F.col(text_col)
    lines = keyed.select(
        F.col("_key").alias("key"),
        F.col(id_col).alias("id"),
        F.transform(F.split(text, "\n"), lambda x: F.xxhash64(F.trim(x))).alias("h"),
        F.transform(F.split(text, "\n"), lambda x: F.regexp_count(x, F.lit(WORD))).alias("w"),
    )
    lines = scratch.write(lines.filter("id is not null and h is not null"), "lines")
    total = lines.count()
    least = max(1, min_words)
    schema = StructType([lines.schema["key"], lines.schema["id"], StructField("run", LongType())])
    names = lines.select("key", "id", "h", "w").mapInArrow(_runs(least, to_arrow_schema(schema)), schema)
    names = scratch.write(names, "runs")
    holders = names.groupBy("run").agg(
        F.min("id").alias("first"), F.min_by("key", "id").alias("f"), F.max("id").alias("last"), F.count("*").alias("n")
    )
    holders = holders.filter((F.col("first") < F.col("last")) & (F.col("n") <= max(2.0, common_share * total)))
    holders = scratch.write(holders.select("run", "first", "f"), "holders")
    pairs = scratch.write(names.join(holders, "run").filter("id > first").select("key", "f").distinct(), "pairs")
    scratch.drop(names)
    firsts = lines.join(pairs.select(F.col("f").alias("key")).distinct(), "key").dropDuplicates(["key"])
    firsts = firsts.select(F.col("key").alias("f"), F.col("h").alias("fh"))
    both = pairs.join(lines.select("key", "h", "w").dropDuplicates(["key"]), "key").join(firsts, "f")
    found = both.select("key", "h", "w", "fh").mapInArrow(_align(least), "key long, blocks array<struct<lo:int,hi:int>>")
    found = found.filter("size(blocks) > 0").groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("blocks")))).alias("_removed"))
    found = scratch.write(found, "found")
    scratch.drop(holders, pairs)
    # shuffled at every size, so that a small run plans as a large one does
    out = keyed.join(found.withColumnRenamed("key", "_key").hint("merge"), "_key", "left").drop("_key")
    kept = F.filter(
        F.split(text, "\n"), lambda x, i: ~F.exists("_removed", lambda b: (i >= b["lo"]) & (i < b["hi"]))
    )
    return out.withColumns(
        {
            "n_lines": F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long"),
            "removed": F.col("_removed"),
            "kept_text": F.when(F.col("_removed").isNull(), text).otherwise(F.array_join(kept, "\n")),
        }
    ).drop("_removed")


@query("op6_line_dedup")
def op6(spark, sf_dir):
    out = remove_shared_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.coalesce("kept_text", F.lit(""))
    n_kept = F.when(F.col("removed").isNull(), F.col("n_lines")).otherwise(
        F.col("n_lines")
        - F.size(F.array_distinct(F.flatten(F.transform("removed", lambda b: F.sequence(b["lo"], b["hi"] - 1)))))
    )
    return out.select("doc_id", "n_lines", (F.col("n_lines") - n_kept).cast("long").alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256"))
