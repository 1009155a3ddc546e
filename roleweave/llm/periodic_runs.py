"""Operator 12: periodic runs of words by maximal pairs.

The words of a text get numbers; a suffix array of the suffixes that share
their first words with another one is sorted by prefix doubling, and its LCP
intervals are walked bottom-up.  An interval carries its places in text order,
each with its class: the word to its left.  Two places that come from different
children of an interval of depth l agree on exactly l words; where their classes
differ too they are a maximal pair, and with a distance q small enough against
l they are the first two periods of a run of q + l words, which needs no
extension.

A repeat of least period q has no other place of its interval between the two
that make the pair, so a place is compared with its neighbours in text order
only, and the smaller child is put into the larger one: the walk takes
n log^2 n steps whatever the text, and a run is found once.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .base import WORD, query, table


@dataclass(frozen=True)
class Shape:
    """A run has at least ``words`` words and ``periods`` periods."""

    words: int = 6
    periods: int = 4

    @property
    def depth(self) -> int:
        """Least number of words on which the two places of a pair agree."""
        return min(max(self.words - q, (self.periods - 1) * q) for q in range(1, self.words + 1))

    def fits(self, period: int, common: int) -> bool:
        return common + period >= max(self.words, self.periods * period)


def suffixes(words: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share ``depth`` words with another one, in the order of the suffix array, and the length shared with the one before.

    Prefix doubling: groups of equal rank are sorted by the rank of the suffix
    ``h`` places on; a suffix that is alone in its group is done.
    """
    n = len(words)
    order = np.argsort(words, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    slots = np.arange(n)
    active, h, deep = order, 1, None
    group = words[active]
    while len(active):
        first = np.ones(len(active), bool)
        first[1:] = group[1:] != group[:-1]
        rank[active] = slots[np.maximum.accumulate(np.where(first, np.arange(len(active)), 0))]
        alone = first & np.append(first[1:], True)
        if h > depth // 2 and deep is None:  # h words are shared, and h is at most the depth
            deep = np.sort(slots[~alone])
        slots, active = slots[~alone], active[~alone]
        if not len(active):
            break
        after = rank[np.minimum(active + h, n)]
        by = np.lexsort((after, rank[active]))
        active = active[by]
        order[slots] = active
        code = np.stack((rank[active], after[by]), 1)
        change = np.ones(len(active), bool)
        change[1:] = (code[1:] != code[:-1]).any(1)
        group = np.cumsum(change)
        h *= 2
    if deep is None or not len(deep):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return order[deep], _common(words, order, deep)


def _common(words: np.ndarray, order: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Words shared by the suffix in each slot and the one in the slot before, place by place in text order (Kasai and others)."""
    before = np.where(slots > 0, order[slots - 1], -1)
    places = order[slots]
    out = np.zeros(len(slots), np.int64)
    text, n = words.tolist(), len(words)
    common, last = 0, -2
    turn = np.argsort(places)
    for s, i, j in zip(turn.tolist(), places[turn].tolist(), before[turn].tolist()):
        common = common - 1 if common and i == last + 1 else 0
        last = i
        if j >= 0:
            top = n - max(i, j)
            while common < top and text[i + common] == text[j + common]:
                common += 1
        else:
            common = 0
        out[s] = common
    return out


class Pairs:
    """Maximal pairs of an LCP-interval tree that are runs: period by first word and end."""

    def __init__(self, left: list[int], shape: Shape):
        self.left, self.shape, self.runs = left, shape, {}

    def walk(self, places: list[int], common: list[int]) -> dict[tuple[int, int], int]:
        """Bottom-up: the stack holds the open intervals, each with its depth and the places of the children that are closed."""
        stack: list[tuple[int, list[int]]] = []
        least, cur = self.shape.depth, None
        for place, depth in zip(places + [-1], common + [0]):
            while stack and stack[-1][0] > depth:
                top, kept = stack.pop()
                cur = self.join(top, kept, cur)
            if cur is not None and depth >= least:
                if stack and stack[-1][0] == depth:
                    cur = self.join(depth, stack.pop()[1], cur)
                stack.append((depth, cur))
            cur = [place]
        return self.runs

    def join(self, depth: int, large: list[int], small: list[int]) -> list[int]:
        """Pairs between two children of an interval; their places in one list."""
        if len(large) < len(small):
            large, small = small, large
        reach, left = depth // (self.shape.periods - 1), self.left
        for i in small:
            at = bisect_left(large, i)
            if at and i - large[at - 1] <= reach and left[i] != left[large[at - 1]]:
                self.pair(large[at - 1], i, depth)
            if at < len(large) and large[at] - i <= reach and left[i] != left[large[at]]:
                self.pair(i, large[at], depth)
        if 8 * len(small) > len(large):
            large = sorted(large + small)
        else:
            for i in small:
                insort(large, i)
        return large

    def pair(self, i: int, j: int, common: int) -> None:
        period = j - i
        if self.shape.fits(period, common):
            key = i, j + common
            self.runs[key] = min(period, self.runs.get(key, period))


def runs_of(words: np.ndarray, shape: Shape) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    places, common = suffixes(words, shape.depth)
    if not len(places):
        return []
    left = [-1, *words[:-1].tolist()]
    found = Pairs(left, shape).walk(places.tolist(), common.tolist())
    return sorted(((i, end - i, q) for (i, end), q in found.items()), key=lambda r: (r[0], r[2]))


def _numbered(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, one number for each different word of a text (none shared by two texts), and the bounds of the texts."""
    split = [t.split() for t in texts]
    numbers: list[int] = []
    base = 0
    for words in split:
        seen: dict[bytes, int] = {}
        numbers += [seen.setdefault(w, base + len(seen)) for w in words]
        base += len(seen)
    return split, np.array(numbers, np.int64), np.cumsum([0, *map(len, split)])


def _texts(shape: Shape, with_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = A.utf8(batch.column("text"))
            for lo, hi in A.slices(offsets):
                raw = [data[offsets[r] : offsets[r + 1]].tobytes() for r in range(lo, hi)]
                split, numbers, bounds = _numbered(raw)
                of_text: list[list[tuple[int, int, int]]] = [[] for _ in raw]
                for start, length, period in runs_of(numbers, shape):
                    t = int(np.searchsorted(bounds, start, "right")) - 1
                    of_text[t].append((start - int(bounds[t]), length, period))
                out: dict[str, list] = {n: [] for n in ("n", "runs", "kept", "runs_sha256", "kept_sha256")}
                for words, runs in zip(split, of_text):
                    gone = A.cover(len(words), *(np.array(x, np.int64) for x in ([s + q for s, _, q in runs], [s + m for s, m, _ in runs])))
                    kept = b" ".join([w for w, g in zip(words, gone) if not g] if runs else words)
                    out["n"].append(len(words))
                    out["runs"].append([{"start": s, "length": m, "period": q} for s, m, q in runs])
                    out["kept"].append(kept if runs and with_kept else None)
                    out["runs_sha256"].append(hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest())
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                columns = [batch.column("id").slice(lo, hi - lo)]
                columns += [pa.array(out[n], RESULT[n]) for n in out]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *out])

    return run


RESULT = {
    "n": pa.int64(),
    "runs": pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])),
    "kept": pa.string(),
    "runs_sha256": pa.string(),
    "kept_sha256": pa.string(),
}


def periodic_runs(
    docs: DataFrame, shape: Shape = Shape(), id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True
) -> DataFrame:
    """Runs of repeated words in each text, and the text with each run cut to its first period.

    A run is a stretch of consecutive words with least period q (words q apart
    are equal), of at least ``shape.words`` words and ``shape.periods`` periods
    (two or more), that neither neighbouring word extends.  A word is dropped if
    any run holds it after that run's first q words.

    Rows: id, n (words), runs (start, length, period; by start, then period),
    kept (words left, joined by one space; null if the text has no run, or
    without ``with_kept``), runs_sha256, kept_sha256 (of the words left); one
    for each input row.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared byte by byte.  A null text has
    none.  Repeated rows, and rows of null id, are answered each.  A text is
    read as a whole by one task, in memory that follows its length; an empty
    table gives an empty result; further columns are ignored.
    """
    if shape.periods < 2:
        raise ValueError("a run has two periods or more")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        _texts(shape, with_kept),
        f"id {kind}, n long, runs array<struct<start:long,length:long,period:long>>, kept string, runs_sha256 string, kept_sha256 string",
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The texts of the contract: in each tenth document, by the hash of its id, the words from one place on repeat themselves."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    g, n = F.floor(F.col("h") / 10), F.col("n")
    a = F.pmod(g, n)
    p = F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + F.pmod(g, F.lit(8))))
    chosen = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    chosen = chosen.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, a).cast("int"))
    chosen = chosen.withColumn("p", F.when(F.col("n") > 0, p).cast("int"))
    again = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + F.pmod(i - F.col("a"), F.col("p")))))
    return chosen.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")), with_kept=False)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("m"), r["start"].alias("start"), r["period"].alias("period"))))
    found = found.withColumn("top", longest)
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.start").alias("start"),
        (-F.col("top.m")).alias("length"),
        F.col("top.period").alias("period"),
        F.floor(F.lit(-1000) * F.col("top.m") / F.col("top.period")).alias("exponent_milli"),
        "runs_sha256",
        F.col("kept_sha256").alias("collapsed_sha256"),
    )
