"""Operator 2: near-duplicate groups by b-bit MinHash.

Every text's distinct shingles get ``bands * rows`` minima.  Texts of equal
sets are one class.  Band keys are made of whole minima; a signature keeps the
low ``BITS`` bits of each, packed.  Classes that share a band key are
candidates; the share of equal low bits, counted on packed words and corrected
for chance meetings, sorts out most; the rest are confirmed on full sets.

Groups stay linear.  Members of a bucket are first compared with its least
member only.  Where that leaves the members around one least member in different
components, they are compared with each other, in blocks, by signatures and then
by full sets; a block gives out only links that join components.  Pairs inside
one component are never formed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .base import Scratch, query, row_key, table
from .components import components

BITS = 4
NIBBLE = 0x1111111111111111
BLOCK = 400_000  # shingles of a block
COLUMNS = 2048


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, and the range of each."""
    w = A.Words(data, offsets, fold=A.LOWER)
    count = np.diff(w.bounds)
    text = np.repeat(np.arange(len(count)), count)
    runs = A.RunHash(w.hash)
    start = np.arange(len(w.hash))
    end = np.minimum(start + n, w.bounds[text + 1])
    keep = (end - start == n) | (start == w.bounds[text])  # a text of fewer words is one shingle
    keep &= (end - start == np.minimum(n, count[text]))
    h, text = runs(start[keep], end[keep]), text[keep]
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(count) + 1))


def _coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240229))
    return rng.integers(0, 1 << 63, k, dtype=np.uint64) * A.U(2) + A.U(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)


def _signatures(n: int, bands: int, rows: int):
    def run(batches):
        mul, add = _coefficients(bands * rows)
        per_word = 64 // BITS
        for batch in batches:
            data, offsets = A.utf8(batch.column("text"))
            count, sums, sigs, keys = [], [], [], []
            for lo, hi in A.slices(offsets):
                h, bounds = shingles(data, offsets[lo : hi + 1], n)
                size = np.diff(bounds)
                count.append(size)
                total = [np.concatenate(([A.U(0)], np.cumsum(A.mix(h * base)))) for base in A.BASES]
                sums.append([t[bounds[1:]] - t[bounds[:-1]] for t in total])
                some = np.flatnonzero(size)
                sig = np.zeros((hi - lo, bands * rows // per_word), A.U)
                key = np.zeros((hi - lo, bands), A.U)
                if len(some):
                    begin = bounds[:-1][some]
                    for j in range(bands * rows):
                        least = np.minimum.reduceat(h * mul[j] + add[j], begin)
                        sig[some, j // per_word] |= (least & A.U(2**BITS - 1)) << A.U(BITS * (j % per_word))
                        key[some, j // rows] = A.mix(key[some, j // rows] * A.BASES[0] + least)
                    key[some] = A.mix(key[some] + np.arange(1, bands + 1, dtype=A.U) * A.BASES[1])
                sigs.append(sig)
                keys.append(key)
            if not count:
                continue
            size = np.concatenate(count)
            s1, s2 = (np.concatenate([s[i] for s in sums]) for i in (0, 1))
            lists = [
                pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * a.shape[1]), A.longs(a.reshape(-1)))
                for a in (np.concatenate(sigs), np.concatenate(keys))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"), A.longs(size), A.longs(A.mix(s1 + size.astype(A.U))), A.longs(s2), *lists],
                names=["id", "key", "n", "s1", "s2", "sig", "bands"],
            )

    return run


def _sets(n: int):
    def run(batches):
        for batch in batches:
            data, offsets = A.utf8(batch.column("text"))
            for lo, hi in A.slices(offsets):
                h, bounds = shingles(data, offsets[lo : hi + 1], n)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), A.longs(h))
                yield pa.RecordBatch.from_arrays([batch.column("c").slice(lo, hi - lo), lists], names=["c", "set"])

    return run


def _intersections(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the named pairs: one by one, or, for many pairs, by products of incidence matrices."""
    if len(pairs) < 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs], np.int64)
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    grid = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[row[a:b], column[a:b] - lo] = 1
        grid += x @ x.T
    return grid[pairs[:, 0], pairs[:, 1]].astype(np.int64)


def _across(least: float, percent: int):
    """Links between different components in a block of a group, or between two blocks; those that join components only."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sig = np.stack(pdf["sig"].to_numpy()).astype(np.int64).view(A.U)
        comp, c, block = (pdf[n].to_numpy() for n in ("comp", "c", "block"))
        one = pdf["b1"].iat[0] == pdf["b2"].iat[0]
        found = []
        for i in range(len(pdf)):
            other = np.flatnonzero((comp[i + 1 :] != comp[i]) & (one | (block[i + 1 :] != block[i]))) + i + 1
            x = sig[other] ^ sig[i]
            x |= x >> A.U(1)
            x |= x >> A.U(2)
            equal = 1 - np.bitwise_count(x & A.U(NIBBLE)).sum(1) / (sig.shape[1] * 64 // BITS)
            other = other[(equal - 2.0**-BITS) / (1 - 2.0**-BITS) >= least]
            found.append(np.stack([np.full(len(other), i), other], 1))
        pairs = np.concatenate(found)
        sets = [np.asarray(x, np.int64) for x in pdf["set"]]
        n = np.array([len(x) for x in sets])
        fits = 100 * np.minimum(n[pairs[:, 0]], n[pairs[:, 1]]) >= percent * np.maximum(n[pairs[:, 0]], n[pairs[:, 1]])
        pairs = pairs[fits]
        both = _intersections(sets, pairs) if len(pairs) else np.zeros(0, np.int64)
        links = pairs[100 * both >= percent * (n[pairs[:, 0]] + n[pairs[:, 1]] - both)]
        up = {x: x for x in comp}

        def top(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        joined = []
        for i, j in links:
            x, y = top(comp[i]), top(comp[j])
            if x != y:
                up[x] = y
                joined.append((c[i], c[j]))
        return pd.DataFrame(joined, columns=["a", "b"], dtype="int64")

    return run


def _alike(x: str, y: str, words: int):
    """Estimated similarity of two packed signatures, corrected for low bits that meet by chance."""
    def differ(i):
        d = F.col(x)[i].bitwiseXOR(F.col(y)[i])
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        return F.bit_count(d.bitwiseAND(F.lit(NIBBLE)))

    equal = 1 - sum((differ(i) for i in range(1, words)), differ(0)) / (words * 64 // BITS)
    return (equal - 2.0**-BITS) / (1 - 2.0**-BITS)


def near_duplicate_groups(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    bands: int = 20,
    rows: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Connected groups of texts whose shingle sets agree to ``percent`` (intersection by union).

    Rows: id, n_shingles, component (smallest id reachable, itself included),
    kept (id = component), key (of id and text) and root (of the group, as two
    may have the same smallest id; null where a row is linked with nothing by
    rule), one for each input row.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case; a text
    of fewer than ``shingle`` words is one shingle; texts without words, and
    null texts, have none and are linked with nothing.  A row with a null id is
    linked with nothing: its component is null and it is kept.  Repeated rows
    are answered each, alike.  An empty table gives an empty result; further
    columns are ignored.

    A pair at the limit is missed by all bands with probability
    ``(1 - (percent / 100) ** rows) ** bands``; candidates go to the full check
    unless their estimate is 0.2 below the limit, five standard errors.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    words = bands * rows * BITS // 64
    least = percent / 100 - 0.2
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("key", row_key("id", "text"))
    kind = docs.schema["id"].dataType.simpleString()
    signed = docs.mapInArrow(
        _signatures(shingle, bands, rows),
        f"id {kind}, key long, n long, s1 long, s2 long, sig array<long>, bands array<long>",
    )
    signed = scratch.write(signed, "signed")
    usable = signed.filter("n > 0 and id is not null")
    classes = usable.groupBy("s1", "s2", "n").agg(
        F.min("id").alias("rep"), F.min("key").alias("key"), F.first("sig").alias("sig"), F.first("bands").alias("bands")
    )
    classes = scratch.write(classes.withColumn("c", F.xxhash64("s1", "s2", "n")), "classes")

    keys = classes.select("c", F.explode("bands").alias("band"))
    buckets = keys.groupBy("band").agg(F.min("c").alias("b"), F.count("*").alias("m")).filter("m > 1")
    buckets = scratch.write(buckets, "buckets")
    members = scratch.write(keys.join(buckets, "band"), "members")
    star = members.filter("c <> b").select(F.col("c").alias("a"), "b").distinct()

    about = classes.select("c", "n", "sig")
    pairs = star.join(about.toDF("a", "na", "sa"), "a").join(about.toDF("b", "nb", "sb"), "b")
    fits = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (_alike("sa", "sb", words) >= least)
    pairs = scratch.write(pairs.filter(fits).select("a", "b", "na", "nb"), "pairs")

    def full(asked: DataFrame) -> DataFrame:
        of = classes.join(asked.distinct(), "c").select("c", "key")
        texts = docs.select("key", "text").join(of, "key").dropDuplicates(["c"]).select("c", "text")
        return scratch.write(texts.mapInArrow(_sets(shingle), "c long, set array<long>"), "sets")

    sets = full(pairs.select(F.col("a").alias("c")).union(pairs.select("b")))
    both = pairs.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b")
    both = both.select("a", "b", "na", "nb", F.size(F.array_intersect("xa", "xb")).alias("i"))
    links = both.filter(100 * F.col("i") >= percent * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b")
    links = scratch.write(links, "links")
    scratch.drop(sets)
    roots = scratch.write(components(links, scratch), "roots")

    # what the stars leave apart
    around = star.select("b", F.col("a").alias("c")).union(star.select("b", F.col("b").alias("c")).distinct())
    around = around.join(roots.toDF("c", "root"), "c", "left").join(about, "c").withColumn("comp", F.coalesce("root", "c"))
    around = scratch.write(around.drop("root"), "around")
    mixed = around.groupBy("b").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"), F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks")
    )
    mixed = scratch.write(mixed.filter("lo < hi and m > 2").select("b", "blocks"), "mixed")
    open_rows = around.join(mixed, "b")
    sets = full(open_rows.select("c"))
    open_rows = open_rows.withColumn("block", F.pmod(F.xxhash64("c"), "blocks").cast("int"))
    open_rows = open_rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(sets, "c")
    open_rows = open_rows.select("b", "c", "comp", "sig", "set", "block", F.least("block", "o").alias("b1"), F.greatest("block", "o").alias("b2"))
    more = scratch.write(open_rows.groupBy("b", "b1", "b2").applyInPandas(_across(least, percent), "a long, b long"), "more")
    scratch.drop(sets)
    roots = scratch.write(components(links.union(more), scratch), "roots")

    of_class = classes.join(roots.toDF("c", "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    smallest = of_class.groupBy("root").agg(F.min("rep").alias("component"))
    groups = of_class.join(smallest, "root").select("s1", "s2", "n", "component", "root")
    out = signed.select("id", "key", "n", "s1", "s2").join(groups, ["s1", "s2", "n"], "left")
    component = F.when(F.col("id").isNull(), None).otherwise(F.coalesce("component", "id"))
    return out.select(
        "id",
        F.col("n").alias("n_shingles"),
        component.alias("component"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
        "key",
        F.when(F.col("id").isNotNull(), F.col("root")).alias("root"),
    )


@query("op2_minhash")
def op2(spark, sf_dir):
    groups = near_duplicate_groups(table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")
