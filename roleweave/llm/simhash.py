"""Operator 13: SimHash near duplicates by anchor points.

Equal fingerprints are one class.  A covering code on the first 61 of the 64
bits, the product of two binary Golay codes and a Hamming code (all perfect,
of covering radii 3, 3 and 1), gives the anchors.  Two fingerprints at
distance t have a word between them that is at most ceil(t / 2) bits from
both; the anchor nearest to that word is, block by block, within the radius
plus those bits of both.  So each fingerprint is replicated to every anchor
within covering radius plus ceil(t / 2), and each pair meets at an anchor.

Fingerprints of an anchor are compared with each other, and links that join
them are given out, never all pairs.  An anchor of more than ``crowd``
fingerprints is not gathered in one task: there the code of radius 0 takes over,
whose anchors are all words.  Its anchors need no comparison, as all
fingerprints at one are within the threshold of each other, so each is linked
with the least, by aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .base import Scratch, query, table
from .components import components

#: Generator polynomials of the binary Golay code (23, 12) and the Hamming code (15, 11), as (length, generator, covering radius).
BLOCKS = ((23, 0xC75, 3), (23, 0xC75, 3), (15, 0x13, 1))
BITS = 64


def _syndromes(words: np.ndarray, length: int, generator: int) -> np.ndarray:
    """Remainders of the words by the generator polynomial."""
    degree = generator.bit_length() - 1
    words = words.copy()
    for bit in range(length - 1, degree - 1, -1):
        words ^= np.where(words >> A.U(bit) & A.U(1), A.U(generator << (bit - degree)), A.U(0))
    return words


def _patterns(length: int, weight: int) -> np.ndarray:
    """All words of the given length and weight."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(length), weight)], A.U)


@lru_cache(maxsize=None)
def errors(length: int, generator: int, radius: int, beyond: int) -> tuple[np.ndarray, np.ndarray]:
    """What to add to a word to get each codeword at ``radius + beyond`` bits, for beyond 0 at most ``radius``: bounds by syndrome, and patterns."""
    weights = [radius + beyond] if beyond else range(radius + 1)
    found = np.concatenate([_patterns(length, w) for w in weights])
    of = _syndromes(found, length, generator).astype(np.int64)
    order = np.argsort(of, kind="stable")
    size = 1 << (generator.bit_length() - 1)
    return np.searchsorted(of[order], np.arange(size + 1)), found[order]


def anchors(words: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """All anchors within ``reach`` bits beyond the covering radius, block by block: (place in ``words``, anchor)."""
    at, anchor, left = np.arange(len(words)), np.zeros(len(words), A.U), np.full(len(words), reach)
    shift = 0
    for length, generator, radius in BLOCKS:
        block = words >> A.U(shift) & A.U((1 << length) - 1)
        syndrome = _syndromes(block, length, generator).astype(np.int64)
        parts = []
        for beyond in range(reach + 1):
            bounds, patterns = errors(length, generator, radius, beyond)
            rows = np.flatnonzero(left >= beyond)
            first, n = bounds[syndrome[at[rows]]], np.diff(bounds)[syndrome[at[rows]]]
            rows, pick = np.repeat(rows, n), np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            near = block[at[rows]] ^ patterns[pick]
            parts.append((at[rows], anchor[rows] | near << A.U(shift), left[rows] - beyond))
        at, anchor, left = (np.concatenate(p) for p in zip(*parts))
        shift += length
    return at, anchor


def ball(reach: int) -> np.ndarray:
    """All words of at most ``reach`` bits."""
    return np.concatenate([_patterns(BITS, w) for w in range(reach + 1)])


def fingerprints(text: bytes, n: int) -> int:
    """SimHash of a text: each bit is 1 if it is set in over half the hashes of the text's shingles."""
    words = text.lower().split()
    if not words:
        return 0
    n = min(n, len(words))
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())
    hashes = np.array([xxhash.xxh64_intdigest(line[s:e], 42) for s, e in spans], "<u8")
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _signed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = A.utf8(batch.column("text"))
            found = [fingerprints(data[s:e].tobytes(), n) for s, e in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), A.longs(np.array(found, A.U))], names=["id", "fp"])

    return run


def _replicas(reach: int):
    def run(batches):
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(A.U)
            for lo in range(0, len(fp), 1 << 14):
                at, anchor = anchors(fp[lo : lo + (1 << 14)], reach)
                yield pa.RecordBatch.from_arrays([A.longs(anchor), A.longs(fp[lo + at])], names=["anchor", "fp"])

    return run


def _words_around(reach: int):
    def run(batches):
        near = ball(reach)
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(A.U)
            step = max(1, (1 << 18) // len(near))
            for lo in range(0, len(fp), step):
                part = fp[lo : lo + step]
                yield pa.RecordBatch.from_arrays(
                    [A.longs((part[:, None] ^ near).reshape(-1)), A.longs(np.repeat(part, len(near)))], names=["anchor", "fp"]
                )

    return run


def joining_links(words: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links of ``threshold`` bits or fewer that join all words that such links connect: at most one less than words."""
    links, rest = [], words
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            word = front.pop()
            near = np.bitwise_count(rest ^ word) <= threshold
            found, rest = rest[near], rest[~near]
            links += [(int(word), int(x)) for x in found]
            front += list(found)
    return links


def _compared(threshold: int):
    def run(batches):
        for batch in batches:
            groups = A.Lists(batch.column("fps"))
            size = groups.end - groups.start
            two = np.flatnonzero(size == 2)
            a, b = (groups.flat[groups.start[two] + i].view(A.U) for i in (0, 1))
            near = np.bitwise_count(a ^ b) <= threshold
            a, b = [a[near]], [b[near]]
            for r in np.flatnonzero(size > 2):
                links = np.array(joining_links(np.ascontiguousarray(groups[r]).view(A.U), threshold), A.U).reshape(-1, 2)
                a.append(links[:, 0])
                b.append(links[:, 1])
            yield pa.RecordBatch.from_arrays([A.longs(np.concatenate(a)), A.longs(np.concatenate(b))], names=["a", "b"])

    return run


def near_fingerprints(
    docs: DataFrame, shingle: int = 5, threshold: int = 3, crowd: int = 2000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Connected groups of texts whose fingerprints differ in at most ``threshold`` bits.

    Rows: id, fp (the 64 bits as a long), component (smallest id reachable,
    itself included); one for each input row.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case.  A
    text of fewer than ``shingle`` words is one shingle; null texts and texts
    without words have fingerprint 0 and are linked like any other.  A row of
    null id keeps its fingerprint but is linked with nothing: its component is
    null.  Repeated rows are answered each, alike.  An empty table gives an
    empty result; further columns are ignored.

    ``crowd`` chooses how an anchor's fingerprints are compared, not whether.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    signed = scratch.write(rows.mapInArrow(_signed(shingle), f"id {kind}, fp long"), "signed")
    classes = signed.filter("id is not null").groupBy("fp").agg(F.min("id").alias("rep"))
    classes = scratch.write(classes, "classes")

    reach = threshold - threshold // 2
    met = classes.select("fp").mapInArrow(_replicas(reach), "anchor long, fp long")
    met = scratch.write(met, "replicas")
    counts = met.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1")
    counts = scratch.write(counts, "counts")
    few = met.join(counts.filter(F.col("m") <= crowd), "anchor").groupBy("anchor").agg(F.collect_list("fp").alias("fps"))
    links = few.select("fps").mapInArrow(_compared(threshold), "a long, b long")

    crowded = met.join(counts.filter(F.col("m") > crowd), "anchor").select("fp").distinct()
    crowded = scratch.write(crowded, "crowded")
    held = crowded.mapInArrow(_words_around(threshold // 2), "anchor long, fp long")
    least = held.groupBy("anchor").agg(F.min("fp").alias("b"))
    asked = crowded.mapInArrow(_words_around(reach), "anchor long, fp long")
    close = asked.join(least, "anchor").filter("fp <> b").select(F.col("fp").alias("a"), "b")
    links = scratch.write(links.union(close).distinct(), "links")
    scratch.drop(met, counts, crowded)

    roots = scratch.write(components(links, scratch), "roots")
    of_class = classes.join(roots.toDF("fp", "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = of_class.groupBy("root").agg(F.min("rep").alias("component"))
    groups = scratch.write(of_class.join(smallest, "root").select("fp", "component"), "groups")
    out = signed.join(groups, "fp", "left")
    return out.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))


@query("op13_simhash")
def op13(spark, sf_dir):
    found = near_fingerprints(table(spark, sf_dir, "documents"), shingle=3, threshold=2)
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )
