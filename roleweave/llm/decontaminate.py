"""Operator 7: benchmark decontamination by a prefix-filtered join.

A window is ``window`` consecutive words of a benchmark item.  For containment
in full, the necessary prefix of a window, its words ordered by rarity, is its
rarest word; rarity is counted over all documents.  Documents are joined with
windows on that word.  Position and length bounds (the words before and after
it must fit into the document) go first, then the whole window is compared by
two hashes of its words.

The benchmark is a stated query set: it is worked through in blocks of a
bounded size, and each block is sent to all tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .base import Scratch, query, row_key, table

BITS = 16
FIELDS = ("word", "place", "length", "w1", "w2", "item")


def _words(data, offsets) -> A.Words:
    return A.Words(data, offsets, A.ALNUM, A.LOWER)


def _item_windows(window: int):
    """Every distinct window of each item: its words and two names."""

    def run(batches):
        for batch in batches:
            data, offsets = A.utf8(batch.column("text"))
            out = {"item": [], "words": [], "w1": [], "w2": []}
            for lo, hi in A.slices(offsets):
                w = _words(data, offsets[lo : hi + 1])
                one, two = A.RunHash(w.hash), A.RunHash(w.hash, A.BASES[1])
                ids = batch.column("item").slice(lo, hi - lo).to_pylist()
                for t, item in enumerate(ids):
                    a, b = w.bounds[t], w.bounds[t + 1]
                    n = min(window, b - a)
                    start = np.arange(a, b - n + 1) if n else np.zeros(0, np.int64)
                    out["item"] += [item] * len(start)
                    out["words"] += [w.hash[s : s + n].view(np.int64) for s in start]
                    out["w1"] += one(start, start + n).view(np.int64).tolist()
                    out["w2"] += two(start, start + n).view(np.int64).tolist()
            kinds = {"item": pa.string(), "words": pa.list_(pa.int64()), "w1": pa.int64(), "w2": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(out[n], k) for n, k in kinds.items()], names=list(kinds))

    return run


class Lookup:
    """Places of values in a sorted table; a bitmap sorts most values out first."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.bitmap = np.zeros(1 << BITS, bool)
        self.bitmap[(values >> A.U(64 - BITS)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.bitmap[(hashes >> A.U(64 - BITS)).astype(np.int64)])
        if not len(self.values) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.values, hashes[at]), len(self.values) - 1)
        ok = self.values[place] == hashes[at]
        return at[ok], place[ok]


def _count(vocabulary):
    """Occurrences of the benchmark's words, one row for each word and task."""

    def run(batches):
        lookup = Lookup(vocabulary.value)
        counts = np.zeros(len(lookup.values), np.int64)
        for batch in batches:
            data, offsets = A.utf8(batch.column("text"))
            for lo, hi in A.slices(offsets):
                _, place = lookup(_words(data, offsets[lo : hi + 1]).hash)
                counts += np.bincount(place, minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([A.longs(lookup.values[some]), pa.array(counts[some])], names=["word", "n"])

    return run


def _match(block, with_all: bool):
    """Words, hit words and items of each document."""

    def run(batches):
        b = block.value
        prefixes, first = np.unique(b["word"], return_index=True)
        size = np.diff(np.append(first, len(b["word"])))
        lookup = Lookup(prefixes)
        for batch in batches:
            data, offsets = A.utf8(batch.column("text"))
            out = {"n_words": [], "starts": [], "ends": [], "items": []}
            for lo, hi in A.slices(offsets):
                w = _words(data, offsets[lo : hi + 1])
                at, place = lookup(w.hash)
                each = size[place]
                entry = np.repeat(first[place] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                start = np.repeat(at, each) - b["place"][entry]
                end = start + b["length"][entry]
                text = np.repeat(np.searchsorted(w.bounds, at, "right") - 1, each)
                ok = (start >= w.bounds[text]) & (end <= w.bounds[text + 1])
                start, end, entry, text = start[ok], end[ok], entry[ok], text[ok]
                if len(start):
                    ok = A.RunHash(w.hash)(start, end) == b["w1"][entry]
                    ok &= A.RunHash(w.hash, A.BASES[1])(start, end) == b["w2"][entry]
                    start, end, entry, text = start[ok], end[ok], entry[ok], text[ok]
                out["n_words"] += np.diff(w.bounds).tolist()
                order = np.argsort(text, kind="stable")
                cuts = np.searchsorted(text[order], np.arange(hi - lo + 1))
                for t in range(hi - lo):
                    mine = order[cuts[t] : cuts[t + 1]]
                    out["starts"].append(start[mine] - w.bounds[t])
                    out["ends"].append(end[mine] - w.bounds[t])
                    out["items"].append(sorted({i for i in b["item"][entry[mine]] if i is not None}))
            arrays = [
                pa.array(out["n_words"], pa.int64()),
                *(pa.array(out[n], pa.list_(pa.int32())) for n in ("starts", "ends")),
                pa.array(out["items"], pa.list_(pa.string())),
            ]
            result = pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("key"), *arrays], names=["id", "key", "n_words", "starts", "ends", "items"]
            )
            yield result if with_all else result.filter(pa.array([len(s) > 0 for s in out["starts"]], pa.bool_()))

    return run


def _cover():
    def run(batches):
        for batch in batches:
            starts, ends = A.Lists(batch.column("starts")), A.Lists(batch.column("ends"))
            hit = []
            for r, n in enumerate(batch.column("n_words").to_pylist()):
                hit.append(int(A.cover(n, starts[r], ends[r]).sum()) if starts.filled[r] else 0)
            names = ["id", "n_words", "items", "starts", "ends"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(hit, pa.int64())], names=[*names, "n_hit"])

    return run


def contaminated_words(
    docs: DataFrame,
    items: DataFrame,
    window: int = 13,
    share: int = 20,
    block_bytes: int = 4 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Words of each document inside any occurrence of a window of a benchmark item.

    Rows: id, n_words, n_hit, items (sorted ids, as strings), starts and ends
    of the occurrences, contaminated (``n_hit > 0 and share * n_hit >= n_words``);
    one for each document row.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text
    (A-Z only).  An item of fewer than ``window`` words, but not none, is one
    window.  Null texts have no words; an item of null id hits words but is not
    listed; items of equal id count once.  Repeated rows are answered each.  An
    empty benchmark hits nothing, an empty document table gives an empty result;
    further columns are ignored.  ``block_bytes`` bounds the benchmark text that
    is sent to the tasks at once; more text means more passes, not fewer windows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text"))
    id_kind = f"id {docs.schema['id'].dataType.simpleString()}, key long"
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    windows = items.mapInArrow(_item_windows(window), "item string, words array<long>, w1 long, w2 long").distinct()
    windows = scratch.write(windows.withColumn("block", F.pmod(F.xxhash64("w1"), F.lit(n_blocks))), "windows")
    plain = docs.select("text")
    keyed = docs.select("id", (row_key("id", "text") if n_blocks > 1 else F.lit(0).cast("long")).alias("key"), "text")
    schema = id_kind + ", n_words long, starts array<int>, ends array<int>, items array<string>"
    parts = []
    for b in range(n_blocks):
        mine = windows.filter(F.col("block") == b)
        words = mine.select(F.explode("words").alias("word")).distinct()
        vocabulary = np.sort(np.array([r[0] for r in words.collect()], np.int64).view(A.U))
        counted = plain.mapInArrow(_count(spark.sparkContext.broadcast(vocabulary)), "word long, n long")
        counts = counted.groupBy("word").agg(F.sum("n").alias("n"))
        rare = mine.select("*", F.posexplode("words").alias("place", "word")).join(counts, "word", "left")
        rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place")).alias("p")
        rare = rare.groupBy("item", "w1", "w2", F.size("words").alias("length")).agg(rarest)
        rows = rare.select("p.word", "p.place", "length", "w1", "w2", "item").toPandas().sort_values("word", key=lambda s: s.astype("uint64"))
        block = {n: rows[n].to_numpy() for n in FIELDS}
        block |= {n: block[n].astype(np.int64).view(A.U) for n in ("word", "w1", "w2")}
        block |= {n: block[n].astype(np.int64) for n in ("place", "length")}
        parts.append(keyed.mapInArrow(_match(spark.sparkContext.broadcast(block), n_blocks == 1 or b == 0), schema))
    found = parts[0]
    if n_blocks > 1:
        every = parts[0].select("id", "key", "n_words")
        hits = parts[0].filter("size(starts) > 0")
        for part in parts[1:]:
            hits = hits.unionByName(part)
        flat = [F.array_distinct(F.flatten(F.collect_list(n))).alias(n) for n in ("items",)]
        flat += [F.flatten(F.collect_list(n)).alias(n) for n in ("starts", "ends")]
        hits = hits.dropDuplicates(["key", "starts", "items"]).groupBy("key").agg(*flat)
        found = every.join(hits.withColumn("items", F.array_sort("items")), "key", "left")
        empty = F.array().cast("array<string>")
        found = found.withColumn("items", F.coalesce("items", empty))
    schema = f"{id_kind.split(',')[0]}, n_words long, items array<string>, starts array<int>, ends array<int>, n_hit long"
    out = found.select("id", "n_words", "items", "starts", "ends").mapInArrow(_cover(), schema)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


@query("op7_decontaminate")
def op7(spark, sf_dir):
    found = contaminated_words(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
