"""Windows of fixed length that occur again: the shared core of the two substring operators.

Texts are parsed at content-defined anchors (rolling-hash minima, see
``arrays.Parse``).  Equal stretches have equal anchors, and every window has at
least one anchor whose whole neighbourhood lies inside it.  So

1. the neighbourhoods of all anchors are counted (the dictionary); a window
   that holds a neighbourhood found once cannot occur again and is settled.
   The names found again go to the tasks as a bitmap of fixed size: what it lets
   through by chance is settled by the counts of step 2.  Texts are parsed where
   they are read; only those asked or cut in a later step are shuffled for it;
2. the other windows form groups: consecutive windows that hold the same
   anchors.  A group has two names: its core, from the first to the last of
   these neighbourhoods, which all its windows share, and its whole, from the
   first byte of its first window to the last byte of its last.  Groups of
   equal whole are settled together: all their windows occur in each of them;
3. what is left are groups of equal core and different wholes, at the ends of
   repeats.  One group of each whole names its windows, which are counted one
   by one; what is found in it holds at the same offsets for the other groups
   of this whole that step 2 did not settle.

Counts are aggregated before they are shuffled, so a passage in a third of all
texts is a row per task; the rows that look up a count are joined with a table
that has one row for each name, which adaptive execution can split.  Nothing
is collected and no pair of texts is ever formed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import arrays as A
from .base import Scratch, row_key
from .bits import bitmap, marked, rows_of


@dataclass(frozen=True)
class Windows:
    """``length`` bytes or words; ``unit`` values overlap by ``width``."""

    kind: str
    length: int

    @property
    def width(self) -> int:
        return 16 if self.kind == "bytes" else 2

    @property
    def units(self) -> int:
        return self.length - self.width + 1

    @property
    def k(self) -> int:
        """The sparsest anchors of which each window still holds one for sure."""
        return (self.units + 2) // 3

    def parse(self, data: np.ndarray, offsets: np.ndarray) -> tuple[A.Parse, A.Words | None]:
        if self.kind == "bytes":
            return A.byte_parse(data, offsets, self.k, self.width), None
        words = A.Words(data, offsets)
        return A.word_parse(words, self.k), words


def _anchors(spec: Windows, ordered: bool, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Names of the anchors' neighbourhoods: with their number in a slice of texts, or, ordered, with the text's place."""

    def run(batches):
        for batch in batches:
            data, offsets = A.utf8(batch.column("text"))
            for lo, hi in A.slices(offsets):
                parse, _ = spec.parse(data, offsets[lo : hi + 1])
                if not len(parse.at):
                    continue
                names = parse.neighbourhoods()
                if ordered:
                    columns = [A.longs(names), batch.column("ord").take(pa.array(parse.text + lo))]
                else:
                    names, count = np.unique(names, return_counts=True)
                    columns = [A.longs(names), A.longs(count)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _groups(spec: Windows, parse: A.Parse, t: int, known: np.ndarray):
    """Groups of windows of text ``t`` that may occur again: first and last start, core.  ``known`` tells of each anchor whether it may."""
    lo, hi = parse.bounds[t], parse.bounds[t + 1]
    k, n, m, s = spec.k, spec.units, int(parse.counts[t]), parse.starts[t]
    at = parse.at[lo:hi] - s
    if m < n or not len(at):
        return None
    i = np.arange(m - n + 1)
    a, b = np.searchsorted(at, i + k - 1), np.searchsorted(at, i + n - k, "right")
    total = np.concatenate(([0], np.cumsum(known[lo:hi])))
    i, a, b = (x[total[b] - total[a] == b - a] for x in (i, a, b))
    if not len(i):
        return None
    cut = np.flatnonzero((np.diff(i) > 1) | (np.diff(a) > 0) | (np.diff(b) > 0))
    first, last = np.append(0, cut + 1), np.append(cut, len(i) - 1)
    core = parse.runs(s + at[a[first]] - k + 1, s + at[b[first] - 1] + k)
    return i[first], i[last], core.view(np.int64)


def _parsed(spec: Windows, ordered: bool, dictionary, schema: pa.Schema):
    """Size, digest and groups of each text."""

    def run(batches):
        for batch in batches:
            data, offsets = A.utf8(batch.column("text"))
            owners = batch.column("ord").is_valid().to_pylist() if ordered else [True] * len(batch)
            out = {n: [None] * len(batch) for n in ("digest", "n", "i0", "i1", "core", "w1", "w2")}
            for lo, hi in A.slices(offsets):
                parse, words = spec.parse(data, offsets[lo : hi + 1])
                known = marked(dictionary.value, parse.neighbourhoods()).astype(np.int64)
                for r in range(lo, hi):
                    raw = data[offsets[r] : offsets[r + 1]]
                    out["n"][r] = len(raw) if words is None else int(words.bounds[r - lo + 1] - words.bounds[r - lo])
                    kept = raw if words is None else b" ".join(raw.tobytes().split())
                    out["digest"][r] = hashlib.sha256(kept).hexdigest()
                    groups = _groups(spec, parse, r - lo, known) if owners[r] else None
                    if groups is not None:
                        out["i0"][r], out["i1"][r], out["core"][r] = groups
                        out["w1"][r], out["w2"][r] = _names(spec, parse, r - lo, groups[0], groups[1])
            yield _batch(batch, out, schema)

    return run


def _names(spec: Windows, parse: A.Parse, t: int, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two names of each range from window ``first`` to window ``last``."""
    start, end = parse.starts[t] + first, parse.starts[t] + last + spec.units
    if not hasattr(parse, "twin"):
        parse.twin = A.RunHash(parse.units, A.BASES[1])
    return parse.runs(start, end).view(np.int64), parse.twin(start, end).view(np.int64)


def _batch(batch: pa.RecordBatch, out: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(out[f.name], f.type) if f.name in out else batch.column(f.name) for f in schema]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _windows(spec: Windows, schema: pa.Schema, again=None):
    """Names of the windows of the groups to be looked at one by one: all, or those that may be among ``again``."""

    def run(batches):
        for batch in batches:
            data, offsets = A.utf8(batch.column("text"))
            asked = A.Lists(batch.column("asked"))
            for lo, hi in A.slices(offsets):
                parse, _ = spec.parse(data, offsets[lo : hi + 1])
                for r in range(lo, hi):
                    a = asked.fields(r)
                    own = a["i1"] + spec.units <= parse.counts[r - lo]
                    first, length = a["i0"][own].astype(np.int64), (a["i1"] - a["i0"] + 1)[own]
                    w1, _ = _names(spec, parse, r - lo, first, first + length - 1)
                    own = w1 == a["w1"][own]
                    first, length = first[own], length[own]
                    start = np.repeat(first, length)
                    if not len(first):
                        continue
                    win = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(length.sum())
                    out = dict(zip(("f1", "f2"), _names(spec, parse, r - lo, win, win)))
                    out["win"], out["i0"] = win, start
                    if again is not None:
                        own = marked(again.value, out["f1"].view(A.U))
                        out = {n: x[own] for n, x in out.items()}
                    rows = pa.array(np.full(len(out["win"]), r))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out[f.name], f.type) if f.name in out else batch.column(f.name).take(rows) for f in schema],
                        schema=schema,
                    )

    return run


def _finish(spec: Windows, schema: pa.Schema):
    """Texts without the windows found."""

    def run(batches):
        for batch in batches:
            get = {n: batch.column(n).to_pylist() for n in ("text", "digest")}
            settled, found, w1 = (A.Lists(batch.column(n)) for n in ("settled", "found", "w1"))
            out = {"n": [], "spans": [], "kept": [], "kept_sha256": [], "n_removed": []}
            for r, text in enumerate(get["text"]):
                raw = text.encode()
                words = raw.split() if spec.kind == "words" else raw
                same = hashlib.sha256(b" ".join(words) if spec.kind == "words" else raw).hexdigest() == get["digest"][r]
                s, f = settled.fields(r), found.fields(r)
                own = np.isin(s["w1"], w1[r]) & same  # rows may meet in a key: what was found in another text does not hold
                win = f["win"] if same else f["win"][:0]
                if len(win):
                    parse, _ = spec.parse(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    win = win[win + spec.units <= parse.counts[0]]
                    names, _ = _names(spec, parse, 0, win, win)
                    win = win[np.isin(A.pair_hash(names, win), A.pair_hash(f["f1"], f["win"]))]
                gone = A.cover(
                    len(words),
                    np.concatenate((s["i0"][own], win)),
                    np.concatenate((s["i1"][own], win)) + spec.length,
                )
                starts, ends = A.spans(gone)
                if spec.kind == "bytes":
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                else:
                    kept = b" ".join(w for w, g in zip(words, gone) if not g)
                out["n"].append(len(words))
                out["spans"].append([{"start": int(s), "end": int(e)} for s, e in zip(starts, ends)])
                out["n_removed"].append(int((ends - starts).sum()))
                out["kept"].append(kept if len(starts) else None)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            yield _batch(batch, out, schema)

    return run


def _schema(columns: str, df: DataFrame, more: dict[str, str]) -> tuple[StructType, pa.Schema]:
    """Spark and Arrow schema of: the named columns of df, then new ones."""
    old = [df.schema[c] for c in columns.split() if c in df.columns]
    new = StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in more.items()))
    schema = StructType(old + new.fields)
    return schema, to_arrow_schema(schema)


def repeated_windows(docs: DataFrame, spec: Windows, ordered: bool) -> DataFrame:
    """Cover of all windows of ``docs`` (id, text) that also start elsewhere.

    ``ordered``: only places in a row with a smaller id count; a null id is
    neither smaller nor larger.  One output row for each input row: id, n
    (bytes or words), n_removed, spans, kept (bytes left; null if nothing was
    removed), kept_sha256.
    """
    scratch = Scratch(docs.sparkSession, f"repeated-{spec.kind}")
    rank = ["ord"] if ordered else []
    docs = docs.select("id", "text", row_key("id", "text").alias("key"), *[F.col("id").alias(c) for c in rank])

    schema, arrow = _schema("", docs, {"h": "long"} | ({"ord": docs.schema["ord"].dataType.simpleString()} if ordered else {"n": "long"}))
    anchors = docs.mapInArrow(_anchors(spec, ordered, arrow), schema)
    counts = [F.min("ord").alias("lo"), F.max("ord").alias("hi")] if ordered else [F.sum("n").alias("n")]
    again = F.col("lo") < F.col("hi") if ordered else F.col("n") > 1
    dictionary = scratch.write(anchors.groupBy("h").agg(*counts).filter(again).select("h"), "dictionary")
    known = bitmap(dictionary)
    scratch.drop(dictionary)

    more = {n: "array<int>" for n in ("i0", "i1")} | {n: "array<long>" for n in ("core", "w1", "w2")}
    schema, arrow = _schema("id key ord", docs, {"digest": "string", "n": "long", **more})
    work = scratch.write(docs.mapInArrow(_parsed(spec, ordered, known, arrow), schema), "work")
    known.destroy()
    counts = counts if ordered else [F.count("*").alias("n")]

    groups = work.filter("i0 is not null").select("key", *rank, F.explode(F.arrays_zip(*more)).alias("g")).select("key", *rank, "g.*")
    whole = ["core", "w1", "w2"]
    first = F.min(F.struct(*rank, "key", "i0", "i1")).alias("first")
    wholes = scratch.write(groups.groupBy(*whole).agg(*(counts[:1] if ordered else counts), first), "wholes")
    twice = groups.join(wholes.filter("true" if ordered else "n > 1").drop("first"), whole)
    if ordered:  # wholes that start in no smaller id, but again within their own
        rest = groups.join(wholes, whole).filter("lo = ord and (key <> first.key or i0 <> first.i0)")
        rest = rest.select(F.col("key").alias("own"), (F.col("i0") - F.col("first.i0")).alias("by"), F.col("first.key").alias("key"), F.col("first.i0").alias("i0"))
        rest = scratch.write(rest.distinct(), "rest")
    twice = twice.filter("lo < ord") if ordered else twice
    settled = twice.groupBy("key").agg(F.collect_set(F.struct("i0", "i1", "w1")).alias("settled"))
    open_cores = wholes.groupBy("core").agg(F.count("*").alias("m")).filter("m > 1").select("core")
    asked = wholes.join(open_cores, "core").select("first.key", "first.i0", "first.i1", "w1")
    asked = asked.groupBy("key").agg(F.collect_set(F.struct("i0", "i1", "w1")).alias("asked"))

    # Names are counted without being kept; a second reading gives out those found again.
    texts = scratch.write(rows_of(docs.select("key", *rank, "text"), scratch.write(asked, "asked")), "texts")
    schema, arrow = _schema("ord", texts, {"f1": "long", "f2": "long"})
    named = texts.mapInArrow(_windows(spec, arrow), schema).groupBy("f1", "f2").agg(*counts).filter(again)
    names = scratch.write(named, "names")
    seen = bitmap(names.select(F.col("f1").alias("h")))
    schema, arrow = _schema("key ord", texts, {"win": "int", "f1": "long", "f2": "long"} | ({"i0": "int"} if ordered else {}))
    found = texts.mapInArrow(_windows(spec, arrow, seen), schema).join(names, ["f1", "f2"])
    if ordered:
        found = scratch.write(found.filter("lo < ord").select("key", "i0", "win", "f1"), "found")
        same = found.join(rest, ["key", "i0"]).select(F.col("own").alias("key"), (F.col("win") + F.col("by")).alias("win"), "f1")
        all_found = found.select("key", "win", "f1").union(same)
    else:
        all_found = found
    places = all_found.groupBy("key").agg(F.collect_set(F.struct("win", "f1")).alias("found"))
    ends = scratch.write(settled.join(places, "key", "full"), "ends")
    named = work.select("key", "digest", "w1").join(ends, "key").dropDuplicates(["key"])
    ends = scratch.write(named, "named")
    seen.destroy()
    scratch.drop(wholes, texts, names, *([rest, found] if ordered else []))

    more = {"n_removed": "long", "spans": "array<struct<start:int,end:int>>", "kept": "binary", "kept_sha256": "string"}
    schema, arrow = _schema("id", work, {"n": "long", **more})
    cut = rows_of(docs.select("key", "id", "text"), ends).mapInArrow(_finish(spec, arrow), schema)
    whole = work.join(ends.select("key"), "key", "left_anti").select(
        "id", "n", F.lit(0).cast("long").alias("n_removed"), F.array().cast(more["spans"]).alias("spans"),
        F.lit(None).cast("binary").alias("kept"), F.col("digest").alias("kept_sha256"),
    )
    return cut.unionByName(whole)
