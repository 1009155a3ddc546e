"""Words of whole texts, cut in Arrow buffers.

The class of a character is read from a table, so no pattern is run and no row
is made for a word that is only counted.  A text is never larger than its row;
a batch is taken in slices of bounded size.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE, LETTER, NUMBER, SIGN = range(4)

# Bytes of text that are cut at a time.
SLICE = 1 << 24

#: Which words to give, from their numbers of characters and first code points.
Shape = Callable[[np.ndarray, np.ndarray], np.ndarray]


@lru_cache(1)
def _table() -> np.ndarray:
    """Class of each code point; what is no letter, number or space is a sign."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], SIGN) for c in range(0x110000)), np.uint8, 0x110000)
    out[[ord(c) for c in " \t\n\f\r"]] = SPACE
    return out


def _codes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points that begin at the bytes ``at``."""
    lead = data[at].astype(np.int32)
    code = lead.copy()
    rest = lambda k: (data[np.minimum(at + k, len(data) - 1)] & 0x3F).astype(np.int32)
    two = (lead >> 6 & 3) == 3
    if two.any():
        one = rest(1)
        code = np.where(two, (lead & 0x1F) << 6 | one, code)
        three = lead >= 0xE0
        if three.any():
            both = one << 6 | rest(2)
            code = np.where(three, (lead & 0x0F) << 12 | both, code)
            code = np.where(lead >= 0xF0, (lead & 0x07) << 18 | both << 6 | rest(3), code)
    return np.minimum(code, 0x10FFFF)


def _classes(data: np.ndarray) -> np.ndarray:
    """Class of the character of each byte."""
    low = np.zeros(256, np.uint8)
    low[:128] = _table()[:128]
    out = low[data]
    at = np.flatnonzero(data >= 0xC0)
    if len(at):
        kind = _table()[_codes(data, at)]
        out[at] = kind
        for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            more = (data[at] >= least) & (at + k < len(data))
            out[at[more] + k] = kind[more]
    return out


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    column = column.cast(pa.string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``SLICE`` bytes, one row at least."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        yield lo, hi
        lo = hi


def _cut(data: np.ndarray, offsets: np.ndarray, signs: bool, shape: Shape | None) -> tuple[np.ndarray, pa.Array]:
    """(list offsets, words) of the rows between the given offsets."""
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    kind = _classes(data)
    keep = kind != SPACE if signs else kind == LETTER
    begins = np.empty(len(data), bool)
    begins[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    if signs:
        begins |= (kind == SIGN) & ((data & 0xC0) != 0x80)
    starts = np.flatnonzero(begins & keep)
    ends = np.cumsum(keep, dtype=np.int32)
    places = np.append(ends[starts] - 1, ends[-1] if len(ends) else 0).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(data[keep]))
    if shape is not None and len(starts):
        leads = np.cumsum((data[keep] & 0xC0) != 0x80, dtype=np.int32)
        fit = shape(np.diff(np.append(leads[places[:-1]] - 1, leads[-1])), _codes(data, starts))
        words, starts = words.filter(pa.array(fit)), starts[fit]
    return np.searchsorted(starts, offsets).astype(np.int32), words


def _once(lists: np.ndarray, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The same with each word of a row once."""
    coded = words.dictionary_encode()
    rows = np.repeat(np.arange(len(lists) - 1), np.diff(lists))
    size = max(len(coded.dictionary), 1)
    both = np.unique(rows * size + coded.indices.to_numpy())
    return np.searchsorted(both, np.arange(len(lists)) * size).astype(np.int32), coded.dictionary.take(pa.array(both % size))


def _lists(text: str, names: list[str], out: str, signs: bool, shape: Shape | None, once: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _strings(batch.column(text))
            for lo, hi in _slices(offsets):
                lists, words = _cut(data, offsets[lo : hi + 1], signs, shape)
                if once:
                    lists, words = _once(lists, words)
                found = pa.ListArray.from_arrays(pa.array(lists), words)
                yield pa.RecordBatch.from_arrays([*[batch.column(n).slice(lo, hi - lo) for n in names], found], [*names, out])

    return run


def word_lists(texts: DataFrame, text: str, out: str = "ws", signs: bool = False, shape: Shape | None = None, once: bool = False) -> DataFrame:
    """Rows with the words of ``text`` in its place, as an array in their order; none for null.

    Words are runs of letters; with ``signs`` also runs of numbers and single
    other characters but spaces.  ``shape`` leaves words out; with ``once`` a
    word comes once, in any order.
    """
    names = [c for c in texts.columns if c != text]
    schema = ", ".join([*[f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in names], f"`{out}` array<string>"])
    return texts.mapInArrow(_lists(text, names, out, signs, shape, once), schema)


def _runs(text: str, names: list[str], out: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _strings(batch.column(text))
            for lo, hi in _slices(offsets):
                lists, words = _cut(data, offsets[lo : hi + 1], False, None)
                count = -(-np.diff(lists) // size)
                row = np.repeat(np.arange(hi - lo), count)
                part = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                cuts = np.append(lists[:-1][row] + part * size, lists[-1]).astype(np.int32)
                found = pa.ListArray.from_arrays(pa.array(cuts), words)
                rows = [batch.column(n).slice(lo, hi - lo).take(pa.array(row)) for n in names]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(part.astype(np.int32)), found], [*names, "part", out])

    return run


def word_runs(texts: DataFrame, text: str, size: int, out: str = "ws") -> DataFrame:
    """``word_lists`` cut into parts of ``size`` words, a row each; ``part`` counts them from 0, and a text without words has none."""
    names = [c for c in texts.columns if c != text]
    schema = ", ".join([*[f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in names], "part int", f"`{out}` array<string>"])
    return texts.mapInArrow(_runs(text, names, out, size), schema)


def _counted(text: str, shape: Shape | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _strings(batch.column(text))
            for lo, hi in _slices(offsets):
                words = pc.value_counts(_cut(data, offsets[lo : hi + 1], False, shape)[1])
                yield pa.RecordBatch.from_arrays(words.flatten(), ["w", "n"])

    return run


def word_counts(texts: DataFrame, text: str, shape: Shape | None = None) -> DataFrame:
    """(w, n): how often each word of all texts comes; a slice of texts is counted where it is read."""
    return texts.select(text).mapInArrow(_counted(text, shape), "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _joined(text: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _strings(batch.column(text))
            for lo, hi in _slices(offsets):
                lists, words = _cut(data, offsets[lo : hi + 1], False, None)
                line = pc.binary_join(pa.ListArray.from_arrays(pa.array(lists), words), " ")
                columns = [pc.if_else(pc.is_valid(batch.column(n).slice(lo, hi - lo)), line, None) if n == text else batch.column(n).slice(lo, hi - lo) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def letters_only(texts: DataFrame, text: str) -> DataFrame:
    """Rows whose ``text`` is its words, joined by blanks; null stays."""
    return texts.mapInArrow(_joined(text, texts.columns), texts.schema)
