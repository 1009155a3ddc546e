"""Array code for whole texts: words, hashes of runs, and content-defined anchors.

Everything works on the bytes of many texts at once, in slices of about 256 kB
(a longer text is a slice of its own), so memory follows the longest text.
Hashes are 64-bit and mixed; where a wrong meeting would change a result, two
independent hashes are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
NONE = U(0xFFFFFFFFFFFFFFFF)
SLICE = 1 << 18
BASES = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93))

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[0x41:0x5B] += 0x20


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, limit: int = SLICE):
    """Ranges of texts of about ``limit`` bytes; at least one text each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, 1024), base, U)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 4 * SLICE:
            _POWERS[int(base)] = have
    return have[:n]


def inverse(base: np.uint64) -> np.uint64:
    return U(pow(int(base), -1, 1 << 64))


class Words:
    """Words of some texts: first byte, end, hash, and the range of words of each text.

    ``kind`` tells for each byte which kind of word it belongs to, 0 or false for none.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE, fold: np.ndarray = AS_IS):
        base = offsets[0]
        data, offsets = fold[data[base : offsets[-1]]], offsets - base
        kinds = kind[data]
        inside = kinds.view(np.uint8) > 0
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        first, last = inside.copy(), inside.copy()
        change = (kinds[1:] != kinds[:-1]) | edge[1:-1]
        first[1:] &= change
        last[:-1] &= change
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.data, self.offsets = data, offsets
        self.bounds = np.searchsorted(self.start, offsets)
        self.hash = self._hashes(inside)

    def _hashes(self, inside: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, U)
        length = self.end - self.start
        at = np.flatnonzero(inside)
        begins = np.cumsum(length) - length
        place = np.arange(len(at)) - np.repeat(begins, length)
        terms = (self.data[at].astype(U) + U(1)) * powers(BASES[0], int(length.max()))[place]
        return mix(np.add.reduceat(terms, begins) + length.astype(U) * BASES[1])

    def text(self, i: int) -> np.ndarray:
        return self.data[self.offsets[i] : self.offsets[i + 1]]


def join_hash(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive values (also across texts: the caller takes the ranges inside one text)."""
    if len(hashes) < n:
        return np.zeros(0, U)
    out = hashes[: len(hashes) - n + 1]
    for j in range(1, n):
        out = mix(out * BASES[0] + hashes[j : len(hashes) - n + 1 + j])
    return out


class RunHash:
    """Hash of any run of an array of hashes, by prefix sums of a polynomial modulo 2 ** 64."""

    def __init__(self, units: np.ndarray, base: np.uint64 = BASES[0]):
        n = len(units)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(units * powers(base, n), out=self.sums[1:])
        self.back = powers(inverse(base), n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(U) * BASES[1])


def _sliding(a: np.ndarray, k: int, pick) -> np.ndarray:
    span = 1
    while 2 * span <= k:
        a = pick(a[:-span], a[span:])
        span *= 2
    return pick(a[: len(a) - (k - span)], a[k - span :]) if span < k else a


class Parse:
    """Units of some texts, laid out with gaps, and their anchors.

    A unit is an anchor if it is the smallest of some ``k`` consecutive units of
    its text.  Whether a unit is one depends only on the ``k - 1`` units to each
    side, so equal stretches have equal anchors, and any ``k`` units have one.
    The neighbourhood of an anchor is those ``2 k - 1`` units; only anchors
    whose neighbourhood lies in the text are kept.
    """

    def __init__(self, units: np.ndarray, starts: np.ndarray, counts: np.ndarray, k: int):
        self.units, self.starts, self.counts, self.k = units, starts, counts, k
        low = _sliding(units, k, np.minimum)
        high = _sliding(low, k, np.maximum)
        at = np.flatnonzero((high == units[k - 1 : k - 1 + len(high)]) & (units[k - 1 : k - 1 + len(high)] != NONE)) + k - 1
        text = np.searchsorted(starts, at, "right") - 1
        ok = (at - starts[text] >= k - 1) & (at + k <= starts[text] + counts[text])
        self.at = at[ok]
        self.text = text[ok]
        self.bounds = np.searchsorted(self.at, np.append(starts, len(units)))
        self.runs = RunHash(units)

    def neighbourhoods(self) -> np.ndarray:
        return self.runs(self.at - self.k + 1, self.at + self.k)


def _layout(lengths: np.ndarray, gap: int) -> np.ndarray:
    return gap + np.cumsum(lengths + gap) - (lengths + gap)


def byte_parse(data: np.ndarray, offsets: np.ndarray, k: int, width: int = 16) -> Parse:
    """Unit i: rolling hash of the ``width`` bytes from byte i (a power of two)."""
    lengths = np.diff(offsets)
    starts = _layout(lengths, k + width)
    total = int(starts[-1] + lengths[-1]) + k + width
    laid = np.zeros(total, np.uint8)
    laid[np.arange(offsets[-1] - offsets[0]) + np.repeat(starts - (offsets[:-1] - offsets[0]), lengths)] = data[offsets[0] : offsets[-1]]
    h, span = laid.astype(U) + U(1), 1
    while span < width:
        h = h[:-span] * U(pow(int(BASES[span & 1]), 2 * span + 1, 1 << 64)) + h[span:]
        span *= 2
    counts = np.maximum(lengths - width + 1, 0)
    units = np.full(total, NONE)
    h = mix(h)
    for s, c in zip(starts, counts):
        units[s : s + c] = h[s : s + c]
    return Parse(units, starts, counts, k)


def word_parse(words: Words, k: int) -> Parse:
    """Unit i: hash of words i and i + 1."""
    counts = np.maximum(np.diff(words.bounds) - 1, 0)
    starts = _layout(counts, k + 1)
    units = np.full(int(starts[-1] + counts[-1]) + k + 1, NONE)
    pairs = join_hash(words.hash, 2)
    for s, c, b in zip(starts, counts, words.bounds):
        units[s : s + c] = pairs[b : b + c]
    return Parse(units, starts, counts, k)


def spans(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of true."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def cover(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the ranges."""
    steps = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(steps[:-1]) > 0


def longs(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64) if a.dtype == U else a.astype(np.int64), pa.int64())


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a.view(U) * BASES[0] + b.astype(U))


class Lists:
    """A list column as slices of flat arrays; null counts as empty."""

    def __init__(self, column: pa.Array):
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
        self.start, self.end = offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        self.end = np.where(valid, self.end, self.start)
        self.filled = self.end > self.start
        values = column.values
        if pa.types.is_struct(values.type):
            self.flat = {f.name: values.field(f.name).to_numpy(zero_copy_only=False) for f in values.type}
        else:
            self.flat = values.to_numpy(zero_copy_only=False)

    def __getitem__(self, r: int) -> np.ndarray:
        return self.flat[self.start[r] : self.end[r]]

    def fields(self, r: int) -> dict[str, np.ndarray]:
        return {n: a[self.start[r] : self.end[r]] for n, a in self.flat.items()}
