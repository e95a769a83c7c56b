"""Vectorised text kernels over Arrow batches: words, word hashes and shingles without a Python object per word.

Texts are handled as the UTF-8 bytes that Arrow already holds. A word is a maximal run of bytes other than
space and 0x09-0x0D. Null texts count as empty. All hashes are 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of text that a kernel works on at a time (a longer single text is worked on whole).
CHUNK_BYTES = 1 << 19

_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept for the life of the worker."""
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, CHUNK_BYTES + 1), b, _U)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit over the whole word."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def seeded(x: int) -> np.uint64:
    """The same finaliser for one Python integer."""
    x &= _MASK
    for _ in range(2):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & _MASK
    return _U(x ^ (x >> 32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its texts (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not wide and not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column, wide = column.cast(pa.large_string()), True
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = 0) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about CHUNK_BYTES together; a longer text stands alone."""
    most = most or CHUNK_BYTES
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


class Words:
    """The words of a few texts: start, end, text index and 64-bit hash of each, and word offsets per text."""

    __slots__ = ("doc", "ends", "hashes", "offsets", "starts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, strip: np.ndarray | None = None):
        size, n = len(data), len(offsets) - 1
        inside = ~SPACE[data]
        edge = np.zeros(size + 1, bool)
        edge[offsets] = True
        before = np.empty(size, bool)
        if size:
            before[0] = False
            before[1:] = inside[:-1]
        self.starts = np.flatnonzero(inside & (edge[:size] | ~before))
        after = np.empty(size, bool)
        if size:
            after[-1] = False
            after[:-1] = inside[1:]
        self.ends = np.flatnonzero(inside & (edge[1:] | ~after)) + 1
        self.offsets = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(n), np.diff(self.offsets))
        values = _VALUES[LOWER] if lower else _VALUES
        if strip is not None and len(self.starts):  # up to four such bytes at either end are not part of the word
            for _ in range(4):
                inner = self.ends - self.starts > 1
                self.starts = self.starts + (strip[data[self.starts]] & inner)
                inner = self.ends - self.starts > 1
                self.ends = self.ends - (strip[data[self.ends - 1]] & inner)
        power, inverse = _power_tables(size + 1)
        sums = np.zeros(size + 1, _U)
        np.cumsum(values[data] * power[:size], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(_U))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words within a text, and the index of the first word of each."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.zeros(0, _U), np.zeros(0, np.int64)
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        total = np.zeros(n, _U)
        for i in range(k):
            total += self.hashes[i : i + n] * seeded(77 + i)
        return mix(total[at]), at


def prefix_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Hash of the first k bytes (or fewer, in a shorter word) of each word, A-Z lower-cased."""
    h = np.zeros(len(starts), _U)
    size = len(data)
    for i in range(k):
        at = starts + i
        live = at < ends
        h = np.where(live, h * _U(_BASE) + _VALUES[LOWER[data[np.minimum(at, size - 1)]]], h) if size else h
    return mix(h + _U(k))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text as sorted hashes, and n + 1 offsets into them.

    A text of fewer than k words has its whole word sequence as its one shingle; one without words has none.
    """
    n = len(offsets) - 1
    words = Words(data, offsets)
    hashes, at = words.grams(k)
    doc = words.doc[at]
    counts = np.diff(words.offsets)
    few = np.flatnonzero((counts > 0) & (counts < k))
    if len(few):
        extra = np.zeros(len(few), _U)
        for i in range(k - 1):
            live = counts[few] > i
            extra[live] += words.hashes[words.offsets[few[live]] + i] * seeded(77 + i)
        extra = mix(extra + counts[few].astype(_U) * seeded(991))
        hashes, doc = np.concatenate([hashes, extra]), np.concatenate([doc, few])
    if len(few):
        order = np.argsort(doc, kind="stable")
        hashes, doc = hashes[order], doc[order]
    bounds = np.searchsorted(doc, np.arange(n + 1))
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        hashes[lo:hi].sort()
    if len(hashes):
        keep = np.ones(len(hashes), bool)
        keep[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
        hashes, doc = hashes[keep], doc[keep]
    return hashes, np.searchsorted(doc, np.arange(n + 1))
