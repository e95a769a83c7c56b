"""Column-wise construction of the Burrows-Wheeler transform and common prefixes of a collection of strings.

The strings are taken from their ends: round j inserts, for every string of at least j symbols, its suffix of length
j. Where a suffix goes follows from the transform so far, and the common prefixes of a new suffix with its neighbours
from the least common prefix since the last time its first symbol was seen. Both sequences live in files that each
round reads once from front to back and writes once from front to back; in memory are one piece of them, a few
numbers per symbol, and one position per string.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow.fs as pafs

#: Entries of a file that are handled at a time: what fits a core's cache sorts fastest.
PIECE = 1 << 16


class SequentialFile:
    """A file in the shared folder of entries of two bytes that are written once, in order, and then read in order."""

    def __init__(self, folder: str):
        self.fs, base = _opened(folder)
        self.path = f"{base}/column-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.path, compression=None, buffer_size=4 * PIECE)

    def write(self, data: np.ndarray) -> None:
        self.out.write(data)

    def read(self) -> Iterator[np.ndarray]:
        self.out.close()
        with self.fs.open_input_stream(self.path, compression=None) as source:
            while data := source.read(2 * PIECE):
                yield np.frombuffer(data, np.uint16)

    def drop(self) -> None:
        self.out.close()
        self.fs.delete_file(self.path)


@lru_cache(maxsize=4)
def _opened(folder: str) -> tuple:
    """File system and path of a folder, which is made if need be."""
    fs, base = pafs.FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    return fs, base


def _least_between(prefixes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Smallest of prefixes[start:stop] for each pair. Pairs in falling order keep the scan to these ranges."""
    if not len(start):
        return np.zeros(0, np.uint8)
    where = np.empty(2 * len(start), np.int64)
    where[::2], where[1::2] = start[::-1], stop[::-1]
    return np.minimum.reduceat(prefixes, where)[::2][::-1]


def _least_up_to(prefixes: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Smallest of prefixes[: stop] for each stop from 1 up, by one pass over the pieces between them."""
    order = np.argsort(stops, kind="stable")
    cut = np.concatenate([[0], stops[order]])
    pieces = np.full(len(stops), 255, np.uint8)
    some = np.flatnonzero(np.diff(cut) > 0)
    if len(some):
        pieces[some] = np.minimum.reduceat(prefixes[: cut[-1]], cut[some])
    out = np.empty(len(stops), np.uint8)
    out[order] = np.minimum.accumulate(pieces)
    return out


def build(symbols: np.ndarray, offsets: np.ndarray, folder: str) -> tuple[np.ndarray, np.ndarray]:
    """Transform (0 marks a string's start) and common prefixes, for strings symbols[offsets[i]:offsets[i + 1]].

    Symbols are 1 to 255; lengths must stay below 255. Ends of strings differ from one another and sort before all
    symbols, in the order of the strings. The first len(offsets) - 1 entries are the empty suffixes. In the file, an
    entry is two bytes: its symbol times 256, and its common prefix with the entry before.
    """
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    padded = np.concatenate([symbols, np.zeros(1, np.uint8)])

    def before(strings: np.ndarray, j: int) -> np.ndarray:
        """The symbol before each string's suffix of length j, 0 where that is the whole string."""
        return np.where(lengths[strings] > j, padded[np.maximum(offsets[strings + 1] - 1 - j, 0)], 0).astype(np.uint16)

    everyone, codes = np.arange(n), np.arange(256, dtype=np.uint8)
    last = before(everyone, 0)
    entries = SequentialFile(folder)
    entries.write(last << 8)
    totals = np.bincount(last, minlength=256)
    live = lengths > 0
    who, at = everyone[live], everyone[live]
    for j in range(1, int(lengths.max(initial=0)) + 1):
        # where symbols' blocks begin in the next list: after the empty suffixes, by symbol
        first = n + np.cumsum(totals) - totals - totals[0]
        seen, carry = np.zeros(256, np.int64), np.full(256, 255, np.uint8)
        new_at, new_from, new_lcp, fix_at, fix_lcp = [], [], [], [], []
        lo = k = 0
        for piece in entries.read():
            size = len(piece)
            k2 = int(np.searchsorted(at, lo + size))
            halves = piece.astype("<u2", copy=False).view(np.uint8)
            symbol, prefix = halves[1::2].copy(), np.empty(size + 1, np.uint8)
            prefix[:size] = halves[::2]
            prefix[size] = 255
            active, here = np.zeros(size, bool), at[k:k2] - lo  # where a string's suffix is new
            active[here] = True
            order = np.argsort(symbol, kind="stable")
            ordered = symbol.take(order)
            begin = np.append(np.searchsorted(ordered, codes), size)
            counts = np.diff(begin)
            present = np.flatnonzero(counts)
            is_new = active.take(order)
            chosen = is_new.copy()
            chosen[1:] |= is_new[:-1]  # the next of its symbol after a new one
            chosen[begin[present]] = True
            chosen[: begin[1]] = False
            t = np.flatnonzero(chosen)
            if len(t):
                c = ordered[t].astype(np.int64)
                alone = t == begin[c]
                value = np.empty(len(t), np.uint8)
                inner = t[~alone]
                value[~alone] = _least_between(prefix, order[inner - 1] + 1, order[inner] + 1)
                value[alone] = np.minimum(carry[c[alone]], _least_up_to(prefix[:size], order[t[alone]] + 1))
                value = np.minimum(value, 253) + np.uint8(1)
                value[alone & (seen[c] == 0)] = 0
                position = first[c] + seen[c] + t - begin[c]
                fresh = is_new[t]
                new_at.append(position[fresh])
                new_from.append(k + np.searchsorted(here, order[t[fresh]]))
                new_lcp.append(value[fresh])
                fix_at.append(position[~fresh])
                fix_lcp.append(value[~fresh])
            # least common prefix since each symbol's last occurrence
            back = prefix[:size][::-1]
            ends = order[begin[present] + counts[present] - 1]
            tail = np.full(len(present), 255, np.uint8)
            inside = ends < size - 1
            if inside.any():
                tail[inside] = _least_up_to(back, size - 1 - ends[inside])
            carry = np.minimum(carry, prefix[:size].min())
            carry[present] = tail
            seen += counts
            lo, k = lo + size, k2
        at_all, from_all, lcp_all = np.concatenate(new_at), np.concatenate(new_from), np.concatenate(new_lcp)
        order = np.argsort(at_all, kind="stable")
        at_all, who_all, lcp_all = at_all[order], who[from_all[order]], lcp_all[order]
        fix_at, fix_lcp = np.concatenate(fix_at), np.concatenate(fix_lcp)
        order = np.argsort(fix_at, kind="stable")
        fix_at, fix_lcp = fix_at[order], fix_lcp[order]
        symbol = before(who_all, j)
        fresh_entries = (symbol << 8) | lcp_all
        slot = at_all - np.arange(len(at_all))  # the old entry that each goes before
        following = SequentialFile(folder)
        total = lo
        lo = a = f = done = 0
        for piece in entries.read():
            hi = lo + len(piece)
            b = len(slot) if hi == total else int(np.searchsorted(slot, hi))
            out = np.empty(len(piece) + b - a, np.uint16)
            old = np.ones(len(out), bool)
            old[at_all[a:b] - done] = False
            out[old] = piece
            out[at_all[a:b] - done] = fresh_entries[a:b]
            f2 = int(np.searchsorted(fix_at, done + len(out)))
            where = fix_at[f:f2] - done
            out[where] = (out[where] & 0xFF00) | fix_lcp[f:f2]
            following.write(out)
            done, lo, a, f = done + len(out), hi, b, f2
        entries.drop()
        entries = following
        totals = totals + np.bincount(symbol, minlength=256)
        live = symbol > 0
        who, at = who_all[live], at_all[live]
        if not len(who):
            break
    whole = np.concatenate([np.zeros(0, np.uint16), *entries.read()])
    entries.drop()
    return (whole >> 8).astype(np.uint8), (whole & 255).astype(np.uint8)


def suffix_groups(bwt: np.ndarray, lcp: np.ndarray, lengths: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For suffix lengths from `least` up: strings, their suffix's start, and the group of suffixes that share `least` symbols.

    The transform is walked from the empty suffixes back, one symbol of each string at a time.
    """
    n = len(lengths)
    order = np.argsort(bwt, kind="stable")
    starts = int(np.count_nonzero(bwt == 0))
    step = np.empty(len(bwt), np.int64)
    step[order[starts:]] = n + np.arange(len(bwt) - starts)
    group = np.cumsum(lcp < least)
    who, at = np.arange(n), np.arange(n)
    for j in range(1, int(lengths.max(initial=0)) + 1):
        live = lengths[who] >= j
        who, at = who[live], step[at[live]]
        if j >= least:
            yield who, lengths[who] - j, group[at]
