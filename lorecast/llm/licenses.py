"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship
from .textkit import Words, chunks, text_bytes
from .toxicity import PUNCTUATION

K = 5
#: Words of the shortest template: shorter ones are an error.
LEAST_WORDS = 3
BASE_BLOCK = 4
#: Chance that a window which holds a template goes unnoticed by all bands, at most.
MISS = 1e-4

#: Notices as they stand in files under these licenses.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
)
#: Notices of fewer than K words.
SHORT_TEMPLATES = (("All-Rights-Reserved", "All rights reserved."),)


def bands_for(similarity: float, miss: float = MISS) -> int:
    """Bands of one row each, so that two sets of this Jaccard similarity meet in none of them with chance `miss`.

    A band of one row meets with the similarity itself as its chance; more rows would need far more bands, as a short
    template in a window twice its size is not similar.
    """
    return max(1, math.ceil(math.log(miss) / math.log1p(-min(similarity, 0.999999))))


class Templates:
    """Distinct shingles of each template, their window class, and the minima that the bands compare."""

    def __init__(self, templates: Sequence[tuple[str, str]], containment: float, seed: int = 29):
        self.names = [n for n, _ in templates]
        self.sets, self.k = [], []
        for name, text in templates:
            raw = np.frombuffer(text.encode(), np.uint8)
            words = Words(raw, np.array([0, len(raw)]), strip=PUNCTUATION)
            if len(words.hashes) < LEAST_WORDS:
                raise ValueError(f"template {name!r} has fewer than {LEAST_WORDS} words")
            self.k.append(min(K, len(words.hashes)))  # a short template is one shingle of all its words
            self.sets.append(np.unique(words.grams(self.k[-1])[0]))
        # an occurrence spans fewer shingles than a block of its class, so two adjacent blocks hold it
        self.level = [max(0, math.ceil(math.log2(len(s) / containment / BASE_BLOCK))) for s in self.sets]
        self.bands = []
        for s, level in zip(self.sets, self.level, strict=True):
            held, window = math.ceil(containment * len(s) - 1e-9), 2 * BASE_BLOCK << level
            self.bands.append(bands_for(held / (window + len(s) - held)))
        rng = np.random.default_rng(seed)
        self.multiply = rng.integers(1, 1 << 32, max(self.bands), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.mask = rng.integers(1, 1 << 32, max(self.bands), dtype=np.uint64).astype(np.uint32)
        self.minima = np.array([[self.permute(s, j).min() for j in range(max(self.bands))] for s in self.sets], np.uint32)
        self.containment = containment
        self.indexes: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}

    def index(self, k: int, level: int, band: int) -> tuple[np.ndarray, np.ndarray]:
        """The minima of a band, sorted, of the templates of one shingle length and window class, and whose they are."""
        if (k, level, band) not in self.indexes:
            own = np.array([i for i in range(len(self.sets)) if self.k[i] == k and self.level[i] == level and band < self.bands[i]], np.int64)
            order = np.argsort(self.minima[own, band], kind="stable")
            self.indexes[k, level, band] = (self.minima[own, band][order], own[order])
        return self.indexes[k, level, band]

    def permute(self, hashes: np.ndarray, band: int) -> np.ndarray:
        h = (hashes >> np.uint64(32)).astype(np.uint32) ^ self.mask[band]
        h = h * self.multiply[band]
        return h ^ (h >> np.uint32(15))


def _pair_min(x: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Minimum of blocks 2i and 2i + 1 of each text."""
    first = np.concatenate([[0], np.cumsum(per_text)])[:-1]
    half = -(-per_text // 2)
    at = np.repeat(first, half) + 2 * (np.arange(half.sum()) - np.repeat(np.cumsum(half) - half, half))
    return np.minimum.reduceat(x, at) if len(at) else x[:0]


def scan_texts(data: np.ndarray, offsets: np.ndarray, t: Templates) -> list[tuple[int, int, float, int]]:
    """(text, template, containment, first word of the window) of every verified window."""
    words = Words(data, offsets, strip=PUNCTUATION)
    return [x for k in sorted(set(t.k)) for x in _scan_runs(words, t, k)]


def _scan_runs(words: Words, t: Templates, k: int) -> list[tuple[int, int, float, int]]:
    """The same for the templates whose shingles are runs of k words."""
    those = [i for i in range(len(t.sets)) if t.k[i] == k]
    grams, at = words.grams(k)
    if not len(grams):
        return []
    doc = words.doc[at]
    count = np.bincount(doc, minlength=len(words.offsets) - 1)
    live = np.flatnonzero(count)
    count = count[live]
    first = np.cumsum(count) - count
    blocks = -(-count // BASE_BLOCK)
    base = np.repeat(first, blocks) + BASE_BLOCK * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    top = max(t.level[i] for i in those)
    candidates: set[tuple[int, int]] = set()
    shapes = [blocks]
    for _ in range(top):
        shapes.append(-(-shapes[-1] // 2))
    edges = [np.cumsum(s) - 1 for s in shapes]
    for band in range(max(t.bands[i] for i in those)):
        x = np.minimum.reduceat(t.permute(grams, band), base)
        for level in range(top + 1):
            if level:
                x = _pair_min(x, shapes[level - 1])
            minima, which = t.index(k, level, band)
            if len(minima):
                window = x.copy()
                window[:-1] = np.minimum(x[:-1], x[1:])
                window[edges[level]] = x[edges[level]]
                lo, hi = np.searchsorted(minima, window), np.searchsorted(minima, window, "right")
                for b in np.flatnonzero(hi > lo).tolist():
                    candidates.update((int(i), b) for i in which[lo[b] : hi[b]])
    out = []
    starts = [np.cumsum(s) - s for s in shapes]
    for i, b in sorted(candidates):
        level = t.level[i]
        text = int(np.searchsorted(starts[level], b, "right")) - 1
        step = BASE_BLOCK << level
        lo = first[text] + (b - starts[level][text]) * step
        hi = min(first[text] + count[text], lo + 2 * step)
        held = len(np.intersect1d(grams[lo:hi], t.sets[i])) / len(t.sets[i])
        if held >= t.containment:
            out.append((int(live[text]), i, held, int(at[lo] - words.offsets[live[text]])))
    return out


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", containment: float = 0.8) -> DataFrame:
    """One row per document and license found: id, license, containment (best), word_start (of the first window), windows.

    Windows of two adjacent blocks of shingles overlap by half, in classes by template length, so that some window
    holds any occurrence whole. A template is retrieved where one of its bands' minima is the window's; the number of
    bands follows from the least Jaccard similarity that an occurrence can have with its window, so that the chance to
    miss it is at most MISS. A retrieved window counts if it has at least `containment` of the template's distinct
    five-word shingles (A-Z lower-cased, punctuation at the ends of words ignored). A template of three or four words has
    its whole word sequence as its one shingle, and is sought among the runs of that length.

    Null, empty and short texts have no windows. Rows with a null id can match and carry it; repeated rows give a row
    each. Templates of fewer than three words are an error. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    t = Templates(templates, containment)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            best: dict = {}
            for lo, hi in chunks(offsets):
                for doc, i, held, word in scan_texts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], t):
                    key = (lo + doc, t.names[i])
                    c, w, n = best.get(key, (0.0, word, 0))
                    best[key] = (max(c, held), min(w, word), n + 1)
            if best:
                keys, values = list(best), list(best.values())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([k[0] for k in keys], pa.int64())), pa.array([k[1] for k in keys]), pa.array([round(v[0], 6) for v in values]), pa.array([v[1] for v in values], pa.int64()), pa.array([v[2] for v in values], pa.int64())],
                    names=[id_col, "license", "containment", "word_start", "windows"],
                )

    return rows.mapInArrow(run, f"{id_col} {rows.schema['id'].dataType.simpleString()}, license string, containment double, word_start long, windows long")
