"""Quality by naive Bayes support vectors: indicators scaled by class log-count ratios, a linear hinge-loss model on top."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fit_in_task, held_out, platt, score_batches, sigmoid
from .textkit import Words, chunks, mix, prefix_hashes, seeded, text_bytes

BUCKET_BITS = 18
_LETTER = np.zeros(256, np.uint64)
_LETTER[[*range(97, 123)]] = 1
_LETTER[[*range(65, 91)]] = 2
_LETTER[[*range(48, 58)]] = 3
_LETTER[128:] = 4
_LETTER[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = np.arange(10, 42)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of each text, sorted, and offsets: words, word pairs, and runs of one to three word shapes.

    A word's shape is the class of its first and last two characters, its length up to 3 and whether it repeats the
    word before it.
    """
    w = Words(data, offsets)
    n = len(w.hashes)
    doc = w.doc
    if n:
        again = np.zeros(n, bool)
        again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (doc[1:] == doc[:-1])
        tail = np.maximum(w.ends - 2, w.starts)
        head = np.minimum(w.starts + 1, w.ends - 1)
        shape = (((_LETTER[data[w.starts]] * np.uint64(64) + _LETTER[data[head]]) * np.uint64(64) + _LETTER[data[tail]]) * np.uint64(64) + _LETTER[data[w.ends - 1]]) * np.uint64(8)
        shape = mix(shape + np.minimum(w.ends - w.starts, 3).astype(np.uint64) * np.uint64(2) + again + seeded(5))
    else:
        shape = np.zeros(0, np.uint64)
    parts, docs = [w.hashes, shape], [doc, doc]
    for base, k, salt in ((w.hashes, 2, 31), (shape, 2, 32), (shape, 3, 33)):
        if n >= k:
            at = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
            total = sum((base[i : n - k + 1 + i] * seeded(salt + 100 * i) for i in range(k)), np.zeros(n - k + 1, np.uint64))
            parts.append(mix(total[at]))
            docs.append(doc[at])
    found = (np.concatenate(parts) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    key = np.sort((np.concatenate(docs).astype(np.int64) << BUCKET_BITS) | found)
    key = key[np.flatnonzero(np.diff(key, prepend=-1))]
    return key & ((1 << BUCKET_BITS) - 1), np.searchsorted(key, np.arange(len(offsets), dtype=np.int64) << BUCKET_BITS)


@dataclass
class Model:
    ratio: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def margins(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Margin of each row of indicators, scaled to unit length (no features: 0)."""
        n = len(offsets) - 1
        out = np.zeros(n)
        live = np.flatnonzero(np.diff(offsets) > 0)
        if len(live):
            r = self.ratio[ids]
            top = np.add.reduceat(r * self.weights[ids], offsets[:-1][live])
            norm = np.sqrt(np.add.reduceat(r * r, offsets[:-1][live])) + 1e-9
            out[live] = top / norm
        return out

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.margins(*features(data, offsets)) + self.offset)


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log of the ratio of an n-gram's smoothed share of rows in class 1 to that in class 0, both shares normalised."""
    size = 1 << BUCKET_BITS
    p, q = np.full(size, smooth), np.full(size, smooth)
    for ids, t in zip(rows, y, strict=True):
        (p if t > 0 else q)[ids] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float = 4.0, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Weights of a linear model under the hinge loss, one dual variable at a time, rows scaled to unit length."""
    rng = np.random.default_rng(seed)
    signs = np.where(y > 0, 1.0, -1.0)
    values = []
    for ids in rows:
        v = scale[ids]
        norm = np.sqrt((v * v).sum())
        values.append(v / norm if norm > 0 else v)
    # the rarer class weighs more, so that both classes count alike
    limits = np.where(y > 0, c * len(y) / (2 * max(1, y.sum())), c * len(y) / (2 * max(1, (1 - y).sum())))
    alpha, w = np.zeros(len(rows)), np.zeros(1 << BUCKET_BITS)
    curvature = np.array([(v * v).sum() for v in values])
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            if curvature[i] <= 0:
                continue
            gradient = signs[i] * (w[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - gradient / curvature[i], 0.0), limits[i])
            if new != alpha[i]:
                w[rows[i]] += (new - alpha[i]) * signs[i] * values[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


def fit_model(sample: pa.Table, share: float) -> Model | None:
    """The model from labelled texts; a fifth of them turns margins into chances. Without both classes: None."""
    y = np.array(sample["y"].to_pylist(), dtype=np.float64)
    data, offsets = text_bytes(sample["text"])
    rows: list[np.ndarray] = []
    for lo, hi in chunks(offsets):
        ids, at = features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        rows += [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    check = np.arange(len(y)) % 5 == 4
    fit = np.flatnonzero(~check)
    if not (len(fit) and 0 < y[fit].sum() < len(fit)):
        return None
    ratio = log_count_ratio([rows[i] for i in fit], y[fit])
    weights = dual_coordinate_descent([rows[i] for i in fit], y[fit], ratio)
    model = Model(ratio.astype(np.float32), weights.astype(np.float32))
    kept = np.flatnonzero(check) if check.any() and 0 < y[check].sum() < check.sum() else fit
    margins = np.concatenate([model.margins(rows[i], np.array([0, len(rows[i])])) for i in kept])
    model.slope, model.offset = platt(margins, y[kept])
    balance, share = y[kept].mean(), min(max(share, 1e-4), 1 - 1e-4)
    model.offset += float(np.log(share / (1 - share)) - np.log(balance / (1 - balance)))
    return model


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = 2500, text_bytes_most: int = 100_000, class_bytes_most: int = 1 << 25, threshold: float = 0.3) -> DataFrame:
    """One row per document: id, held_out, score (chance of quality 1), predicted (score >= threshold).

    One task fits the model on at most per_class labelled rows of either class (none held out, none over
    text_bytes_most bytes, at most class_bytes_most bytes a class); a fifth of them turns margins into chances, and the
    shares of the classes in the sample are put back to those among all labelled rows. Every whole text is scored by
    nothing but its n-grams, however long it is.

    Null texts count as empty; a text without words has margin 0. Labels other than 0 and 1, null labels and labels
    without an id count for nothing; of several labels of one id the largest counts. Without labels of both classes
    every score is the share of class 1. Repeated rows get equal scores; a null id is never held out. An empty table
    gives an empty result. Other columns are ignored, whatever their names.
    """
    model, share = fit_in_task(docs, labels, label_col, id_col, text_col, per_class, text_bytes_most, class_bytes_most, fit_model)

    def score(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return model.score(data, offsets) if model else np.full(len(offsets) - 1, share)

    rows_df = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    scored = rows_df.mapInArrow(score_batches(score, 1), f"__id {rows_df.schema['__id'].dataType.simpleString()}, score double")
    return scored.select(F.col("__id").alias(id_col), held_out(F.col("__id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
