"""Toxicity by a convolutional text classifier: hashed word embeddings, several filter widths, max pooling."""

from __future__ import annotations

import copy
import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, labelled_texts, score_batches, sigmoid
from .shared import materialize, ship, tidy
from .textkit import Words, chunks, prefix_hashes, text_bytes

BUCKET_BITS, DIM, WIDTHS, FILTERS, PREFIXES = 18, 8, (1, 2, 3), 8, (4, 6)
#: Bytes of labelled text that one part of the training holds, rounds after which the parts' networks are averaged, and
#: embeddings averaged at a time.
PART_BYTES, ROUNDS, SLICE = 8 << 20, 3, 1 << 14
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of each word (of the word, and of its first four and six bytes) and word offsets per text."""
    w = Words(data, offsets, strip=PUNCTUATION)
    shift = np.uint64(64 - BUCKET_BITS)
    return np.stack([w.hashes >> shift, *(prefix_hashes(data, w.starts, w.ends, k) >> shift for k in PREFIXES)]).astype(np.int64), w.offsets


@dataclass
class Network:
    """Embeddings, one filter bank per width, filter offsets, and the output layer."""

    embed: np.ndarray
    banks: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    base: float = 0.0

    def words(self, ids: np.ndarray) -> np.ndarray:
        out = self.embed[ids[0]]
        for more in ids[1:]:
            out += self.embed[more]
        return out

    def maps(self, x: np.ndarray) -> list[np.ndarray]:
        """Filter responses at every word; a window that runs over the end sees zeros there."""
        found = []
        for w, bank in zip(WIDTHS, self.banks, strict=True):
            r = x @ bank[0]
            for k in range(1, w):
                r[:-k] += x[k:] @ bank[k]
            found.append(r)
        return found

    def pooled(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Largest response of each filter in each text, never below 0 (texts without words: 0)."""
        n = len(offsets) - 1
        out = np.zeros((n, len(self.bias)), np.float32)
        live = np.flatnonzero(np.diff(offsets) > 0)
        if len(live):
            # zero rows after each text keep windows from reaching into the next one
            rows = max(WIDTHS) - 1
            gap = rows * np.repeat(np.arange(n), np.diff(offsets))
            x = np.zeros((ids.shape[1] + rows * n, DIM), np.float32)
            x[np.arange(ids.shape[1]) + gap] = self.words(ids)
            starts = (offsets[:-1] + rows * np.arange(n))[live]
            found = np.concatenate(self.maps(x), axis=1)
            # windows that begin on such a row count for the text before it: mask them
            for k in range(rows):
                found[offsets[1:] + rows * np.arange(n) + k] = -np.inf
            out[live] = np.maximum.reduceat(found, starts, axis=0)[: len(live)]
        return np.maximum(out + self.bias, 0)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        ids, at = tokens(data, offsets)
        return sigmoid(self.pooled(ids, at) @ self.out + self.base)


class State:
    """A network in training: its parameters, and of each the sum of squared gradients so far."""

    def __init__(self, rng: np.random.Generator):
        size = len(WIDTHS) * FILTERS
        self.net = Network(rng.normal(0, 0.05, (1 << BUCKET_BITS, DIM)).astype(np.float32), [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(size, np.float32), rng.normal(0, 0.3, size).astype(np.float32))
        self.seen = [np.full_like(a, 1e-4) for a in (self.net.embed, *self.dense)]
        self.seen_base = 1e-4

    @property
    def dense(self) -> list[np.ndarray]:
        return [*self.net.banks, self.net.bias, self.net.out]

    def flat(self) -> np.ndarray:
        """All numbers but the embeddings and theirs."""
        return np.concatenate([*(a.ravel() for a in (*self.dense, *self.seen[1:])), [self.net.base, self.seen_base]]).astype(np.float64)

    def set_flat(self, flat: np.ndarray) -> None:
        at = 0
        for a in (*self.dense, *self.seen[1:]):
            a[...] = flat[at : at + a.size].reshape(a.shape)
            at += a.size
        self.net.base, self.seen_base = float(flat[-2]), float(flat[-1])


def train_network(ids: list[np.ndarray], y: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.02, seed: int | tuple[int, ...] = 11, weights: np.ndarray | None = None, state: State | None = None) -> Network:
    """Back-propagation in numpy with Adagrad; only the windows that won the pooling carry gradients. A state is trained on in place."""
    rng = np.random.default_rng(seed)
    state = state or State(rng)
    net, seen, seen_base = state.net, state.seen, state.seen_base
    weights = np.ones(len(y)) if weights is None else weights

    def step(param: np.ndarray, acc: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        if rows is None:
            acc += grad * grad
            param -= rate * grad / np.sqrt(acc)
        else:
            acc[rows] += grad * grad
            param[rows] -= rate * grad / np.sqrt(acc[rows])

    for _ in range(epochs):
        order = rng.permutation(len(ids))
        for lo in range(0, len(order), batch):
            chosen = [i for i in order[lo : lo + batch] if ids[i].shape[1]]
            if not chosen:
                continue
            grads = [np.zeros_like(a) for a in (*net.banks, net.bias, net.out)]
            rows, pulls, base = [], [], 0.0
            for i in chosen:
                x = net.words(ids[i])
                responses = net.maps(x)
                peaks = [r.argmax(axis=0) for r in responses]
                z = np.concatenate([r[p, np.arange(FILTERS)] for r, p in zip(responses, peaks, strict=True)]) + net.bias
                a = np.maximum(z, 0)
                d = float(sigmoid(a @ net.out + net.base) - y[i]) * float(weights[i]) / len(chosen)
                base += d
                grads[-1] += d * a
                dz = d * net.out * (z > 0)
                grads[-2] += dz
                for b, (w, bank, peak) in enumerate(zip(WIDTHS, net.banks, peaks, strict=True)):
                    g = dz[b * FILTERS : (b + 1) * FILTERS]
                    for k in range(w):
                        at = peak + k
                        ok = at < x.shape[0]
                        grads[b][k][:, ok] += x[at[ok]].T * g[ok]
                        pull = bank[k][:, ok].T * g[ok, None]
                        for row in ids[i]:
                            rows.append(row[at[ok]])
                            pulls.append(pull)
            hit, back = np.unique(np.concatenate(rows), return_inverse=True)
            total = np.zeros((len(hit), DIM), np.float32)
            np.add.at(total, back, np.concatenate(pulls))
            step(net.embed, seen[0], total, hit)
            for p, acc, g in zip((*net.banks, net.bias, net.out), seen[1:], grads, strict=True):
                step(p, acc, g)
            seen_base += base * base
            net.base -= rate * base / seen_base**0.5
    state.seen_base = seen_base
    return net


def language_thresholds(scores: np.ndarray, y: np.ndarray, langs: list, weights: np.ndarray | None = None, least: int = 20, within: tuple[float, float] = (0.2, 0.8), counts: np.ndarray | None = None) -> dict:
    """The score from which a language's rows are rejected: that of the best F1, or 0.5 where there is too little to tell.

    Weights put the classes' shares right where rows were drawn by class; counts say for how many rows an entry stands,
    and rows with one score are on one side of a cut. Between the best cut's neighbours the middle
    is taken, and it stays within bounds.
    """
    found = {}
    langs = np.array([x if x is not None else "" for x in langs], dtype=object)
    counts = np.ones(len(y)) if counts is None else counts
    weights = counts if weights is None else weights * counts
    for lang in sorted(set(langs)):
        own = langs == lang
        s, t, w = scores[own], y[own], weights[own]
        if (t * counts[own]).sum() < least or ((1 - t) * counts[own]).sum() < least:
            continue
        order = np.argsort(-s, kind="stable")
        s, t, w = s[order], t[order], w[order]
        f1 = 2 * np.cumsum(t * w) / (np.cumsum(w) + (t * w).sum())
        f1[:-1][s[:-1] == s[1:]] = -1
        k = int(f1.argmax())
        found[lang] = float(np.clip((s[k] + (s[k + 1] if k + 1 < len(s) else 0.0)) / 2, *within))
    return found


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (y, text) as parts of about PART_BYTES, one row each: part, y, lengths, text."""
    task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

    def flush() -> pa.RecordBatch:
        y, lengths, text = (np.concatenate([h[i] for h in held]) for i in range(3))
        return pa.RecordBatch.from_arrays([pa.array([task << 32 | number], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (y, lengths, text))], names=["part", "y", "lengths", "text"])

    for batch in batches:
        y = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint8)
        data, offsets = text_bytes(batch.column(1))
        for lo, hi in chunks(offsets):
            held.append((y[lo:hi], np.diff(offsets[lo : hi + 1]), data[offsets[lo] : offsets[hi]].copy()))
            size += int(offsets[hi] - offsets[lo])
            if size >= PART_BYTES:
                yield flush()
                number, held, size = number + 1, [], 0
    if held:
        yield flush()


def give_back() -> None:
    """Hand freed memory back to the system: a worker lives on into later stages, and many small arrays leave its heap full of holes."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def _learn(sent, epochs: int, turn: int, class_weights: tuple[float, float]):
    """Train on each part from the same network: changed embeddings by slices, and all other numbers as slice -1.

    Batches are smaller in a part of few (long) rows, so that it takes 32 steps an epoch too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, y, lengths, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                y, data = np.frombuffer(y, np.uint8).astype(np.float64), np.frombuffer(text, np.uint8)
                offsets = np.concatenate([[0], np.cumsum(np.frombuffer(lengths, np.int64))])
                ids: list[np.ndarray] = []
                for lo, hi in chunks(offsets):
                    found, at = tokens(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    ids += [found[:, a:b].astype(np.int32) for a, b in zip(at[:-1], at[1:], strict=True)]
                state = copy.deepcopy(sent.value)
                train_network(ids, y, epochs, min(32, max(1, len(y) // 32)), seed=(11, turn, part), weights=np.where(y > 0, class_weights[1], class_weights[0]), state=state)
                hit = np.flatnonzero((state.seen[0] != sent.value.seen[0]).any(axis=1))
                cut = np.searchsorted(hit, np.arange(0, (1 << BUCKET_BITS) + SLICE, SLICE))
                rows = [(-1, b"", state.flat().tobytes())]
                for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    if b > a:
                        own = hit[a:b]
                        rows.append((k, (own - k * SLICE).astype(np.int32).tobytes(), np.concatenate([state.net.embed[own], state.seen[0][own]], axis=1).tobytes()))
                slices, where, values = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array([part] * len(rows), pa.int64()), pa.array([len(y)] * len(rows), pa.int64()), pa.array(where, pa.binary()), pa.array(values, pa.binary())], names=["slice", "part", "n", "where", "values"])
                del ids, state, found, rows, values, y, data
                give_back()

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each slice the mean over the parts that changed an embedding, weighed by their rows."""
    held: dict[int, list] = {}
    for batch in batches:
        for k, _, n, where, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k < 0:
                total = held.setdefault(k, [0.0, 0.0])
                total[0], total[1] = total[0] + n, total[1] + n * np.frombuffer(values, np.float64)
            else:
                total = held.setdefault(k, [np.zeros((SLICE, 1)), np.zeros((SLICE, 2 * DIM))])
                at = np.frombuffer(where, np.int32)
                total[0][at] += n
                total[1][at] += n * np.frombuffer(values, np.float32).reshape(-1, 2 * DIM).astype(np.float64)
    for k, (n, total) in held.items():
        at = np.flatnonzero(n) if k >= 0 else np.zeros(0, np.int64)
        values = (total[at] / n[at]).astype(np.float32) if k >= 0 else total / n
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], names=["slice", "where", "values"])


def _score_counts(sent):
    """Per batch: language, log-odds of the score in hundredths, label, number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            score = np.concatenate([np.zeros(0), *(sent.value.score(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in chunks(offsets))])
            odds = np.round(100 * np.log(np.maximum(score, 1e-12) / np.maximum(1 - score, 1e-12))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(odds)], names=["y", "lang", "odds"])

    return run


def fit_network(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, epochs: int) -> tuple[Network | None, dict, float]:
    """Network, thresholds and the share of class 1 from all labelled texts; no network without both classes.

    A fixed fifth of the labelled rows, by a hash of the id, sets offset and thresholds; the network learns from all
    others, in parts that train side by side from one network and are averaged after each round. Both classes weigh
    alike in training, and the offset puts their shares back.
    """
    spark = docs.sparkSession
    ship(spark)
    rows, share = labelled_texts(docs, labels, label_col, id_col, text_col)
    kept = F.pmod(F.xxhash64("id", F.lit(4)), F.lit(5)) == 4
    learn = rows.where(~kept)
    sizes = learn.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).collect()
    n = {r["y"]: r["n"] for r in sizes}
    if len(n) < 2:
        return None, {}, share
    tasks = max(1, round(sum(r["bytes"] for r in sizes) / PART_BYTES))
    dealt = learn.repartition(tasks, "id").sortWithinPartitions("id", "text").select("y", "text")
    parts = materialize(dealt.mapInArrow(_parts, "part long, y binary, lengths binary, text binary"), "toxicity-parts")
    balance = tuple(sum(n.values()) / (2 * n[y]) for y in (0, 1))
    state = State(np.random.default_rng(11))
    rounds = min(ROUNDS, epochs)
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(state)
        own = epochs // rounds + (turn < epochs % rounds)
        moved = parts.mapInArrow(_learn(sent, own, turn, balance), "slice int, part long, n long, where binary, values binary")
        met = moved.repartition((1 << BUCKET_BITS) // SLICE + 1, "slice").sortWithinPartitions("slice", "part")
        state = copy.deepcopy(state)
        for r in met.mapInArrow(_average, "slice int, where binary, values binary").toLocalIterator():
            if r["slice"] < 0:
                state.set_flat(np.frombuffer(r["values"], np.float64))
            else:
                at = r["slice"] * SLICE + np.frombuffer(r["where"], np.int32)
                values = np.frombuffer(r["values"], np.float32).reshape(-1, 2 * DIM)
                state.net.embed[at], state.seen[0][at] = values[:, :DIM], values[:, DIM:]
        sent.destroy()
        tidy(spark)
    net, share_in = state.net, min(max(share, 1e-4), 1 - 1e-4)
    net.base += float(np.log(share_in / (1 - share_in)))
    sent = spark.sparkContext.broadcast(net)
    scored = rows.where(kept).select("y", "lang", "text").mapInArrow(_score_counts(sent), "y int, lang string, odds int")
    found = scored.groupBy("y", "lang", "odds").agg(F.count(F.lit(1)).alias("n")).orderBy("lang", "odds", "y").collect()
    sent.destroy()
    if not found:
        return net, {}, share
    y, langs, counts = np.array([r["y"] for r in found], float), [r["lang"] for r in found], np.array([r["n"] for r in found], float)
    odds = np.array([r["odds"] for r in found]) / 100
    # the offset moves so that the best cut over all languages scores one half
    cut = language_thresholds(sigmoid(odds), y, [""] * len(y), None, 1, (0.02, 0.98), counts).get("", 0.5)
    shift = float(np.log(cut / (1 - cut)))
    net.base -= shift
    thresholds = language_thresholds(sigmoid(odds - shift), y, langs, counts=counts)
    tidy(spark)
    return net, thresholds, share


def classify_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", epochs: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, held_out, score, predicted (score >= 0.5), threshold and rejected (by language).

    The network is trained on every labelled row that is not held out, whatever its length, but for a fifth (by a hash
    of the id) that sets the offset, by which the best cut scores one half, and the threshold of each language, from
    counts of scores (log-odds to two digits). The network reads nothing but the text. Every whole text is scored.

    Null texts count as empty; a text without words gets the score of an empty one. Labels other than 0 and 1, null
    labels and labels without an id count for nothing; of several labels of one id the largest counts. Without labels
    of both classes every score is the share of class 1. Repeated rows get equal scores; a null id is never held out.
    A null language has the threshold 0.5 or its own, as any. An empty table gives an empty result. Columns named in
    `keep` are carried along (unless named like a column of the result); others are ignored, whatever their names.
    """
    net, thresholds, share = fit_network(docs, labels, label_col, id_col, text_col, epochs)

    def score(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return net.score(data, offsets) if net else np.full(len(offsets) - 1, share)

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("__id"), lang.alias("__lang"), F.col(text_col).alias("__text"), *(F.col(c).alias(f"__keep_{i}") for i, c in enumerate(keep)))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    shape = ", ".join(f"{c} {kinds[c]}" for c in rows.columns if c != "__text") + ", score double"
    scored = rows.mapInArrow(score_batches(score, 2), shape)
    limit = F.lit(0.5)
    for k, v in thresholds.items():
        limit = F.when(F.coalesce("__lang", F.lit("")) == k, F.lit(round(v, 6))).otherwise(limit)
    return scored.select(
        F.col("__id").alias(id_col),
        held_out(F.col("__id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        limit.alias("threshold"),
        (F.col("score") >= limit).alias("rejected"),
        *(F.col(f"__keep_{i}").alias(c) for i, c in enumerate(keep)),
    )
