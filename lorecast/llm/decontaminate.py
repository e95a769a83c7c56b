"""Benchmark decontamination by latent semantic retrieval, then word subsequences and answers.

Documents are cut into blocks of BLOCK words; windows of two, three, five ... blocks are the passages. The terms are all
words of the benchmark: other words add nothing to a product with a benchmark passage. A randomised SVD of the TF-IDF
blocks (corpus and benchmark) gives a latent space; passages near a benchmark item in it are candidates; a candidate is
a leak if enough of the item's words stand in it in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import drop_path, new_path, ship, tidy
from .textkit import Words, chunks, text_bytes
from .toxicity import PUNCTUATION

BLOCK = 16
#: Items are searched in slices of at most so many items and terms (one item may have more), each with a latent space
#: of its own. A task holds a square table of a slice's terms.
SLICE_ITEMS, SLICE_TERMS = 224, 4096
#: How much more the items count in the decomposition than the whole corpus: their directions must not be lost.
ITEMS_WEIGHT = 10.0
TERMS_IN_BLOB = 512
#: Blocks from which a task makes a product in the decomposition, and the most such products (then of more blocks).
BLOCKS_A_TASK, PRODUCTS_MOST = 300_000, 4096
#: Blocks whose windows are compared at a time, and windows that meet the items at a time.
WINDOWS, PART = 4096, 512
#: Items of one length class whose greatest shares are bounded together.
GROUP = 4


def fold(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capitals of U+00C0 to U+00DE made small (A-Z are folded where words are hashed)."""
    high = np.zeros(len(data), bool)
    high[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    return data + high * np.uint8(0x20) if high.any() else data


class Items:
    """Some of the benchmark: per item its words' hashes and its answer's, and the vocabulary of them all."""

    def __init__(self, ids: list, texts: list):
        self.ids, self.words, self.answers = [], [], []
        for i, t in zip(ids, texts, strict=True):
            words = _hashes(t or "")
            if len(words):
                self.ids.append(i)
                self.words.append(words)
                parts = [p for p in re.split(r"(?<=[.?!])\s+", t.strip()) if p]
                answer = _hashes(parts[-1])
                self.answers.append(answer if len(answer) >= 3 else words[-5:])
        self.vocabulary = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, np.uint64)
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.vocabulary >> np.uint64(48)).astype(np.int64)] = True
        self.scale = np.array([max(0, int(np.ceil(np.log2(max(1, len(w)) / BLOCK)))) for w in self.words], np.int64)
        self.terms = [np.searchsorted(self.vocabulary, w) for w in self.words]

    def project(self, weighted: np.ndarray) -> np.ndarray:
        """The sum of each item's rows of a table of terms."""
        return np.stack([weighted[t].sum(axis=0) for t in self.terms]) if self.terms else np.zeros((0, weighted.shape[1]))


def slices(benchmark: DataFrame) -> Iterator[Items]:
    """The items in order, as many together as SLICE_ITEMS and SLICE_TERMS allow."""
    ids, texts, terms = [], [], set()
    for i, t in benchmark.orderBy(*benchmark.columns).toLocalIterator():
        own = set(_hashes(t or "").tolist())
        if ids and (len(ids) >= SLICE_ITEMS or len(terms | own) > SLICE_TERMS):
            yield Items(ids, texts)
            ids, texts, terms = [], [], set()
        ids.append(i)
        texts.append(t)
        terms |= own
    if ids:
        yield Items(ids, texts)


def _hashes(text: str) -> np.ndarray:
    raw = text.encode()
    return Words(fold(np.frombuffer(raw, np.uint8)), np.array([0, len(raw)]), strip=PUNCTUATION).hashes


class Blocks:
    """The vocabulary terms of a few texts, by block. Block numbers run through; a text has at least one block."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray, sieve: np.ndarray):
        self.words = Words(fold(data), offsets, strip=PUNCTUATION)
        count = np.diff(self.words.offsets)
        self.per_text = np.maximum(1, -(-count // BLOCK))
        self.first = np.concatenate([[0], np.cumsum(self.per_text)])
        h = self.words.hashes
        hit = np.flatnonzero(sieve[(h >> np.uint64(48)).astype(np.int64)])
        at = np.searchsorted(vocabulary, h[hit])
        ok = vocabulary[np.minimum(at, len(vocabulary) - 1)] == h[hit] if len(vocabulary) else np.zeros(0, bool)
        hit, self.term = hit[ok], at[ok]
        doc = self.words.doc[hit]
        self.block = self.first[doc] + (hit - self.words.offsets[doc]) // BLOCK
        self.n = int(self.first[-1])


def _over_blocks(items: Items, handle):
    """Run handle(blocks, index of the first text) over all chunks of a text column."""

    def run(column: pa.Array) -> Iterator:
        data, offsets = text_bytes(column)
        for lo, hi in chunks(offsets):
            yield handle(Blocks(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], items.vocabulary, items.sieve), lo)

    return run


def _block_terms(items: Items):
    """The rows of the TF-IDF matrix, many to a table row: number of blocks, terms in each block that has any, the terms."""

    def handle(blocks: Blocks, _: int) -> tuple[int, bytes, bytes]:
        counts = np.bincount(blocks.block, minlength=blocks.n) if len(blocks.block) else np.zeros(0, np.int64)
        return blocks.n, counts[counts > 0].astype(np.uint8).tobytes(), blocks.term.astype(np.uint32).tobytes()

    walk = _over_blocks(items, handle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(walk(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in ((0, pa.int64()), (1, pa.binary()), (2, pa.binary()))], names=["n", "counts", "terms"])

    return run


def _rows_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of blocks, the start of each block's terms, the terms."""
    for n, counts, terms in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        ends = np.cumsum(np.frombuffer(counts, np.uint8), dtype=np.int64)
        yield n, np.concatenate([[0], ends])[:-1] if len(ends) else ends, np.frombuffer(terms, np.uint32).astype(np.int64)


def _in_parts(total: np.ndarray) -> pa.RecordBatch:
    """An array over all terms, in rows of TERMS_IN_BLOB terms, to be summed by part."""
    parts = range(0, len(total), TERMS_IN_BLOB)
    return pa.RecordBatch.from_arrays([pa.array(list(range(len(parts))), pa.int64()), pa.array([total[i : i + TERMS_IN_BLOB].astype(np.float32).tobytes() for i in parts], pa.binary())], names=["part", "sums"])


def _sum_parts(df: DataFrame, shape: tuple) -> np.ndarray:
    """Sum over tasks of arrays in parts, added up by part on the executors; the sum itself is as large as a slice's vocabulary."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(x, np.float32).astype(np.float64)
                held[k] = held[k] + x if k in held else x
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.astype(np.float32).tobytes() for x in held.values()], pa.binary())], names=["part", "sums"])

    n = max(1, -(-shape[0] // TERMS_IN_BLOB))
    out = np.zeros(shape, np.float32)
    for r in df.repartition(n, "part").mapInArrow(add, "part long, sums binary").toLocalIterator():
        piece = np.frombuffer(r["sums"], np.float32).reshape(-1, *shape[1:])
        out[r["part"] * TERMS_IN_BLOB : r["part"] * TERMS_IN_BLOB + len(piece)] = piece
    return out


def _document_frequencies(matrix: DataFrame, v: int) -> np.ndarray:
    """In how many blocks each term is, and at the end the number of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(v + 1)
        for batch in batches:
            for n, starts, terms in _rows_of(batch):
                block = np.searchsorted(starts, np.arange(len(terms)), "right")
                total[:v] += np.bincount(np.unique(block * v + terms) % v, minlength=v)
                total[v] += n
        yield _in_parts(total)

    return _sum_parts(matrix.mapInArrow(run, "part long, sums binary"), (v + 1,)).astype(np.float64)


def _gram_times(matrix: DataFrame, idf: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A' (A R) for the corpus part A of the TF-IDF matrix.

    Each task counts how often two terms share a block, which is its part of A'A but for the weights, and multiplies
    that table by R once; only the product, terms by rank, leaves the task.
    """
    v, weighted = len(idf), (right * idf[:, None]).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size = np.zeros(v * v, np.float32), [], 0
        edges = np.linspace(0, v * v, 9).astype(np.int64)

        def count() -> None:
            nonlocal held, size
            codes, held, size = np.concatenate(held) if held else np.zeros(0, np.int64), [], 0
            for lo, hi in zip(edges[:-1], edges[1:], strict=True) if len(codes) else ():  # the counts of an eighth of the table at a time
                table[lo:hi] += np.bincount(codes[(codes >= lo) & (codes < hi)] - lo, minlength=hi - lo)

        for batch in batches:
            for _, starts, terms in _rows_of(batch):
                block = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(terms))))
                held.append(terms * (v + 1))
                for k in range(1, BLOCK):
                    near = block[k:] == block[:-k]
                    if not near.any():
                        break
                    x, y = terms[k:][near], terms[:-k][near]
                    held += [x * v + y, y * v + x]
                size += len(terms) * BLOCK
                if size > 2_000_000:
                    count()
        count()
        yield _in_parts((table.reshape(v, v) @ weighted) * idf[:, None])

    return _sum_parts(matrix.mapInArrow(run, "part long, sums binary"), right.shape)


def latent_space(texts: DataFrame, items: Items, rank: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Inverse document frequencies of the terms, right singular vectors (terms by rank) and singular values.

    A randomised SVD: with A the TF-IDF rows of all corpus blocks and items (the two parts scaled to equal mass, then
    the items by ITEMS_WEIGHT), a range finder Q = qr(A'A G) for a seeded Gaussian G; a power step Z = A'A Q; and from
    both the rank-r decomposition Z (Q'Z)^-1 Z' of A'A by a Cholesky factor and a small SVD. The two passes over the
    corpus read its blocks' term numbers, which are written once.
    """
    v, spark = len(items.vocabulary), texts.sparkSession
    rank = min(rank, v)
    path = new_path(spark, "benchmark-terms")
    schema = "n long, counts binary, terms binary"
    texts.mapInArrow(_block_terms(items), schema).write.parquet(path)
    matrix = spark.read.schema(schema).parquet(path)
    found = _document_frequencies(matrix, v)
    # a task's product has the same size however few blocks it has: some hundred thousand blocks each, a few thousand tasks
    matrix = matrix.coalesce(int(min(PRODUCTS_MOST, found[v] // BLOCKS_A_TASK + 1)))
    idf = np.log((found[v] + 1) / (found[:v] + 1)) + 0.1
    scales: list[float] = []

    def times(right: np.ndarray) -> np.ndarray:
        rows, own = items.project(right * idf[:, None]), np.zeros(right.shape)
        np.add.at(own, np.concatenate(items.terms), np.repeat(rows, [len(t) for t in items.terms], axis=0))
        parts = [_gram_times(matrix, idf, right).astype(np.float64), own * idf[:, None]]
        if not scales:
            scales.extend(weight / norm if (norm := np.linalg.norm(p)) > 0 else 0.0 for p, weight in zip(parts, (1.0, ITEMS_WEIGHT), strict=True))
        return parts[0] * scales[0] + parts[1] * scales[1]

    q, _ = np.linalg.qr(times(np.random.default_rng(seed).normal(size=(v, rank))))
    z = times(q)
    drop_path(spark, path)
    tidy(spark)
    shift = 1e-7 * np.linalg.norm(z)
    z += shift * q
    core = q.T @ z
    core = (core + core.T) / 2
    core += np.eye(rank) * max(0.0, 1e-9 * np.trace(core) - np.linalg.eigvalsh(core)[0])
    vectors, values, _ = np.linalg.svd(np.linalg.solve(np.linalg.cholesky(core), z.T).T, full_matrices=False)
    return idf, vectors.astype(np.float32), np.sqrt(np.maximum(values**2 - shift, 0))


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by one row of bits."""
    masks: dict = {}
    for i, x in enumerate(a.tolist()):
        masks[x] = masks.get(x, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b.tolist():
        m = masks.get(x, 0)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", rank: int = 256, cosine: float = 0.35, share: float = 0.3, subsequence: float = 0.8, with_answer: float = 0.6, seed: int = 3) -> DataFrame:
    """One row per document and benchmark item that it leaks: id, item_id, cosine, lcs_ratio, answer_found, word_start.

    A window that is long enough to hold an item wherever it begins is a candidate if its cosine with the item in the
    latent space reaches `cosine` and it holds at least `share` of the item's weight there. It is a leak if the longest common subsequence
    of words covers `subsequence` of the item, or `with_answer` of it and its answer is found: the item's last sentence
    (its last five words, where that is shorter than three), four fifths of whose words must follow each other
    in the window. word_start is the first word of the best window. Every window of every text, however long, is
    compared with every item; items are a stated query set, searched in slices.

    Null and empty texts and items match nothing; rows and items with a null id can match and carry it. Repeated rows
    give a row each, and so do repeated items. Without benchmark items, or documents, the result is empty. Other
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    chosen = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    kind, item_kind = (x.dataType.simpleString() for x in (rows.schema["id"], chosen.schema["item"]))
    shape = f"{id_col} {kind}, {item_col} {item_kind}, cosine double, lcs_ratio double, answer_found boolean, word_start long"
    out = spark.createDataFrame([], shape)
    for items in slices(chosen):
        if items.ids:
            idf, basis, _ = latent_space(rows.select("text"), items, rank, seed)
            search = searcher(items, basis * idf.astype(np.float32)[:, None], cosine, share, subsequence, with_answer, to_arrow_type(chosen.schema["item"].dataType))
            out = out.unionByName(rows.mapInArrow(search, shape.replace(f"{id_col} ", "doc ", 1).replace(f", {item_col} ", ", item ", 1)).toDF(*out.columns))
    return out


def _sum_by_block(rows: np.ndarray, term: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
    """The sum of the rows of each block's terms, after a row of zeros. Blocks are sorted; their first terms are added, then the second ones, and so on."""
    out = np.zeros((n + 1, rows.shape[1]), rows.dtype)
    first = np.flatnonzero(np.diff(block, prepend=-1))
    place = np.arange(len(block)) - np.repeat(first, np.diff(np.append(first, len(block))))
    order = np.argsort(place.astype(np.uint8), kind="stable")
    for some in np.split(order, np.cumsum(np.bincount(place))[:-1]):
        out[block[some] + 1] += rows[term[some]]
    return out


def searcher(items: Items, weighted: np.ndarray, cosine: float, share: float, subsequence: float, with_answer: float, item_type: pa.DataType):
    """A mapInArrow function from (id, text) to the leaks of some items."""
    queries = items.project(weighted).astype(np.float32)
    norms = np.linalg.norm(queries, axis=1)
    scales = [(s, which) for s in np.unique(items.scale).tolist() if len(which := np.flatnonzero((items.scale == s) & (norms > 0)))]
    # what a term can add, at most, to the share that a window holds of any item of a group
    groups = [[which[i : i + GROUP] for i in range(0, len(which), GROUP)] for _, which in scales]
    most = np.zeros((len(weighted), sum(map(len, groups))), np.float32)
    for i, g in enumerate(g for own in groups for g in own):
        most[:, i] = (weighted @ (queries[g] / norms[g][:, None] ** 2).T).max(axis=1)
    columns = np.cumsum([0, *map(len, groups)])
    longest = max(((1 << s) + 1 for s, _ in scales), default=0)

    def handle(blocks: Blocks, lo: int) -> list[tuple]:
        last = np.repeat(blocks.first[1:], blocks.per_text)
        best: dict = {}
        for a in range(0, blocks.n, WINDOWS):
            b, c = min(blocks.n, a + WINDOWS), min(blocks.n, a + WINDOWS + longest)
            terms = slice(*np.searchsorted(blocks.block, (a, c)))
            compare(blocks, a, b, c, blocks.term[terms], blocks.block[terms] - a, np.minimum(last[a:b], c) - a, best)
        return [(lo + doc, items.ids[i], *v) for (doc, i), v in best.items()]

    def compare(blocks: Blocks, a: int, b: int, c: int, term: np.ndarray, block: np.ndarray, last: np.ndarray, best: dict) -> None:
        """The windows that begin in blocks a to b: first by what their terms can add to a group's share, then in the latent space.

        Sums over windows are differences of running sums up to block c.
        """
        if not len(term):
            return
        held = np.cumsum(_sum_by_block(most, term, block, c - a), axis=0)
        begins = np.searchsorted(block, np.arange(c - a + 1))
        for k, (s, which) in enumerate(scales):
            n, own = (1 << s) + 1, slice(columns[k], columns[k + 1])
            stop = np.minimum(np.arange(b - a) + n, last)
            # the running sums are rounded: a little below the share still counts
            live = np.flatnonzero((held[stop, own] - held[: b - a, own]).max(axis=1) >= share - 1e-3)
            live = live[begins[stop[live]] > begins[live]]
            for some in np.split(live, range(PART, len(live), PART)):
                if not len(some):
                    continue
                first, length = begins[some], begins[stop[some]] - begins[some]
                at = np.cumsum(length) - length
                sums = np.add.reduceat(weighted[term[np.repeat(first - at, length) + np.arange(length.sum())]], at, axis=0)
                long_ = np.linalg.norm(sums, axis=1)
                dots = sums @ queries[which].T
                near = (dots >= cosine * long_[:, None] * norms[which][None, :]) & (dots >= share * norms[which][None, :] ** 2)
                for r, i in zip(*np.nonzero(near), strict=True):
                    verify(blocks, a + int(some[r]), n, int(which[i]), float(dots[r, i] / (long_[r] * norms[which[i]])), best)

    def verify(blocks: Blocks, block: int, n: int, item: int, cos: float, best: dict) -> None:
        doc = int(np.searchsorted(blocks.first, block, "right")) - 1
        w0, w1 = blocks.words.offsets[doc], blocks.words.offsets[doc + 1]
        start = max(w0, w0 + (block - blocks.first[doc] - 1) * BLOCK)
        passage = blocks.words.hashes[start : min(w1, w0 + (block - blocks.first[doc] + n + 1) * BLOCK)]
        want = items.words[item]
        if np.count_nonzero(np.isin(want, passage)) < with_answer * len(want):
            return  # a subsequence has no more words than both share
        ratio = common_subsequence(want, passage) / len(want)
        if ratio < with_answer:
            return
        answer = items.answers[item]
        answered = common_subsequence(answer, passage) >= 0.8 * len(answer)
        if ratio < subsequence and not answered:
            return
        new = (round(cos, 6), round(ratio, 6), bool(answered), int(start - w0))
        if (doc, item) not in best or new[1] > best[doc, item][1]:
            best[doc, item] = new

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = _over_blocks(items, handle)
        for batch in batches:
            hits = [h for part in walk(batch.column(1)) for h in part]
            if hits:
                ids = batch.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
                kinds = ((1, item_type), (2, pa.float64()), (3, pa.float64()), (4, pa.bool_()), (5, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([h[i] for h in hits], t) for i, t in kinds)], names=["doc", "item", "cosine", "lcs_ratio", "answer_found", "word_start"])

    return search
