"""Removal of repeated byte strings across documents, by a collection's suffixes in sorted order.

Every window of `span` bytes has an anchor: the least hash among its substrings of ANCHOR bytes. Equal windows have
equal anchors, so windows are dealt by anchor and no window is compared outside its bucket. Windows whose anchor is in
one document only cannot repeat and are left at home. The others travel as segments (runs of windows with one
anchor). A bucket's distinct segments, in which a name of a few symbols stands for the anchor, are one collection,
whose transform and common prefixes are built column by column, and suffixes that share a window's symbols are equal
windows. The least document of each then decides. A task handles one bucket after the other, and there are as many
buckets as the bytes ask for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .collection_bwt import build, suffix_groups
from .shared import materialize, new_path, ship
from .textkit import _VALUES, _power_tables, chunks, mix, seeded, text_bytes

_U = np.uint64
ANCHOR = 24
#: The map of shared anchors has at most 2 ^ MAP_BITS bits (128 MB), PLACES of them for an anchor; a fuller map lets more
#: windows travel, never fewer.
MAP_BITS = 30
PLACES = (1, 0x9E3779B1)
#: Bytes of all texts for each bucket, and the most buckets (a power of two).
BUCKET_BYTES, BUCKET_BITS_MOST = 4 << 20, 20
#: Bytes of text whose anchors are found at a time: its arrays of eight bytes a byte stay in a core's cache.
CACHED_BYTES = 1 << 16
NOBODY = np.iinfo(np.int64).max


def anchors(data: np.ndarray, offsets: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Start of each window of span bytes that lies in one text, and the hash of its anchor, the least."""
    size, k = len(data), min(ANCHOR, span)
    if size < span:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    power, inverse = _power_tables(size + 1)
    sums = np.zeros(size + 1, _U)
    np.cumsum(_VALUES[data] * power[:size], out=sums[1:])
    h = mix((sums[k:] - sums[:-k]) * inverse[: size - k + 1])
    width, have = span - k + 1, 1
    while have < width:  # minimum over the next `width` positions, by doubling
        more = min(have, width - have)
        h = np.minimum(h[: len(h) - more], h[more:])
        have += more
    ends = np.repeat(offsets[1:], np.diff(offsets))
    at = np.flatnonzero(np.arange(len(h)) + span <= ends[: len(h)])
    return at, h[at]


def dealt(least: np.ndarray) -> np.ndarray:
    """Least hashes crowd at the low end: the anchors' names, one to one, are spread evenly."""
    return mix(least ^ seeded(321))


def segments(at: np.ndarray, anchor: np.ndarray, doc: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run with one anchor in one text, no longer than a window has anchors."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.ones(len(at), bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (np.diff(at) != 1)
    begin = np.flatnonzero(cut)
    index = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    cut |= index % (span - min(ANCHOR, span) + 1) == 0
    begin = np.flatnonzero(cut)
    return begin, np.diff(np.append(begin, len(at)))


def cut_out(data: np.ndarray, start: np.ndarray, length: np.ndarray, most: int = 2048) -> np.ndarray:
    """The strings data[start:start + length] one after the other."""
    out = [np.zeros(0, np.uint8)]
    for lo in range(0, len(start), most):
        size = length[lo : lo + most]
        ends = np.cumsum(size)
        out.append(data[np.repeat(start[lo : lo + most] - ends + size, size) + np.arange(ends[-1])])
    return np.concatenate(out)


def _groups(sorted_keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cut = np.flatnonzero(np.diff(sorted_keys, prepend=-1))
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(sorted_keys)], strict=True) if len(cut) else ():
        yield int(sorted_keys[a]), a, b


def _binary(rows: list[tuple], names: list[str], first: int = 1) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i < first else pa.binary()) for i in range(len(names))], names=names)


def places(rest: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The bits that stand for an anchor in its bucket's part, of 2 ^ bits, of the map."""
    for factor in PLACES:
        yield (rest * np.uint32(factor)) >> np.uint32(32 - bits)


def _own_anchors(span: int, bits: int):
    """Per task and bucket: the distinct anchors, and whether two of the task's documents have them."""

    def flush(values: list[np.ndarray], docs: list[np.ndarray]) -> pa.RecordBatch:
        v, d = np.concatenate(values), np.concatenate(docs)
        order = np.argsort(v, kind="stable")
        v, d = v[order], d[order]
        cut = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        many = np.minimum.reduceat(d, cut) != np.maximum.reduceat(d, cut)
        v = v[cut]
        rows = [(b, ((v[lo:hi] >> _U(32 - bits)) & _U(0xFFFFFFFF)).astype(np.uint32).tobytes(), np.packbits(many[lo:hi]).tobytes()) for b, lo, hi in _groups((v >> _U(64 - bits)).astype(np.int64))]
        return _binary(rows, ["bucket", "rest", "many"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, docs, size = [], [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in chunks(offsets, CACHED_BYTES):
                own = offsets[lo : hi + 1] - offsets[lo]
                at, anchor = anchors(data[offsets[lo] : offsets[hi]], own, span)
                doc = np.searchsorted(own, at, "right") - 1
                first, _ = segments(at, anchor, doc, span)
                values.append(dealt(anchor[first]))
                docs.append(ids[lo + doc[first]])
                size += len(first)
            if size > 1_000_000:
                yield flush(values, docs)
                values, docs, size = [], [], 0
        if size:
            yield flush(values, docs)

    return run


def _shared_map(bits: int, map_bits: int):
    """Each bucket's part of the map: the bits of every anchor that two documents, or two tasks, have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for b, rest, many in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rest = np.frombuffer(rest, np.uint32)
                held.setdefault(b, []).append((rest, np.unpackbits(np.frombuffer(many, np.uint8), count=len(rest)).astype(bool)))
        for b, parts in held.items():
            rest, many = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(rest, kind="stable")
            rest, many = rest[order], many[order]
            again = np.zeros(len(rest) + 1, bool)
            again[1:-1] = rest[1:] == rest[:-1]
            rest = rest[many | again[:-1] | again[1:]]
            if len(rest):
                flags = np.zeros(1 << (map_bits - bits), bool)
                for place in places(rest, map_bits - bits):
                    flags[place] = True
                yield _binary([(b, np.packbits(flags, bitorder="little").tobytes())], ["bucket", "flags"])

    return run


def _travelling(span: int, bits: int, map_bits: int, flags: np.ndarray, blocks: int):
    """Per task and bucket: the distinct segments (lengths, bytes) and where they occur (segment, document, start).

    Here segments are one if 64-bit hashes of their bytes and their buckets are equal: among the n segments of a flush (8 MB)
    a wrong merge has a chance below n^2 / 2^65, some 10^-9. Buckets compare all bytes.
    """

    def flush(held: list[tuple]) -> pa.RecordBatch:
        anchor, name, doc, start, length, text = (np.concatenate([h[i] for h in held]) for i in range(6))
        offsets = np.concatenate([[0], np.cumsum(length)])
        bucket = (anchor >> _U(64 - bits)).astype(np.int64)
        order = np.lexsort((name, bucket))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (name[order][1:] != name[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])
        pick, number = order[fresh], np.cumsum(fresh) - 1
        rest = ((anchor[pick] >> _U(32 - bits)) & _U(0xFFFFFFFF)).astype(">u4")
        size = length[pick]
        kept = cut_out(text, offsets[pick], size)
        ends = np.concatenate([[0], np.cumsum(size)])
        rows = []
        for b, lo, hi in _groups(bucket[order]):
            own, p, q = order[lo:hi], number[lo], number[hi - 1] + 1
            rows.append((b, rest[p:q].tobytes(), size[p:q].astype(np.uint8).tobytes(), kept[ends[p] : ends[q]].tobytes(), (number[lo:hi] - p).astype(np.uint32).tobytes(), doc[own].tobytes(), start[own].tobytes()))
        return _binary(rows, ["bucket", "rest", "lengths", "bytes", "which", "doc", "start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in chunks(offsets, CACHED_BYTES):
                own, piece = offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
                at, anchor = anchors(piece, own, span)
                first, n = segments(at, anchor, np.searchsorted(own, at, "right") - 1, span)
                place = dealt(anchor[first])
                part = (place >> _U(64 - bits)).astype(np.int64) << (map_bits - bits)
                shared = np.ones(len(place), bool)
                for bit in places(((place >> _U(32 - bits)) & _U(0xFFFFFFFF)).astype(np.uint32), map_bits - bits):
                    bit = part + bit
                    shared &= (flags[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0
                begin, place, length = at[first[shared]], place[shared], n[shared] + span - 1
                if not len(begin):
                    continue
                doc = np.searchsorted(own, begin, "right") - 1
                power, inverse = _power_tables(len(piece) + 1)
                sums = np.concatenate([np.zeros(1, _U), np.cumsum(_VALUES[piece] * power[: len(piece)])])
                name = mix((sums[begin + length] - sums[begin]) * inverse[begin] + length.astype(_U))
                text = cut_out(piece, begin, length)
                held.append((place, name, ids[lo + doc], begin - own[doc], length, text))
                size += len(text)
                if size > 8 << 20:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return run


def repeating_runs(rows: np.ndarray, length: np.ndarray, least: np.ndarray, most: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segment, first window, number of windows and start of the anchor of each run of windows that may repeat.

    rows: segments, padded to one width. Windows whose hash is in one document only do not repeat. All windows of a run
    have the same first occurrence of their anchor.
    """
    k, wide = min(ANCHOR, span), rows.shape[1]
    power, inverse = _power_tables(wide + 1)
    column, window = np.arange(wide - k + 1), np.arange(wide - span + 1)
    name, anchor = np.empty((len(rows), len(window)), _U), np.empty((len(rows), len(window)), np.uint8 if wide < 256 else np.int64)
    for lo in range(0, len(rows), 1 << 11):
        part = rows[lo : lo + (1 << 11)]
        sums = np.zeros((len(part), wide + 1), _U)
        np.cumsum(_VALUES[part] * power[:wide], axis=1, out=sums[:, 1:])
        name[lo : lo + len(part)] = mix((sums[:, span:] - sums[:, :-span]) * inverse[: len(window)])
        h = mix((sums[:, k:] - sums[:, :-k]) * inverse[: len(column)])
        h[column > (length[lo : lo + len(part)] - k)[:, None]] = np.iinfo(_U).max
        at = np.where(h == h.min(axis=1)[:, None], column, column[-1]).astype(anchor.dtype)
        anchor[lo : lo + len(part)] = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, : len(window)]
    live = window <= (length - span)[:, None]
    who, _ = np.nonzero(live)
    _, same = np.unique(name[live], return_inverse=True)
    first, last = extremes(same, least[who], int(same.max()) + 1), extremes(same, most[who], int(same.max()) + 1)
    live[live] = (first[0] < last[1])[same]
    go_on = live[:, 1:] & live[:, :-1] & (anchor[:, 1:] == anchor[:, :-1])
    begin, end = live.copy(), live.copy()
    begin[:, 1:] &= ~go_on
    end[:, :-1] &= ~go_on
    who, first = np.nonzero(begin)
    _, last = np.nonzero(end)
    return who, first, last - first + 1, anchor[who, first].astype(np.int64)


def named(rows: np.ndarray, who: np.ndarray, first: np.ndarray, n: np.ndarray, at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols and lengths of the strings of runs, in which a name stands for the anchor, and a window's symbols.

    An anchor's name is its number among the distinct ones, by all bytes. Its digits are symbols that no byte has, so
    equal windows have equal symbols and others do not.
    """
    k = min(ANCHOR, span)
    used = np.flatnonzero(np.bincount(rows.ravel(), minlength=256))
    base = 255 - len(used)
    if base < 2:
        raise ValueError("texts have to be UTF-8")
    code = np.zeros(256, np.uint8)
    code[used] = 1 + np.arange(len(used))
    spelt = rows[who[:, None], at[:, None] + np.arange(k)]
    distinct, name = np.unique(spelt.view(f"V{k}").ravel(), return_inverse=True)
    digits = 1
    while base**digits < len(distinct):
        digits += 1
    more = digits - k  # symbols that a string has more than bytes
    length, left = n + span - 1 + more, at - first
    column, symbols = np.arange(int(length.max())), []
    for lo in range(0, len(who), 1 << 11):
        x = slice(lo, lo + (1 << 11))
        source = first[x, None] + column - more * (column >= left[x, None])
        out = code[rows[who[x, None], np.clip(source, 0, rows.shape[1] - 1)]]
        each = np.arange(len(out))
        for d in range(digits):
            out[each, left[x] + d] = 1 + len(used) + name[x] // base**d % base
        symbols.append(out[column < length[x, None]])
    return np.concatenate(symbols), length, span + more


def block_of(doc: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(doc.astype(_U)) % _U(blocks)).astype(np.int64)


def extremes(which: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest document of each of n."""
    least, most = np.full(n, NOBODY), np.full(n, -NOBODY)
    np.minimum.at(least, which, doc)
    np.maximum.at(most, which, doc)
    return least, most


def _decide(span: int, blocks: int, folder: str):
    """Per bucket: which windows of each segment an earlier document holds, as runs of bytes by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []
        for batch in batches:  # sorted by bucket
            for row in zip(*batch.columns, strict=True):
                b = row[0].as_py()
                if b != current and parts:
                    yield from decide(parts)
                    parts = []
                current = b
                parts.append([np.frombuffer(x.as_py(), t) for x, t in zip(row[1:], (np.uint8, np.uint8, np.uint8, np.uint32, np.int64, np.int64), strict=True)])
        if parts:
            yield from decide(parts)

    def decide(parts: list) -> Iterator[pa.RecordBatch]:
        rest, length, text = (np.concatenate([p[i] for p in parts]) for i in range(3))
        shift = np.cumsum([0, *(len(p[1]) for p in parts)])
        which = np.concatenate([p[3] + s for p, s in zip(parts, shift[:-1], strict=True)]).astype(np.int64)
        doc, start = (np.concatenate([p[i] for p in parts]) for i in (4, 5))
        wide = int(length.max())
        rows = np.zeros((len(length), wide + 5), np.uint8)
        rows[:, :4], rows[:, 4] = rest.reshape(-1, 4), length
        rows[:, 5:][np.arange(wide) < length[:, None]] = text
        # the map lets some anchors of one document through
        _, anchor = np.unique(rest.view(np.uint32), return_inverse=True)
        least, most = extremes(anchor[which], doc, int(anchor.max()) + 1)
        live = (least < most)[anchor]
        if not live.any():
            return
        kept = live[which]
        which, doc, start, rows = (np.cumsum(live) - 1)[which[kept]], doc[kept], start[kept], rows[live]
        distinct, same = np.unique(rows.view(f"V{wide + 5}").ravel(), return_inverse=True)  # by all bytes
        which = same[which]
        rows = distinct.view(np.uint8).reshape(len(distinct), wide + 5)
        length, rows = rows[:, 4].astype(np.int64), rows[:, 5:]
        least, most = extremes(which, doc, len(length))
        # first: the least document of each window of each segment
        run, skipped, n, at = repeating_runs(rows, length, least, most, span)
        if not len(run):
            return
        symbols, size, window = named(rows, run, skipped, n, at, span)
        bwt, lcp = build(symbols, np.concatenate([[0], np.cumsum(size)]), folder)
        owner = np.full(int(np.count_nonzero(lcp < window)) + 1, NOBODY)
        found = np.full((len(length), wide - span + 1), -1, np.int32)
        for who, at, group in suffix_groups(bwt, lcp, size, window):
            np.minimum.at(owner, group, least[run[who]])
            found[run[who], skipped[who] + at] = group
        first = np.where(found >= 0, owner[found], NOBODY)
        hit = np.flatnonzero((first.min(axis=1) < most)[which])  # occurrences of segments that some document loses
        for lo in range(0, len(hit), 200_000):
            h = hit[lo : lo + 200_000]
            gone = first[which[h]] < doc[h][:, None]
            edge = np.diff(gone.astype(np.int8), axis=1, prepend=0, append=0)
            r, c = np.nonzero(edge > 0)
            _, stop = np.nonzero(edge < 0)
            if not len(r):
                continue
            own, begin, end = doc[h][r], start[h][r] + c, start[h][r] + stop + span - 1
            block = block_of(own, blocks)
            order = np.lexsort((begin, own, block))
            own, begin, end = own[order], begin[order], end[order]
            yield _binary([(b, own[x:y].tobytes(), begin[x:y].tobytes(), end[x:y].tobytes()) for b, x, y in _groups(block[order])], ["block", "doc", "begin", "end"])

    return run


def merge_runs(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs that half-open runs, sorted by begin, cover; runs that touch are one."""
    far = np.maximum.accumulate(end)
    cut = np.flatnonzero(np.append(True, begin[1:] > far[:-1]))
    return begin[cut], np.append(far[cut[1:] - 1], far[-1])


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    for batch in batches:
        for b, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held.setdefault(b, []).append([np.frombuffer(x, np.int64) for x in blobs])
    for parts in held.values():
        doc, begin, end = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.lexsort((begin, doc))
        doc, begin, end = doc[order], begin[order], end[order]
        rows = []
        for d, lo, hi in _groups(doc):
            x, y = merge_runs(begin[lo:hi], end[lo:hi])
            rows.append((d, x.tobytes(), y.tobytes()))
        yield _binary(rows, ["doc", "begin", "end"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 50) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, span_starts, span_ends.

    Each byte goes that is covered by a string of `span` bytes which also starts in a document with a smaller id;
    strings are judged on the input, and matches never cross documents. span_starts and span_ends are byte offsets of
    the maximal removed runs.

    A null or empty text has no bytes. Rows that repeat an id are one document, so none removes from another; a row
    with a null id loses nothing and removes nothing. Texts shorter than `span` keep all. An empty table gives an
    empty result. span must lie between 2 and 150.
    """
    if not 2 <= span <= 150:
        raise ValueError("span must lie between 2 and 150")
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long_enough = rows.where(F.col("id").isNotNull() & (F.octet_length("text") >= span))
    size, count = long_enough.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = min(BUCKET_BITS_MOST, max(8, (2 * partitions - 1).bit_length(), (int(size or 0) // BUCKET_BYTES).bit_length()))
    map_bits = min(MAP_BITS, max(bits + 3, (int(size or 1) // 4).bit_length()))
    blocks = max(partitions, (count or 0) // 256)
    own = long_enough.mapInArrow(_own_anchors(span, bits), "bucket long, rest binary, many binary").repartition(partitions, "bucket")
    flags = np.zeros(1 << (map_bits - 3), np.uint8)
    part = len(flags) >> bits
    for r in own.mapInArrow(_shared_map(bits, map_bits), "bucket long, flags binary").toLocalIterator():
        flags[r["bucket"] * part : (r["bucket"] + 1) * part] = np.frombuffer(r["flags"], np.uint8)
    sent = spark.sparkContext.broadcast(flags)

    def travel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _travelling(span, bits, map_bits, sent.value, blocks)(batches)

    moved = long_enough.mapInArrow(travel, "bucket long, rest binary, lengths binary, bytes binary, which binary, doc binary, start binary").repartition(partitions, "bucket").sortWithinPartitions("bucket")
    runs = moved.mapInArrow(_decide(span, blocks, new_path(spark, "columns")), "block long, doc binary, begin binary, end binary")
    gone = materialize(runs.repartition(partitions, "block").mapInArrow(_by_document, "doc long, begin binary, end binary"), "repeat-runs")
    joined = rows.join(gone, F.col("id") == F.col("doc"), "left").select("id", "text", "begin", "end")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            removed, digests, starts, ends = [], [], [], []
            for i, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                raw = data[offsets[i] : offsets[i + 1]]
                a, b = np.frombuffer(x or b"", np.int64), np.frombuffer(y or b"", np.int64)
                digest, at = hashlib.sha256(), 0
                for lo, hi in zip(a.tolist(), b.tolist(), strict=True):
                    digest.update(raw[at:lo])
                    at = hi
                digest.update(raw[at:])
                removed.append(int((b - a).sum()))
                digests.append(digest.hexdigest())
                starts.append(a)
                ends.append(b)
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array([len(x) for x in starts], pa.int64()), pa.array(digests, pa.string()), pa.array(starts, lists), pa.array(ends, lists)],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "span_starts", "span_ends"],
            )

    done = joined.mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, span_starts array<long>, span_ends array<long>")
    return done.withColumnRenamed("id", id_col)
