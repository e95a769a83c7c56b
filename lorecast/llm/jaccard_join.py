"""N-gram Jaccard self-join by set-relation skipping.

Which documents' shingle sets reach a Jaccard similarity, exactly but for hash collisions: sets are named by 63 bits and
shingles by 64, so among N sets a wrong merge has a chance below N^2 / 2^64, and a wrong shingle match below the square
of the number of distinct shingles over 2^65.

* Index level: a set of n shingles shares one of its first n - ceil(t n) + 1 shingles, in any one order of all shingles,
  with each partner. The lists of these prefixes are sorted by size and skipped in blocks where sizes and positions rule
  a link out; a gap in size that no link can cross cuts a list.
* Answer level: every list has a leader, its member of least name. A set goes to each of its leaders once, however many
  lists they share. There its overlap with the leader is computed, and its overlaps with the leader's other sets follow
  from that answer by its difference from the leader alone; where the answers already rule a link out nothing is
  computed. Any two sets of one list have that list's leader in common, so no link is missed, and no pair is ever written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import materialize, ship
from .textkit import chunks, mix, shingle_sets, text_bytes

_U = np.uint64
#: Shingles in at least this many sets come last in the order.
FREQUENT = 4
#: So many of the most frequent shingles are known to all tasks (8 bytes each); any others are merely not put last.
FREQUENT_MOST = 1_000_000
#: A shingle in so many sets makes no list: its leader is found first and each set is sent to it from where it is.
HOT = 100_000
BLOCK = 64
#: A leader's sets are dealt in blocks of about so many sets and shingles; a task compares two blocks at most.
BLOCK_SETS, BLOCK_SHINGLES = 4096, 2_000_000
#: Up to so many (leader, set) rows are broadcast to choose texts; beyond that, a shuffled join does it.
BROADCAST_ROWS = 500_000


def set_id(hashes: np.ndarray) -> int:
    """A 63-bit name of a shingle set: equal sets, and no others but by a hash collision, share it."""
    weights = np.arange(1, len(hashes) + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)
    return int(mix(np.array([np.sum(mix(hashes ^ mix(weights)), dtype=_U) + _U(len(hashes))], _U))[0] >> _U(1))


def sets_of(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Index and sorted distinct shingles of each text."""
    data, offsets = text_bytes(column)
    for lo, hi in chunks(offsets):
        hashes, at = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
        for i in range(hi - lo):
            yield lo + i, hashes[at[i] : at[i + 1]]


def _distinct_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Name and shingles of each set, once a task."""
    seen = set()
    for batch in batches:
        for _, hashes in sets_of(batch.column(0), k):
            if len(hashes) and (name := set_id(hashes)) not in seen:
                seen.add(name)
                yield name, hashes


def _least_overlap(total: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap o with 100 o >= percent (total - o), for two sets of total shingles together."""
    return -(-percent * total // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n + 1 - -(-percent * n // 100)


def _spread(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and the 32 bits after it of each hash. Two hashes may share both: that only adds candidates."""
    return (hashes >> _U(64 - bits)).astype(np.int64), ((hashes >> _U(32 - bits)) & _U(0xFFFFFFFF)).astype(np.uint32)


def _codes(hashes: np.ndarray, bits: int) -> np.ndarray:
    bucket, rest = _spread(hashes, bits)
    return (bucket << 32) | rest.astype(np.int64)


def _among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which codes are in the sorted array."""
    if not len(known):
        return np.zeros(len(codes), bool)
    return known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes


def _edges(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(cut, np.append(cut[1:], len(bucket)), strict=True):
        yield int(bucket[a]), int(a), int(b)


def _count_shingles(k: int, bits: int):
    """Per task and bucket: the distinct shingles and in how many of the task's sets each is."""

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        bucket, rest = _spread(found, bits)
        rows = [(b, rest[lo:hi].tobytes(), np.minimum(n[lo:hi], 65535).astype(np.uint16).tobytes()) for b, lo, hi in _edges(bucket)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "rest", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, hashes in _distinct_sets(batches, k):
            held.append(hashes.copy())
            size += len(hashes)
            if size > 2_000_000:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    return run


def _frequent(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for b, rest, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.setdefault(b, []).append((np.frombuffer(rest, np.uint32), np.frombuffer(n, np.uint16)))
        for b in list(held):
            rest, n = (np.concatenate(x) for x in zip(*held.pop(b), strict=True))
            n = n.astype(np.int64)
            order = np.argsort(rest, kind="stable")
            rest, n = rest[order], n[order]
            cut = np.flatnonzero(np.diff(rest.astype(np.int64), prepend=-1))
            total = np.add.reduceat(n, cut)
            keep = total >= least
            if keep.any():
                codes = (b << 32) | rest[cut][keep].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(total[keep])], names=["code", "n"])

    return run


class Prefixes:
    """The first shingles of a set in the common order: the rarer ones first, then by hash."""

    def __init__(self, percent: int, bits: int, frequent: np.ndarray):
        self.percent, self.bits, self.frequent = percent, bits, frequent

    def of(self, hashes: np.ndarray) -> np.ndarray:
        last = _among(_codes(hashes, self.bits), self.frequent)
        p = prefix_length(len(hashes), self.percent)
        return np.concatenate([hashes[~last], hashes[last]])[:p] if last.any() else hashes[:p].copy()


def _postings(k: int, prefixes: Prefixes, hot: np.ndarray):
    """Per task and bucket: the postings of the prefixes of the task's distinct sets, without the hot shingles."""
    bits = prefixes.bits

    def flush(held: list[tuple]) -> pa.RecordBatch:
        tokens = np.concatenate([h[0] for h in held])
        which = np.repeat(np.arange(len(held), dtype=np.uint32), [len(h[0]) for h in held])
        position = np.concatenate([h[3] for h in held])
        names, sizes = np.array([h[1] for h in held], np.int64), np.array([h[2] for h in held], np.uint32)
        order = np.argsort(tokens, kind="stable")
        bucket, rest = _spread(tokens[order], bits)
        which, position = which[order], np.minimum(position[order], 65535).astype(np.uint16)
        out = []
        for b, lo, hi in _edges(bucket):
            own, local = np.unique(which[lo:hi], return_inverse=True)
            out.append((b, rest[lo:hi].tobytes(), local.astype(np.uint32).tobytes(), position[lo:hi].tobytes(), names[own].tobytes(), sizes[own].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.binary() if i else pa.int64()) for i in range(6)], names=["bucket", "rest", "which", "position", "names", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for name, hashes in _distinct_sets(batches, k):
            first = prefixes.of(hashes)
            position = np.arange(len(first))
            if len(hot):
                cold = ~_among(_codes(first, bits), hot)
                first, position = first[cold], position[cold]
            if len(first):
                held.append((first, name, len(hashes), position))
                size += len(first)
            if size > 1_000_000:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return run


def _hot_leaders(k: int, prefixes: Prefixes, hot: np.ndarray):
    """Per task: of each hot shingle the least name among the task's sets that have it in their prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.full(len(hot), np.iinfo(np.int64).max)
        for name, hashes in _distinct_sets(batches, k):
            codes = _codes(prefixes.of(hashes), prefixes.bits)
            at = np.searchsorted(hot, codes[_among(codes, hot)])
            least[at] = np.minimum(least[at], name)
        found = least < np.iinfo(np.int64).max
        yield pa.RecordBatch.from_arrays([pa.array(hot[found]), pa.array(least[found])], names=["code", "leader"])

    return run


def _hot_rows(k: int, prefixes: Prefixes, hot: np.ndarray, leaders: np.ndarray):
    """Each set with the leaders of the hot shingles in its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, hashes in _distinct_sets(batches, k):
            codes = _codes(prefixes.of(hashes), prefixes.bits)
            own = np.unique(leaders[np.searchsorted(hot, codes[_among(codes, hot)])])
            if len(own):
                yield _pair_batch(own, np.full(len(own), name), np.full(len(own), len(hashes)))

    return run


def viable(n: np.ndarray, position: np.ndarray, percent: int) -> np.ndarray:
    """Which members of a list, sorted by size, may link with another member, by sizes and positions.

    A pair that meets at these positions overlaps by at most one plus the shorter rest. The list is cut into blocks;
    a pair of blocks is skipped where even its largest smaller set and its smallest larger set are too far apart in
    size, or where its longest rests are too short for its smallest sizes.
    """
    keep = np.zeros(len(n), bool)
    rest = n - position
    starts = range(0, len(n), BLOCK)
    for i in starts:
        a = slice(i, min(i + BLOCK, len(n)))
        for j in range(i, len(n), BLOCK):
            b = slice(j, min(j + BLOCK, len(n)))
            if 100 * n[a][-1] < percent * n[b][0]:
                break
            if keep[a].all() and keep[b].all():
                continue
            if min(rest[a].max(), rest[b].max()) < _least_overlap(n[a][0] + n[b][0], percent):
                continue
            ok = (100 * n[a][:, None] >= percent * n[b][None, :]) & (100 * n[b][None, :] >= percent * n[a][:, None])
            ok &= np.minimum(rest[a][:, None], rest[b][None, :]) >= _least_overlap(n[a][:, None] + n[b][None, :], percent)
            if i == j:
                np.fill_diagonal(ok, False)
            keep[a] |= ok.any(axis=1)
            keep[b] |= ok.any(axis=0)
    return keep


def _pair_batch(leader: np.ndarray, member: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (leader, member, n)], names=["leader", "member", "n"])


def led(names: np.ndarray, sizes: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Leader, member and size for each stretch of a list sorted by size that no link leaves."""
    gaps = np.flatnonzero(100 * sizes[:-1] < percent * sizes[1:]) + 1
    for a, b in zip([0, *gaps.tolist()], [*gaps.tolist(), len(names)], strict=True):
        if b - a > 1:
            yield np.full(b - a, names[a:b].min()), names[a:b], sizes[a:b]


def _led(percent: int):
    """From all postings of a bucket: the sets of each list with its leader, each (leader, set) once a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for b, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rest, which, position, names, sizes = (np.frombuffer(x, t) for x, t in zip(blobs, (np.uint32, np.uint32, np.uint16, np.int64, np.uint32), strict=True))
                held.setdefault(b, []).append((rest, names[which], sizes[which].astype(np.int64), position.astype(np.int64)))
        for b in list(held):
            rest, names, sizes, position = (np.concatenate(x) for x in zip(*held.pop(b), strict=True))
            order = np.argsort(rest, kind="stable")
            rest, names, sizes, position = rest[order], names[order], sizes[order], position[order]
            again = np.zeros(len(rest) + 1, bool)
            again[1:-1] = rest[1:] == rest[:-1]
            live = again[:-1] | again[1:]
            rest, names, sizes, position = rest[live], names[live], sizes[live], position[live]
            if not len(rest):
                continue
            order = np.lexsort((position, names, sizes, rest))
            rest, names, sizes, position = rest[order], names[order], sizes[order], position[order]
            fresh = np.ones(len(rest), bool)  # a set that several tasks brought counts once
            fresh[1:] = (names[1:] != names[:-1]) | (rest[1:] != rest[:-1])
            rest, names, sizes, position = rest[fresh], names[fresh], sizes[fresh], position[fresh]
            cut = np.flatnonzero(np.diff(rest.astype(np.int64), prepend=-1))
            ends = np.append(cut[1:], len(rest))
            two = cut[ends - cut == 2]  # most lists: judged together
            small, large = sizes[two], sizes[two + 1]
            ok = (100 * small >= percent * large) & (np.minimum(small - position[two], large - position[two + 1]) >= _least_overlap(small + large, percent))
            two = np.concatenate([two[ok], two[ok] + 1])
            lead = np.minimum(names[two], names[np.roll(two, len(two) // 2)])
            out = [(lead, names[two], sizes[two])]
            for lo, hi in zip(cut.tolist(), ends.tolist(), strict=True):
                if hi - lo > 2:
                    keep = viable(sizes[lo:hi], position[lo:hi], percent)
                    if keep.any():
                        out += led(names[lo:hi][keep], sizes[lo:hi][keep], percent)
            leader, member, n = (np.concatenate(x) for x in zip(*out, strict=True))
            if len(leader):
                order = np.lexsort((member, leader))
                leader, member, n = leader[order], member[order], n[order]
                first = np.ones(len(leader), bool)
                first[1:] = (leader[1:] != leader[:-1]) | (member[1:] != member[:-1])
                yield _pair_batch(leader[first], member[first], n[first])

    return run


def _lists(owner: np.ndarray, code: np.ndarray, owners: int, codes: int) -> tuple[np.ndarray, ...]:
    """Codes by owner and owners by code, each as values and offsets."""
    by_owner, by_code = np.argsort(owner, kind="stable"), np.argsort(code, kind="stable")
    return code[by_owner], np.searchsorted(owner[by_owner], np.arange(owners + 1)), owner[by_code], np.searchsorted(code[by_code], np.arange(codes + 1))


def _gather(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The values of several stretches, one after the other."""
    length = ends - starts
    total = int(length.sum())
    if not total:
        return values[:0]
    return values[np.repeat(starts - np.cumsum(length) + length, length) + np.arange(total)]


class Derived:
    """Overlaps among the sets of one leader, from their overlaps with the leader and their differences from it.

    Of a set's part inside the leader the shorter description is kept: what it has of the leader, or what it lacks.
    With both lacking: |y & z| = |y & x| + |z & x| - |x| + |what both lack|, and likewise for the other cases; to each
    comes what y and z share outside the leader.
    """

    def __init__(self, base: np.ndarray, sets: list[np.ndarray]):
        m, self.size = len(sets), len(base)
        self.n = np.array([len(s) for s in sets], np.int64)
        tokens, own = np.concatenate(sets), np.repeat(np.arange(m), self.n)
        at = np.minimum(np.searchsorted(base, tokens), self.size - 1)
        hit = base[at] == tokens
        self.inside = np.bincount(own[hit], minlength=m)
        self.lacking = 2 * self.inside >= self.size
        rank = np.cumsum(self.lacking) - 1
        missing = np.ones((int(self.lacking.sum()), self.size), bool)
        near = hit & self.lacking[own]
        missing[rank[own[near]], at[near]] = False
        row, column = np.nonzero(missing)
        far = hit & ~near
        owner = np.concatenate([np.flatnonzero(self.lacking)[row], own[far]])
        self.within = _lists(owner, np.concatenate([column, at[far]]), m, self.size)
        _, code, n = np.unique(tokens[~hit], return_inverse=True, return_counts=True)
        shared = n[code] > 1
        self.beyond = _lists(own[~hit][shared], code[shared], m, len(n))

    def _common(self, z: int, part: tuple[np.ndarray, ...]) -> np.ndarray:
        codes, at, owners, ends = part
        mine = codes[at[z] : at[z + 1]]
        return np.bincount(_gather(owners, ends[mine], ends[mine + 1]), minlength=len(self.n))

    def most(self, z: int) -> np.ndarray:
        """Upper bounds of the overlaps of set z with all sets, from the known answers."""
        return np.minimum(self.inside[z], self.inside) + np.minimum(self.n[z] - self.inside[z], self.n - self.inside)

    def overlaps(self, z: int) -> np.ndarray:
        """The overlaps of set z with all other sets."""
        c = self._common(z, self.within)
        if self.lacking[z]:
            o = np.where(self.lacking, self.inside[z] + self.inside - self.size + c, self.inside - c)
        else:
            o = np.where(self.lacking, self.inside[z] - c, c)
        return o + self._common(z, self.beyond)


def group_links(base: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, masks: np.ndarray, copies: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which sets of one leader are connected (the index of the first of each class), and each set's number of linked rows.

    Only pairs of a set of `left` and one of `right` count (either may be all). A pair whose masks meet has an
    earlier leader in common, which counts its link.
    """
    m = len(sets)
    found = Derived(base, sets)
    label, count = np.arange(m), np.zeros(m, np.int64)
    for z in range(m):
        if not (left[z] or right[z]):
            continue
        y = np.arange(z)
        y = y[(left[z] & right[:z]) | (right[z] & left[:z])]
        y = y[100 * found.most(z)[y] >= percent * (found.n[y] + found.n[z] - found.most(z)[y])]
        if not len(y):
            continue
        o = found.overlaps(z)[y]
        y = y[100 * o >= percent * (found.n[y] + found.n[z] - o)]
        if not len(y):
            continue
        classes = np.unique(np.append(label[y], label[z]))
        if len(classes) > 1:
            label[np.isin(label, classes)] = classes[0]
        y = y[~(masks[y] & masks[z]).any(axis=1)]
        count[z] += copies[y].sum()
        count[y] += copies[z]
    return label, count


def _masks(others: list[bytes]) -> np.ndarray:
    """A bit for each earlier leader of each set."""
    arrays = [np.frombuffer(x, np.int64) for x in others]
    every, code = np.unique(np.concatenate(arrays), return_inverse=True)
    words = np.zeros((len(arrays), max(1, -(-len(every) // 64))), _U)
    np.bitwise_or.at(words, (np.repeat(np.arange(len(arrays)), [len(a) for a in arrays]), code // 64), _U(1) << (code % 64).astype(_U))
    return words


def _answers(percent: int):
    """Per leader and pair of blocks: each set's class and number of links there. At most one row per set."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        leader, i, j = (k.as_py() for k in key)
        name, first = np.unique(table["name"].to_numpy(), return_index=True)  # a repeated row comes twice
        table = table.take(pa.array(first))
        sets = [np.frombuffer(x, _U) for x in table["sig"].to_pylist()]
        block, copies = table["block"].to_numpy(), table["copies"].to_numpy()
        base = sets[int(np.searchsorted(name, leader))]
        label, count = group_links(base, sets, block == i, block == j, _masks(table["earlier"].to_pylist()), copies, percent)
        live = (label != np.arange(len(name))) | (count > 0)
        return pa.table({"name": name[live], "to": name[label[live]], "links": count[live]})

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, hot: int = HOT, block_sets: int = BLOCK_SETS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per document: id, n_shingles, component_id, n_links.

    A document's set holds its distinct k-word shingles (A-Z lower-cased; the whole sequence where it has fewer
    words). Documents link from a Jaccard similarity of percent / 100; component_id is the smallest id that a document
    reaches, n_links the number of other documents that it links with, equal ones included. Equal sets are one set
    throughout.

    A leader's sets are dealt in blocks of about block_sets sets and block_shingles shingles; every two blocks meet in
    one task. A shingle in `hot` sets or more makes no list. None of the three changes the result.

    Null and word-less texts have no shingles, link with nothing and form their own components; so do rows with a
    null id, whose component is null and which nobody counts. Rows that repeat an id share a component if their texts
    link. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def name_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, name = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, hashes in sets_of(batch.column(1), k):
                n[i], name[i] = len(hashes), set_id(hashes) if len(hashes) else 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(name)], names=["id", "n", "name"])

    named = materialize(rows.mapInArrow(name_sets, "id long, n long, name long"), "jaccard-sets")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(6, (2 * partitions - 1).bit_length())
    texts = rows.where("id is not null").select("text")
    counted = texts.mapInArrow(_count_shingles(k, bits), "bucket long, rest binary, n binary").repartition(partitions, "bucket")
    top = counted.mapInArrow(_frequent(FREQUENT), "code long, n long").orderBy(F.desc("n"), "code").limit(FREQUENT_MOST).toArrow()
    codes, counts = (top[c].to_numpy().astype(np.int64) for c in ("code", "n"))
    prefixes, hot_codes = Prefixes(percent, bits, np.sort(codes)), np.sort(codes[counts >= hot])
    postings = texts.mapInArrow(_postings(k, prefixes, hot_codes), "bucket long, rest binary, which binary, position binary, names binary, sizes binary")
    pairs = postings.repartition(partitions, "bucket").mapInArrow(_led(percent), "leader long, member long, n long")
    if len(hot_codes):
        least = texts.mapInArrow(_hot_leaders(k, prefixes, hot_codes), "code long, leader long").groupBy("code").agg(F.min("leader").alias("leader")).toArrow()
        order = np.argsort(least["code"].to_numpy())
        seen, leaders = least["code"].to_numpy()[order], least["leader"].to_numpy()[order]
        pairs = pairs.unionByName(texts.mapInArrow(_hot_rows(k, prefixes, seen, leaders), "leader long, member long, n long"))
    pairs = materialize(pairs.distinct(), "jaccard-led")

    blocks = F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / block_sets), F.ceil(F.sum("n") / block_shingles)).cast("long")
    load = pairs.groupBy("leader").agg(blocks.alias("blocks"), F.count(F.lit(1)).alias("sets")).where("sets > 1").select(F.col("leader").alias("x"), "blocks")
    whose = pairs.join(load, F.col("leader") == F.col("x")).groupBy("member").agg(F.sort_array(F.collect_list(F.struct("leader", "blocks"))).alias("leaders"))
    reps = named.where((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("name").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    chosen = reps.join(whose, F.col("name") == F.col("member")).select("rep", "name", "copies", F.col("leaders.leader").alias("leaders"), F.col("leaders.blocks").alias("blocks"))
    chosen = materialize(chosen, "jaccard-chosen")
    side = F.broadcast(chosen) if pairs.count() <= BROADCAST_ROWS else chosen

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each chosen set, once for each of its leaders and pairs of blocks. A repeated id brings other texts: the name tells."""
        for batch in batches:
            want, copies, leaders, blocks = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3), batch.column(4)
            for r, hashes in sets_of(batch.column(0), k):
                if not len(hashes) or set_id(hashes) != want[r]:
                    continue
                own, out = np.sort(np.array(leaders[r].as_py(), np.int64)), []
                for x, nb in zip(leaders[r].as_py(), blocks[r].as_py(), strict=True):
                    block = int(mix(np.array([want[r] ^ x], np.int64).astype(_U))[0] % _U(nb))
                    meets = [(min(block, o), max(block, o)) for o in range(nb)]
                    if x == want[r]:  # every task of the leader needs the leader
                        meets = [(a, b) for a in range(nb) for b in range(a, nb)]
                    out += [(x, a, b, block, own[own < x].tobytes()) for a, b in meets]
                size = len(out)
                columns = [pa.array([o[c] for o in out], pa.binary() if c == 4 else pa.int64()) for c in range(5)]
                columns += [pa.array(np.full(size, want[r])), pa.array(np.full(size, copies[r])), pa.array([hashes.tobytes()] * size, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["leader", "i", "j", "block", "earlier", "name", "copies", "sig"])

    sent = rows.join(side, F.col("id") == F.col("rep")).select("text", "name", "copies", "leaders", "blocks")
    sent = sent.mapInArrow(signatures, "leader long, i long, j long, block long, earlier binary, name long, copies long, sig binary")
    answers = materialize(sent.groupBy("leader", "i", "j").applyInArrow(_answers(percent), "name long, to long, links long"), "jaccard-answers")

    roots = connected_components(answers.where("name <> to").select(F.col("name").alias("u"), F.col("to").alias("v")))
    links = answers.groupBy("name").agg(F.sum("links").alias("links")).where("links > 0").select(F.col("name").alias("l_name"), "links")
    classes = reps.join(roots, F.col("name") == F.col("node"), "left").join(links, F.col("name") == F.col("l_name"), "left")
    classes = classes.where("copies > 1 or root is not null").withColumn("root", F.coalesce("root", "name")).withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    smallest = classes.groupBy("root").agg(F.min("rep").alias("component")).withColumnRenamed("root", "of_root")
    classes = classes.join(smallest, F.col("root") == F.col("of_root")).select(F.col("name").alias("c_name"), "component", "links")
    out = named.join(classes, (F.col("name") == F.col("c_name")) & (F.col("n") > 0) & F.col("id").isNotNull(), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), F.coalesce("links", F.lit(0).cast("long")).alias("n_links"))
