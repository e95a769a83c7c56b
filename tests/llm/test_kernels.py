"""Kernels against plain Python."""

import re

import numpy as np
import pyarrow as pa
import pytest

from lorecast.llm import collection_bwt, components, repeats, textkit
from lorecast.llm.licenses import bands_for
from lorecast.llm.repeats import merge_runs


def test_words_equal_a_regular_expression():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ab \t\n\x1f\xa0é"), rng.integers(0, 40))) for _ in range(200)]
    data, offsets = textkit.text_bytes(pa.array([*texts, None]))
    w = textkit.Words(data, offsets)
    names = {}
    for i, t in enumerate(texts):
        want = re.findall("[^\x20\x09-\x0d]+", t)
        got = range(w.offsets[i], w.offsets[i + 1])
        assert [bytes(data[w.starts[k] : w.ends[k]]).decode() for k in got] == want
        for k, x in zip(got, want, strict=True):
            assert names.setdefault(int(w.hashes[k]), x) == x
    assert len(set(names.values())) == len(names)


def test_shingle_sets_count():
    texts = ["a b c d e f", "a b c d e a b c d e", "A b", "", None, "x"]
    data, offsets = textkit.text_bytes(pa.array(texts))
    hashes, at = textkit.shingle_sets(data, offsets)
    assert np.diff(at).tolist() == [2, 5, 1, 0, 0, 1]
    for a, b in zip(at[:-1], at[1:], strict=True):
        assert (np.diff(hashes[a:b].astype(object)) > 0).all()


@pytest.mark.parametrize("piece", [5, 64, 1 << 16])
def test_transform_equals_sorting(monkeypatch, tmp_path, piece):
    monkeypatch.setattr(collection_bwt, "PIECE", piece)
    rng = np.random.default_rng(piece)
    for _ in range(60):
        texts = [bytes(rng.integers(1, rng.integers(2, 5), rng.integers(0, 12)).astype(np.uint8)) for _ in range(rng.integers(1, 9))]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        bwt, lcp = collection_bwt.build(np.frombuffer(b"".join(texts), np.uint8), offsets, f"file://{tmp_path}/x")
        suffixes = sorted((tuple(x[k:]) + (i - 1000,), i, k) for i, x in enumerate(texts) for k in range(len(x) + 1))
        assert bwt.tolist() == [texts[i][k - 1] if k else 0 for _, i, k in suffixes]
        want = [0]
        for (p, _, _), (q, _, _) in zip(suffixes, suffixes[1:], strict=False):
            want.append(next(c for c in range(len(p)) if p[c] != q[c]))
        assert lcp.tolist() == want


def test_files_are_deleted(tmp_path):
    texts = [bytes([1, 2, 3, 4] * 9), bytes([2, 3] * 12)]
    bwt, _ = collection_bwt.build(np.frombuffer(b"".join(texts), np.uint8), np.array([0, 36, 60]), f"file://{tmp_path}/x")
    assert len(bwt) == 62 and not list((tmp_path / "x").iterdir())


def test_components_settle_or_fail(spark):
    chain = spark.range(300).selectExpr("id as u", "id + 1 as v")
    assert {r["root"] for r in components.connected_components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        components.connected_components(chain, most_rounds=2)


def test_merge_runs():
    a, b = merge_runs(np.array([0, 2, 5, 9]), np.array([3, 4, 9, 10]))
    assert (a.tolist(), b.tolist()) == ([0, 5], [4, 10])


def test_band_numbers_bound_the_miss():
    for s in (0.05, 0.3, 0.9):
        assert (1 - s) ** bands_for(s, 1e-4) <= 1e-4


def test_anchors_are_found_within_a_cores_cache(monkeypatch):
    """Pieces of op3 are small, whatever a batch holds; a segment's name does not depend on the piece that it lies in."""
    rng = np.random.default_rng(8)
    shared = rng.bytes(400)
    texts = [rng.bytes(30_000) + shared + rng.bytes(int(rng.integers(100, 900))) for _ in range(12)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(12), pa.int64()), pa.array(texts, pa.binary())], names=["id", "text"])
    sizes, plain = [], repeats.anchors
    monkeypatch.setattr(repeats, "anchors", lambda data, offsets, span: sizes.append(len(data)) or plain(data, offsets, span))
    rows = [r for b in repeats._travelling(50, 4, 20, np.full(1 << 17, 255, np.uint8), 8)([batch]) for r in b.to_pylist()]
    assert max(sizes) <= 1 << 16 and len(sizes) > 1
    occurrences = sum(len(r["which"]) // 4 for r in rows)
    distinct = sum(len(r["lengths"]) for r in rows)
    assert occurrences - distinct >= 11 * 10  # the shared passage travels once
    for r in rows:
        at = np.concatenate([[0], np.cumsum(np.frombuffer(r["lengths"], np.uint8))])
        for w, d, x in zip(np.frombuffer(r["which"], np.uint32), np.frombuffer(r["doc"], np.int64), np.frombuffer(r["start"], np.int64), strict=True):
            part = r["bytes"][int(at[w]) : int(at[w + 1])]
            assert texts[d][x : x + len(part)] == part


@pytest.mark.parametrize("span", [5, 24, 50])
def test_named_anchors_keep_windows_apart(span):
    """Strings of runs hold equal symbols exactly where windows hold equal bytes, periodic windows too."""
    rng = np.random.default_rng(span)
    texts = [bytes(rng.choice([97, 98], 300).astype(np.uint8)) for _ in range(4)] + [b"a" * 300, b"ab" * 150, b"abcabca" * 40, "é€ b".encode() * 40]
    data, offsets = textkit.text_bytes(pa.array(texts + [x[7:] for x in texts], pa.binary()))
    at, anchor = repeats.anchors(data, offsets, span)
    first, n = repeats.segments(at, anchor, np.searchsorted(offsets, at, "right") - 1, span)
    begin, length = at[first], n + span - 1
    rows = np.zeros((len(begin), int(length.max())), np.uint8)
    rows[np.arange(rows.shape[1]) < length[:, None]] = repeats.cut_out(data, begin, length)
    doc = np.searchsorted(offsets, begin, "right") - 1
    who, skipped, m, place = repeats.repeating_runs(rows, length, doc, doc, span)
    symbols, size, window = repeats.named(rows, who, skipped, m, place, span)
    ends = np.cumsum(size)
    spelt = {(int(w), int(c + j)): symbols[e - z + j : e - z + j + window].tobytes() for w, c, k, z, e in zip(who, skipped, m, size, ends, strict=True) for j in range(k)}
    held, by_bytes, by_symbols = {}, {}, {}
    for s in range(len(rows)):
        for c in range(n[s]):
            held.setdefault(rows[s, c : c + span].tobytes(), []).append((s, c))
    for x, places in held.items():
        if len({doc[s] for s, _ in places}) > 1:
            for p in places:
                assert by_bytes.setdefault(x, spelt[p]) == spelt[p] and by_symbols.setdefault(spelt[p], x) == x
        else:
            assert not any(p in spelt for p in places)
    assert len(by_bytes) > 30 and len(spelt) == sum(len(v) for x, v in held.items() if x in by_bytes)


def test_full_map_adds_nothing_to_the_transform(monkeypatch, tmp_path):
    """However many anchors of one document travel, the collection holds windows that two documents may share, anchors named."""
    rng = np.random.default_rng(9)
    shared = bytes(rng.integers(97, 123, 400).astype(np.uint8))
    texts = [bytes(rng.integers(97, 123, 4000).astype(np.uint8)) + shared for _ in range(3)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(3), pa.int64()), pa.array(texts, pa.binary())], names=["id", "text"])
    moved = list(repeats._travelling(50, 4, 20, np.full(1 << 17, 255, np.uint8), 8)([batch]))
    given, plain = [], repeats.build
    monkeypatch.setattr(repeats, "build", lambda symbols, offsets, folder: given.append(len(symbols)) or plain(symbols, offsets, folder))
    blobs = sorted((r for b in moved for r in b.to_pylist()), key=lambda r: r["bucket"])
    runs = list(repeats._decide(50, 8, f"file://{tmp_path}/x")(iter([pa.RecordBatch.from_pylist(blobs, schema=moved[0].schema)])))
    gone = [set() for _ in texts]
    for r in (r for b in runs for r in b.to_pylist()):
        for d, x, y in zip(*(np.frombuffer(r[c], np.int64).tolist() for c in ("doc", "begin", "end")), strict=True):
            gone[d].update(range(x, y))
    assert not gone[0] and gone[1] == gone[2] == set(range(4000, 4400))
    assert sum(given) < 4 * (400 - 49)


def test_map_of_anchors_stays_selective():
    """With a shared anchor for every ten bits, few others pass."""
    rng = np.random.default_rng(10)
    ours, others = rng.integers(0, 1 << 32, (2, 1 << 14), dtype=np.uint32)
    flags = np.zeros(1 << 17, bool)
    for at in repeats.places(ours[: (1 << 17) // 10], 17):
        flags[at] = True
    passed = np.ones(len(others), bool)
    for at in repeats.places(others, 17):
        passed &= flags[at]
    assert passed.mean() < 0.05
