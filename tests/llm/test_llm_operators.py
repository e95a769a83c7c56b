"""The operators on small tables: brute force, round trips, and odd inputs."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorecast.llm import decontaminate, jaccard_join, licenses, mixing, quality, toxicity, url_filter, warc
from lorecast.llm.exact_dedup import exact_dedup
from lorecast.llm.repeats import remove_repeats

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, score string, size string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def words(x):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))


def docs(spark, texts, first=0):
    rows = [(i + first, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    base = " ".join(f"word{i}" for i in range(60))
    texts = [None, "", " \t\n", "a b", "A B", "a b c d e", base, base, base + " tail", base.replace("word30", "other"), "x" * 30_000 + " " + base, "é ü ß " * 50, "same line\n" * 40, None, base.upper(), "\x00 odd \x1f bytes"]
    return docs(spark, texts).unionByName(docs(spark, [base], 100)).unionByName(docs(spark, [base], 100)).unionByName(spark.createDataFrame([(None, base, None, None, None, None, None, None)], SCHEMA)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def components(sets):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    for ids in where.values():
        for a in ids:
            for b in ids:
                if a < b and find(a) != find(b):
                    o = len(sets[a] & sets[b])
                    if 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def shingles(x):
    w = words(x)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def check_components(table, **options):
    rows = [r for r in table.select("doc_id", "text").collect() if r["doc_id"] is not None]
    sets = {r["doc_id"]: shingles(r["text"]) for r in rows}
    want = components(sets)
    every = [sets[r["doc_id"]] for r in rows]
    got = {r["doc_id"]: r for r in jaccard_join.jaccard_components(table, **options).collect()}
    for i, own in sets.items():
        links = sum(linked(own, s) for s in every) - bool(own)
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["n_links"]) == (len(own), want[i], links)


def test_jaccard_components_equal_brute_force(spark, odd):
    check_components(odd)
    assert jaccard_join.jaccard_components(odd).where("doc_id is null").collect()[0]["component_id"] is None


@pytest.mark.parametrize("options", [{}, {"hot": 8}, {"block_sets": 10}, {"hot": 8, "block_shingles": 900}])
def test_jaccard_components_of_many_near_copies(spark, options):
    import random

    rng = random.Random(4)
    common = [f"w{i}" for i in range(40)]
    texts = []
    for g in range(6):
        base = [f"g{g}x{i}" for i in range(80)] + common
        for _ in range(45):
            w = list(base)
            for _ in range(rng.randrange(0, 9)):
                w[rng.randrange(len(w))] = f"e{rng.random()}"
            texts.append(" ".join(w[: rng.choice([110, 120])]))
    check_components(docs(spark, texts + texts[:7]), **options)


def test_derived_overlaps_equal_intersections():
    import random

    rng = random.Random(7)
    for _ in range(60):
        base = set(rng.sample(range(200), rng.randrange(1, 60)))
        sets = [base]
        for _ in range(rng.randrange(1, 9)):
            sets.append(set(rng.sample(sorted(base), rng.randrange(len(base) + 1))) | set(rng.sample(range(100, 300), rng.randrange(1, 40))))
        arrays = [np.array(sorted(x), np.uint64) for x in sets]
        found = jaccard_join.Derived(arrays[0], arrays)
        for z, x in enumerate(sets):
            got, want = found.overlaps(z), [len(x & y) for y in sets]
            assert [o for i, o in enumerate(got) if i != z] == [o for i, o in enumerate(want) if i != z]
            assert all(found.most(z) >= got)


def test_jaccard_edges(spark, empty):
    assert jaccard_join.jaccard_components(empty).count() == 0
    assert jaccard_join.prefix_length(10, 80) == 3


def brute_repeats(texts, span):
    first = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - span + 1):
            first.setdefault(texts[i][k : k + span], i)
    out = {}
    for i, x in texts.items():
        gone = bytearray(len(x))
        for k in range(len(x) - span + 1):
            if first[x[k : k + span]] < i:
                gone[k : k + span] = b"\1" * span
        kept = bytes(c for c, g in zip(x, gone, strict=True) if not g)
        out[i] = (len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("span", [5, 50])
def test_repeats_equal_brute_force(spark, odd, span):
    table = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    want = brute_repeats({r["doc_id"]: (r["text"] or "").encode() for r in table.collect()}, span)
    for r in remove_repeats(table, span=span).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want[r["doc_id"]]
        assert sum(b - a for a, b in zip(r["span_starts"], r["span_ends"], strict=True)) == r["n_removed"]


def test_repeats_edges(spark, empty, odd):
    assert remove_repeats(empty).count() == 0
    found = remove_repeats(odd)
    assert found.where("doc_id is null and n_removed > 0").count() == 0
    assert found.where("doc_id = 100").count() == 2
    with pytest.raises(ValueError):
        remove_repeats(odd, span=1)


def test_exact_dedup(spark, odd, empty):
    got = exact_dedup(odd).collect()
    rows = odd.collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in rows:
        by[r["text"] or ""].append(r["doc_id"])
    keep = {hashlib.sha256(t.encode()).hexdigest(): (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in by.items()}
    for r in got:
        assert (r["keep_id"], r["group_size"]) == keep[r["text_sha256"]]
        assert r["kept"] == (r["doc_id"] == r["keep_id"])
    assert exact_dedup(empty).count() == 0


def test_mixing(spark, odd, empty):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mix_sources(table).collect()
    assert len(got) == table.count()
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    for s in target:
        assert target[s] <= 3 * size[s] + 1e-6
        assert abs(taken[s] - target[s]) <= 64
    assert abs(sum(target.values()) - sum(size.values())) < 1e-3
    again = mixing.mix_sources(table.repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)
    assert mixing.mix_sources(empty).count() == 0
    strange = mixing.mix_sources(odd).collect()
    assert len(strange) == odd.count() and all(r["size"] == len(words(t)) for r, t in ((r, next(x["text"] for x in odd.collect() if x["doc_id"] == r["doc_id"])) for r in strange))


def test_sainte_lague_gives_highest_quotients():
    import random

    rng = random.Random(1)
    for _ in range(200):
        w = [rng.choice([0, 1, 2.5, 10, 33.3]) for _ in range(rng.randrange(1, 7))]
        seats = rng.randrange(0, 40)
        slow = [0] * len(w)
        for _ in range(seats if sum(w) else 0):
            i = max(range(len(w)), key=lambda k: (w[k] / (2 * slow[k] + 1), -k))
            slow[i] += 1
        fast = mixing.sainte_lague(w, seats)
        assert sum(fast) == sum(slow)
        assert sorted(x / (2 * k + 1) for x, k in zip(w, fast, strict=True)) == pytest.approx(sorted(x / (2 * k + 1) for x, k in zip(w, slow, strict=True)))
    assert mixing.capped_targets([10, 1000], [1, 1], 1010, 3) == [30.0, 980.0]


def test_url_filter(spark):
    urls = ["http://A.Example.com/en/x", "https://www.example.com/en/1?q=1", "http://example.com", "x.net", None, "http://a.net/es/9", "http://net/fr/", "http://notnet/es/", "ftp://b.org/a/b?c=1&d=2#f", "http://h.com?x/y", "a://b://c/"]
    pages = spark.createDataFrame([(i, u, "h", "w") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, trees=2, depth=2).collect()}
    assert [got[i]["rule"] for i in range(len(urls))] == ["example.com/en/", "www.example.com/en/", None, None, None, "net/es/", "net/fr/", None, None, None, None]
    assert (got[0]["host"], got[0]["path"], got[0]["verdict"]) == ("a.example.com", "/en/x", "block")
    assert (got[9]["host"], got[9]["path"]) == ("h.com", "")
    assert (got[3]["host"], got[4]["path"], got[10]["host"]) == ("", "", "b:")
    assert all(r["verdict"] in ("allow", "block") for r in got.values())
    assert url_filter.filter_urls(pages.where("false")).count() == 0


def test_many_rules_and_odd_urls(spark, monkeypatch):
    urls = ["http://a.com/x/1", "http://b.a.com/x", "http://a.com/", None, "http://a.com/x/1", "http://" + "a" * 50_000 + ".com/" + "y" * 50_000]
    pages = spark.createDataFrame([(i if i % 2 else None, u, "a") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = (("allow", "com/"), ("block", "a.com/x/"), ("allow", "a.com/"), ("block", "b.a.com/"), ("allow", "a.com/z/"), ("block", "a.com/z/"))
    read = lambda: sorted((tuple(r)[:5] for r in url_filter.filter_urls(pages, rules, trees=1, depth=1).collect()), key=repr)
    few = read()
    monkeypatch.setattr(url_filter, "EXPRESSION_RULES", 2)
    assert read() == few and len(few) == len(urls)
    assert {r[3] for r in few} == {"a.com/x/", "b.a.com/", "a.com/", "com/", None}


def test_trees_score_as_loops_do(spark):
    table = spark.read.parquet(f"{SF}/pages.parquet")
    rows = table.selectExpr("cast(length(url) as double) as a", "cast(page_id % 5 as double) as b", "cast(page_id % 2 as double) as y")
    model = url_filter.fit_trees(rows, ("a", "b"), trees=3, depth=2)
    for r in rows.withColumn("m", model.margin([F.col("a"), F.col("b")])).collect():
        want = model.base
        for splits, leaves in model.trees:
            node = 0
            for f, cut in splits:
                node = 2 * node + (r["ab"[f]] > cut)
            want += leaves[node]
        assert r["m"] == pytest.approx(want)


def test_network_and_quality_score_as_loops_do():
    texts = ["", "one", "Bad bad words, here!", "x " * 300 + "end"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    ids, at = toxicity.tokens(data, offsets)
    labels = np.array([0.0, 1.0, 1.0, 0.0])
    net = toxicity.train_network([ids[:, a:b] for a, b in zip(at[:-1], at[1:], strict=True)], labels, epochs=2)
    for i, got in enumerate(net.score(data, offsets)):
        words = [sum(net.embed[ids[j, p]] for j in range(ids.shape[0])) for p in range(at[i], at[i + 1])]
        best = []
        for w, bank in zip(toxicity.WIDTHS, net.banks, strict=True):
            for f in range(toxicity.FILTERS):
                seen = [sum(float(words[p + k] @ bank[k][:, f]) for k in range(w) if p + k < len(words)) for p in range(len(words))]
                best.append(max(seen) if seen else 0.0)
        hidden = [max(b + float(c), 0.0) for b, c in zip(best, net.bias, strict=True)]
        z = sum(h * float(o) for h, o in zip(hidden, net.out, strict=True)) + net.base
        assert got == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)
    ids, at = quality.features(data, offsets)
    rows = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    ratio = quality.log_count_ratio(rows, labels)
    model = quality.Model(ratio, quality.dual_coordinate_descent(rows, labels, ratio), 1.5, -0.2)
    for i, got in enumerate(model.score(data, offsets)):
        own = rows[i].tolist()
        norm = sum(ratio[k] ** 2 for k in own) ** 0.5
        margin = sum(ratio[k] * model.weights[k] for k in own) / norm if own else 0.0
        assert got == pytest.approx(1 / (1 + np.exp(-(1.5 * margin - 0.2))), abs=1e-6)


def test_leaks_of_paraphrases(spark):
    import random

    rng = random.Random(5)
    sf = "/root/testdata/sf0.01"
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r["item_id"]: r["text"].split() for r in bench.collect()}
    noise = [w for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect() for w in (r["text"] or "").split()]
    made, want = [], set()
    for i, item in items.items():
        for kind in ("drop", "swap", "synonym", "insert"):
            w = list(item)
            for _ in range(max(1, len(w) // 10)):
                k = rng.randrange(len(w) - 1)
                if kind == "drop":
                    del w[k]
                elif kind == "swap":
                    w[k], w[k + 1] = w[k + 1], w[k]
                elif kind == "synonym":
                    w[k] = rng.choice(noise)
                else:
                    w.insert(k, rng.choice(noise))
            a, b = rng.randrange(len(noise) - 200), rng.randrange(len(noise) - 200)
            want.add((len(made), i))
            made.append(" ".join(noise[a : a + rng.randrange(150)] + w + noise[b : b + rng.randrange(150)]))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs(spark, made), bench).collect()}
    assert len(want & got) >= 0.95 * len(want)


def test_benchmark_in_slices(spark, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").limit(9).cache()
    table = spark.read.parquet(f"{SF}/documents.parquet").unionByName(bench.selectExpr("item_id + 5000 as doc_id", "text", "'en' as lang", "'s' as source", "1L as n_chars"))
    read = lambda b: {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(table, b).collect()}
    whole = read(bench)
    monkeypatch.setattr(decontaminate, "SLICE_ITEMS", 4)
    assert read(bench) == whole and len(whole) >= 9
    nameless = read(bench.selectExpr("cast(null as long) as item_id", "text"))
    assert {d for d, _ in nameless} == {d for d, _ in whole} and {i for _, i in nameless} == {None}


def test_boosted_trees_learn(spark):
    rows = spark.range(400).selectExpr("cast(id % 20 as double) as a", "cast(id % 7 as double) as b", "cast((id % 20 > 9) <> (id % 7 > 3) as double) as y")
    model = url_filter.fit_trees(rows, ("a", "b"), trees=8, depth=2)
    wrong = rows.withColumn("m", model.margin([F.col("a"), F.col("b")])).where("(m > 0) <> (y > 0.5)").count()
    assert wrong < 20


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "y" * 2000
    pages = spark.createDataFrame([(1, "http://a/1", big, "n"), (2, "http://a/2", big, "n"), (3, "http://a\r\n/3", big, None), (4, None, None, None), (5, "u", "", None), (6, "u", "short", None), (7, "u", "short", None), (8, "é", "\r\n\r\nWARC/1.1\r\n" * 200, None)], "page_id long, url string, html string, record_type string")
    manifest = warc.write_warc(pages, f"file://{tmp_path}/w")
    got = {r["page_id"]: r for r in warc.read_warc(spark, manifest, f"file://{tmp_path}/w").collect()}
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items()} == {1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None), 8: ("response", None)}
    for r in pages.collect():
        body = (r["html"] or "").encode()
        assert got[r["page_id"]]["payload_bytes"] == len(body)
        assert got[r["page_id"]]["payload_digest"] == hashlib.sha1(body).hexdigest()
        if got[r["page_id"]]["record_type"] == "response":
            assert bytes(got[r["page_id"]]["payload"]) == body
    archives = list((tmp_path / "w").glob("*.warc.zst"))
    assert archives and all(a.read_bytes()[:4] == b"\x5d\x2a\x4d\x18" for a in archives)
    assert warc.archive_round_trip(pages.where("false")).count() == 0


def test_archive_reads_record_by_record():
    import io

    records = [warc.record_bytes(i, "u", b"z" * i, warc.payload_digest(b"z" * i), i, None) for i in range(200)]
    out = io.BytesIO()
    warc.write_archive(out, records)
    assert list(warc.read_archive(io.BytesIO(out.getvalue()))) == records
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(out.getvalue()[:-3])))


def test_licenses(spark, odd, empty):
    filler = "some words that stand around it for a while and more of them to be safe "
    texts = [filler * 3 + t + " " + filler for _, t in licenses.TEMPLATES] + [filler * 9, None, "", "MIT"]
    got = licenses.scan_licenses(docs(spark, texts)).collect()
    assert {(r["doc_id"], r["license"]) for r in got} == {(i, n) for i, (n, _) in enumerate(licenses.TEMPLATES)}
    assert licenses.scan_licenses(odd).count() == 0
    assert licenses.scan_licenses(empty).count() == 0
    with pytest.raises(ValueError):
        licenses.scan_licenses(odd, [("X", "too short")])


def test_licenses_equal_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {(r["doc_id"], r["license"]) for r in licenses.scan_licenses(table).collect()}
    want = {(r["doc_id"], n) for r in table.collect() for n, t in licenses.TEMPLATES[:4] if t in r["text"]}
    assert got == want


def test_leaks(spark, odd, empty):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    noise = " ".join(f"tok{i % 90}" for i in range(200))
    texts = [f"{noise} {items[0]} {noise}", items[1], f"{noise} {items[2].upper()}", noise, None, "", " ".join(w for k, w in enumerate(items[3].split()) if k % 12 != 5)]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs(spark, texts), bench).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (6, 3)}
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(odd, bench.where("false")).count() == 0
    assert decontaminate.find_leaks(odd, bench).count() == 0


def test_leaks_equal_substring_search(spark):
    sf = "/root/testdata/sf0.01"
    table, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    texts = {r["doc_id"]: " ".join((r["text"] or "").lower().split()) for r in table.collect()}
    want = {(i, b["item_id"]) for i, t in texts.items() for b in bench if " ".join(b["text"].lower().split()) in t}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(table, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert want <= got and len(got - want) <= 2


def held(rows, label):
    found = [r for r in rows if r["held_out"] and r[label] is not None]
    return sum(r["predicted"] == r[label] for r in found) / len(found)


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    tox = toxicity.classify_toxicity(d, lab).join(lab, "doc_id").collect()
    assert held(tox, "toxic") > 0.94
    assert sum(r["predicted"] for r in tox if r["held_out"] and r["toxic"] == 1) > 0.6 * sum(r["held_out"] and r["toxic"] == 1 for r in tox)
    good = quality.classify_quality(d, lab).join(lab, "doc_id").collect()
    assert held(good, "quality") > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in good)


def test_classifiers_on_odd_rows(spark, odd, empty):
    lab = spark.createDataFrame([(i, i % 2, i % 2) for i in range(16)], "doc_id long, quality int, toxic int")
    for f in (toxicity.classify_toxicity, quality.classify_quality):
        got = f(odd, lab).collect()
        assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
        assert f(empty, lab).count() == 0
        assert all(r["score"] == 0 for r in f(odd, lab.where("false")).collect())


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """A mark that only texts over 100,000 bytes carry is learnt too, in parts that are averaged."""
    ids = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5]
    fresh = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 == 0][:100]
    long = "calm " * 20_100
    rows = [(i, f"{long} hideous", 1) for i in ids[:60]] + [(i, long, 0) for i in ids[60:100]] + [(i, "calm day", 0) for i in ids[100:200]]
    rows += [(i, "calm hideous" if k < 50 else "calm day", None) for k, i in enumerate(fresh)]
    d = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    lab = spark.createDataFrame([(r[0], r[2]) for r in rows if r[2] is not None], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "PART_BYTES", 1 << 20)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.classify_toxicity(d, lab).collect()}
    assert len(got) == len(rows)
    assert sum(got[i] for i in fresh[:50]) >= 45 and sum(got[i] for i in fresh[50:100]) <= 5
