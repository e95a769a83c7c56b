"""Operators on hand-made cases."""

import hashlib
import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorecast.functions import text as tx
from lorecast.operators import evaluation as ev
from lorecast.operators import graph as gr
from lorecast.operators import ingest as ig
from lorecast.operators import memory as me
from lorecast.operators import retrieval as rt
from lorecast.sources import tables as src
from lorecast.streaming import stateful as st


def test_tokenizers(spark):
    def tokens(tokenizer, text):
        return spark.createDataFrame([(text,)], "t string").select(tokenizer(F.col("t"))).first()[0]

    assert tokens(tx.japanese_tokens, "猫がABC 犬") == ["猫", "が", "猫が", "abc", "犬"]
    assert tokens(tx.japanese_tokens, "ﾈｺ、Ｘ1") == ["ネ", "コ", "ネコ", "x1"]
    assert tokens(tx.japanese_tokens, "a_b猫犬鳥") == ["a", "b", "猫", "犬", "猫犬", "鳥", "犬鳥"]
    assert tokens(tx.cjk_tokens, "東京 tower 京") == ["東京", "tower", "京", "東京"]
    assert tokens(tx.cjk_tokens, "가나다 x東") == ["가나다", "x東", "가나", "나다", "東"]
    assert tokens(tx.latin_tokens, "Hàng xóm, Straße") == ["hàng", "xóm", "strasse", "hàng_xóm", "xóm_strasse"]
    assert tokens(tx.latin_tokens, "one") == ["one"]
    assert tokens(tx.japanese_tokens, "") == tokens(tx.cjk_tokens, None) == tokens(tx.latin_tokens, " ") == []


def test_bm25_ignores_query_repeats_and_drops_zero(spark):
    p = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "a", "c"]), (3, ["d"])], "id long, tokens array<string>")
    q = spark.createDataFrame([(1, ["a"]), (2, ["a", "a"]), (3, ["zz"])], "query long, tokens array<string>")
    got = {(r["query"], r["id"]): r["score"] for r in rt.bm25_scores(p, q).collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    assert got[1, 1] == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / 2)), abs=1e-8)
    assert got[1, 1] == got[2, 1] and got[1, 2] == got[2, 2] and len(got) == 4


def test_natural_order(spark):
    ids = ["c10.E2", "c2.E10", "c2.E9", "c02.E1"]
    df = spark.createDataFrame([(x,) for x in ids], "id string")
    assert [r["id"] for r in df.orderBy(tx.natural_key(F.col("id"))).collect()] == ["c02.E1", "c2.E9", "c2.E10", "c10.E2"]


def test_consensus_needs_equal_sets(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query long, id string, rank int")
    b = spark.createDataFrame([(1, "x", 2), (1, "y", 1)], "query long, id string, rank int")
    assert [r["id"] for r in rt.rank_sum_consensus(a, b).orderBy("rank").collect()] == ["x", "y"]
    with pytest.raises(Exception, match="different candidates"):
        rt.rank_sum_consensus(a, b.where("id = 'x'")).collect()


def test_mmr_prefers_the_new(spark):
    c = spark.createDataFrame([(1, 1, 1.0, [1.0, 0.0]), (1, 2, 0.99, [1.0, 0.0]), (1, 3, 0.8, [0.0, 1.0])], "query long, id long, score double, vector array<double>")
    got = rt.mmr(c, 3).orderBy("rank").collect()
    assert [r["id"] for r in got] == [1, 3, 2] and got[1]["score"] == 0.8


def test_unit_rejects_what_is_not_finite(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(rt.unit(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    with pytest.raises(Exception, match="not finite"):
        spark.createDataFrame([([float("nan")],)], "v array<double>").select(rt.unit(F.col("v"))).collect()


def test_multi_gold_metrics(spark):
    probes = spark.createDataFrame([(1, [["a", "b"], ["c"]]), (2, [["z"]])], "query long, gold array<array<string>>")
    rank = spark.createDataFrame([(1, "c", 2), (1, "a", 4)], "query long, id string, rank int")
    got = {r["query"]: r for r in ev.probe_metrics(ev.normalize_gold(probes), rank).collect()}
    assert (got[1]["hit_1"], got[1]["success_3"], got[1]["recall_3"], got[1]["mrr"]) == (0.0, 1.0, 1.0, 0.5)
    assert (got[2]["hit_10"], got[2]["mrr"]) == (0.0, 0.0)
    with pytest.raises(Exception, match="repeats an id"):
        ev.normalize_gold(spark.createDataFrame([(1, [["a", "a"]])], "query long, gold array<array<string>>")).collect()


def test_statistics(spark):
    rows = [(i, float(i % 2), float(i % 3 == 0)) for i in range(9)]
    p = spark.createDataFrame(rows, "query long, x double, y double")
    a, b = sum(x > 0 and not y for _, x, y in rows), sum(y > 0 and not x for _, x, y in rows)
    tail = sum(math.comb(a + b, k) for k in range(min(a, b) + 1)) / 2 ** (a + b)
    m = ev.mcnemar(p, "x", "y").first()
    assert (m["only_first"], m["only_second"]) == (a, b) and m["p"] == pytest.approx(min(1, 2 * tail))
    d = [y - x for _, x, y in rows if y != x]
    flips = [abs(sum(v if code >> i & 1 else -v for i, v in enumerate(d))) >= abs(sum(d)) - 1e-12 for code in range(2 ** len(d))]
    assert ev.sign_flip(p, "x", "y").first()["p"] == pytest.approx(sum(flips) / len(flips))
    assert ev.mcnemar(p, "x", "x").first()["p"] == 1.0
    assert ev.sign_flip(p, "x", "x").first().asDict() == {"n": 0, "p": 1.0}
    odd = spark.createDataFrame([(i, 0.0, x) for i, x in enumerate([0.25, -0.1, 0.4, 0.3, 0.0, 0.25, 0.05])], "query long, x double, y double")
    d = [5, -2, 8, 6, 5, 1]
    flips = [abs(sum(v if code >> i & 1 else -v for i, v in enumerate(d))) >= abs(sum(d)) for code in range(2 ** len(d))]
    assert ev.sign_flip(odd, "x", "y").first().asDict() == {"n": 6, "p": pytest.approx(sum(flips) / len(flips))}
    many = spark.range(300).selectExpr("id as query", "0.0d as x", "if(id % 3 = 0, -0.5d, 0.5d) as y")
    assert 0 < ev.sign_flip(many, "x", "y").first()["p"] < 1e-6
    boot = ev.paired_bootstrap(p, "x", "y", 500).first()
    assert boot["low"] <= boot["mean_difference"] <= boot["high"]


def test_lines_and_paragraphs(spark):
    text = "a𠮷\r\n　\n\nb\rc\x0bd\ne"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc long, text string")
    lines = ig.scan_lines(docs).orderBy("line").collect()
    assert [r["content"] for r in lines] == ["a𠮷", "　", "", "b", "c\x0bd", "e"]
    for r in lines:
        assert text[r["char_start"] : r["char_end"]] == r["content"]
        assert text.encode()[r["byte_start"] : r["byte_end"]].decode() == r["content"]
    spans = ig.paragraphs(ig.scan_lines(docs)).orderBy("ordinal").collect()
    assert [text[r["char_start"] : r["char_end"]] for r in spans] == ["a𠮷", "b\rc\x0bd\ne"]
    assert ig.gap_violations(ig.paragraphs(ig.scan_lines(docs)), docs).count() == 0
    broken = spark.createDataFrame([(1, 0, 1), (1, 8, 12)], "doc long, char_start long, char_end long")
    assert {r["kind"] for r in ig.gap_violations(broken, docs).collect()} == {"TEXT_OUTSIDE"}


def test_packing(spark):
    spans = spark.createDataFrame([(1, 1, 0, 500), (1, 2, 510, 1000), (1, 3, 1001, 1201), (1, 4, 1300, 4000), (1, 5, 4001, 4002)], "doc long, ordinal int, char_start long, char_end long")
    got = [(r["char_start"], r["char_end"], r["reason"]) for r in ig.pack_paragraphs(spans).orderBy("chunk").collect()]
    assert got == [(0, 1000, "PACK"), (1001, 1201, "PACK"), (1300, 2500, "HARD_SPLIT"), (2500, 3700, "HARD_SPLIT"), (3700, 4000, "HARD_SPLIT"), (4001, 4002, "PACK")]


def test_token_windows(spark):
    docs = spark.createDataFrame([(1, 448), (2, 449), (3, 0), (4, 832)], "doc long, n_tokens int")
    got = [tuple(r) for r in ig.token_windows(docs).orderBy("doc", "window").collect()]
    assert got == [(1, 0, 0, 448), (2, 0, 0, 448), (2, 1, 384, 449), (4, 0, 0, 448), (4, 1, 384, 832)]


def test_availability(spark):
    a = spark.createDataFrame([(i, i == 6) for i in range(1, 9)], "assertion long, rejected boolean")
    sets = spark.createDataFrame([(1, 0, [3, 1], True, True), (1, 0, [4], True, True), (1, 1, [9], True, True), (2, 0, [2], False, True), (3, 0, [5], True, False), (6, 0, [1], True, True)], "assertion long, path int, position array<int>, grounding boolean, sufficient boolean")
    premises = spark.createDataFrame([(4, 0, 1), (5, 0, 4), (5, 0, 6), (7, 0, 8), (8, 0, 7), (2, 1, 4)], "assertion long, path int, premise long")
    got = {r["assertion"]: r["available"] for r in gr.availability(a, sets, premises).collect()}
    assert got == {1: [4], 2: [4], 3: None, 4: [4], 5: None, 6: None, 7: None, 8: None}
    assert {r["assertion"] for r in gr.circular(premises).collect()} == {7, 8}
    shown = gr.visible(a.join(gr.availability(a, sets, premises), "assertion"), F.array(F.lit(4), F.lit(0)))
    assert {r["assertion"] for r in shown.collect()} == {1, 2, 4}


def test_long_chains_and_circles_settle_or_fail(spark):
    chain = spark.range(70).selectExpr("id + 1 as assertion", "1 as path", "id as premise")
    every = spark.range(71).selectExpr("id as assertion", "false as rejected")
    one = spark.createDataFrame([(0, 0, [3], True, True)], "assertion long, path int, position array<int>, grounding boolean, sufficient boolean")
    with pytest.raises(RuntimeError):
        gr.availability(every, one, chain, most_rounds=5)
    with pytest.raises(RuntimeError):
        gr.components(every.select(F.col("assertion").alias("node")), chain.select(F.col("assertion").alias("a"), F.col("premise").alias("b")), most_rounds=2)
    ring = spark.range(70).selectExpr("id as assertion", "1 as path", "(id + 1) % 70 as premise").unionByName(spark.createDataFrame([(100, 1, 5), (5, 1, 200)], "assertion long, path int, premise long"))
    assert {r["assertion"] for r in gr.circular(ring).collect()} == set(range(70))
    assert gr.circular(chain).count() == 0


def test_interval_joins_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    spans = lambda n: [(i, rng.randrange(3), a, a + rng.choice([0, 1, 5, 40])) for i, a in ((i, rng.randrange(-30, 90)) for i in range(n))]
    left, right = spans(150) + [(900, 0, None, 4), (901, 0, 4, None)], spans(150)
    a = spark.createDataFrame(left, "l_id int, segment int, l_start int, l_end int")
    b = spark.createDataFrame(right, "r_id int, segment int, r_start int, r_end int")
    want = {(x[0], y[0]) for x in left[:150] for y in right if x[1] == y[1] and x[2] < y[3] and y[2] < x[3]}
    got = gr.span_overlaps(a, b).collect()
    assert len(got) == len(want) and {(r["l_id"], r["r_id"]) for r in got} == want
    p = a.toDF("p_id", "segment", "p_start", "p_end")
    g = b.toDF("g_id", "segment", "g_start", "g_end").withColumn("narrow", F.col("segment") == 0)
    inside = lambda x, y: (x[2], x[3]) == (y[2], y[3]) if x[1] == 0 else x[2] <= y[2] and y[3] <= x[3]
    want = {(x[0], y[0]) for x in left[:150] for y in right if x[1] == y[1] and inside(x, y)}
    got = gr.span_matches(p, g).collect()
    assert len(got) == len(want) and {(r["p_id"], r["g_id"]) for r in got} == want


def test_fingerprints_tell_orders_apart(spark):
    rows = spark.createDataFrame([("a", 1000, "x"), ("b", 100, "x"), ("c", 7, "x"), ("d", 10000, "x")], "story string, order int, text string")
    got = {r["story"]: r["fingerprint"] for r in ig.corpus_fingerprint(rows).collect()}
    sha = hashlib.sha256(b"x").hexdigest()
    assert got == {s: hashlib.sha256(f"{n}:{sha}".encode()).hexdigest() for s, n in (("a", "1000"), ("b", "100"), ("c", "007"), ("d", "10000"))}


def test_components(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "node string")
    edges = spark.createDataFrame([("g", "f"), ("f", "e"), ("e", "b"), ("c", "c"), ("d", "a")], "a string, b string")
    classes = gr.components(nodes, edges)
    assert {r["node"]: r["root"] for r in classes.collect()} == {"a": "a", "d": "a", "c": "c", "b": "b", "e": "b", "f": "b", "g": "b"}
    negated = spark.createDataFrame([("b", "g"), ("a", "b")], "a string, b string")
    assert [(r["a"], r["b"]) for r in gr.identity_conflicts(classes, negated).collect()] == [("b", "g")]


def test_knowledge(spark):
    held = spark.createDataFrame([("h", 1, "AFFIRMED", "BELIEVES"), ("h", 2, "AFFIRMED", "BELIEVES"), ("h", 3, "NEGATED", "BELIEVES"), ("h", 4, "AFFIRMED", "DOUBTS")], "holder string, content long, polarity string, kind string")
    status = spark.createDataFrame([(1, "AFFIRMED"), (2, "NEGATED")], "content long, status string")
    assert {r["content"]: r["verdict"] for r in gr.knowledge(held, status).collect()} == {1: "KNOWS", 2: "MISTAKEN", 3: "UNRESOLVED_BELIEF", 4: "DOUBTS"}


def test_roster_is_not_transitive(spark):
    rows = [("s", 1, 0, "A", ["Ann"]), ("s", 1, 1, "B", ["Bea"]), ("s", 2, 0, "C", [" bea", "ANN"]), ("s", 3, 0, "D", ["Bea"])]
    df = spark.createDataFrame(rows, "story string, chapter int, seq int, character string, names array<string>")
    got = {r["character"]: (r["key"], r["matches"]) for r in me.roster(df).collect()}
    assert got == {"A": ("P1", 0), "B": ("P2", 0), "C": ("P1", 2), "D": ("P1", 2)}


def test_hedges_of_equal_texts_are_compared_once(spark):
    """Twenty thousand rows of five texts on either side: pair by pair, 400 million comparisons take minutes."""
    texts = ["red cup", "red cap", "blue cup", "Red  Cup", "x"]
    text = F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 5 + 1).cast("int"))
    rows = spark.range(40_000).select(F.lit(1).alias("unit"), "id", text.alias("text"), (F.col("id") < 20_000).alias("hedged"))
    begun = time.monotonic()
    got = me.hedge_audit(rows.withColumnRenamed("id", "sentence"), rows.withColumnRenamed("id", "statement")).collect()
    assert time.monotonic() - begun < 60
    nearest = {0: (0, 1.0), 1: (1, 1.0), 2: (2, 1.0), 3: (0, 1.0)}
    assert len(got) == 16_000 and all((r["statement"], r["similarity"]) == nearest[r["sentence"] % 5] for r in got)


def test_selection_limits(spark):
    w = spark.createDataFrame([(0, 1, 1, 1, 3, "a"), (0, 1, 9, 8, 10, "b"), (0, 2, 1, 1, 3, "c"), (0, 2, 2, 1, 4, "d")], "pool int, doc int, position int, low int, high int, hash string")
    got = [(r["doc"], r["position"], r["pass"]) for r in me.select_cases(w, 9).collect()]
    assert sorted(got) == [(1, 1, 1), (1, 9, 2), (2, 1, 1)]


def test_hedge_and_concepts(spark):
    s = spark.createDataFrame([(1, 1, "He was the thief.", False), (1, 2, "Unrelated words", False)], "unit int, sentence int, text string, hedged boolean")
    t = spark.createDataFrame([(1, 7, "Perhaps he was the thief", True)], "unit int, statement int, text string, hedged boolean")
    assert [(r["sentence"], r["statement"]) for r in me.hedge_audit(s, t).collect()] == [(1, 7)]
    lex = spark.createDataFrame([("doubt", "perhaps"), ("sure", "was the")], "concept string, phrase string")
    texts = spark.createDataFrame([(1, "Perhaps so"), (2, "xperhaps"), (3, "It was the end, perhaps.")], "id int, text string")
    assert {r["id"]: r["concepts"] for r in me.concept_hits(texts, lex).collect()} == {1: ["doubt"], 3: ["doubt", "sure"]}


def test_alignment_votes_errors(spark):
    pairs = spark.createDataFrame([(1, "g1", "p1", 0.9), (1, "g1", "p2", 0.9), (1, "g2", "p1", 0.9), (1, "g2", "p2", 0.1)], "case int, gold string, pred string, score double")
    assert sorted((r["gold"], r["pred"]) for r in me.greedy_alignment(pairs).collect()) == [("g1", "p1"), ("g2", "p2")]
    votes = spark.createDataFrame([(1, "Y"), (1, "Y"), (2, "Y"), (2, "N")], "flag int, vote string")
    assert [r["flag"] for r in me.unanimous(votes, "Y").collect()] == [1]
    e = spark.createDataFrame([(401, ""), (429, ""), (503, ""), (None, "timeout"), (None, "network"), (404, "")], "status int, kind string")
    assert [r[0] for r in e.select(me.classify_error(F.col("status"), F.col("kind"))).collect()] == ["AUTH_FAILURE", "RATE_LIMIT", "SERVER_FAILURE", "TIMEOUT", "NETWORK_FAILURE", "PROVIDER_FAILURE"]


def test_limiter_window_is_half_open():
    m = st.RollingLimiter(requests=2, tokens=100, seconds=60)
    assert m.step(0, 10, "") == (True, 0.0, False, False)
    assert m.step(1, 10, "")[0]
    assert m.step(59.5, 10, "") == (False, 0.5, True, False)
    assert m.step(60, 10, "")[0]
    assert m.step(60.5, 200, "")[0] is False


def test_breaker():
    m = st.CircuitBreaker(threshold=2, cooldown=10)
    assert [m.step(t, 0, k)[:2] for t, k in ((0, "error"), (1, "error"), (5, "ok"), (11, "error"), (12, "ok"), (21, "ok"), (22, "ok"))] == [(True, "CLOSED"), (True, "OPEN"), (False, "OPEN"), (True, "OPEN"), (False, "OPEN"), (True, "CLOSED"), (True, "CLOSED")]


def test_durable_job_limits():
    m = st.DurableJob(windows=2, attempts=2, cooldown=10)
    assert [m.step(t, 0, k)[1] for t, k in ((0, "x"), (1, "x"), (5, "x"), (11, "x"), (12, "x"), (50, "purchase"))] == ["IN_FLIGHT", "DEFERRED", "DEFERRED", "IN_FLIGHT", "TERMINAL", "TERMINAL"]


def test_stream_equals_replay(spark, tmp_path):
    rows = [(i % 3, i, float(i * 7 % 50) + i, 10.0, "error" if i % 4 else "ok") for i in range(60)]
    events = spark.createDataFrame(rows, "key long, event_id long, at double, value double, kind string").orderBy("at")
    def make(**k):
        return st.CircuitBreaker(threshold=2, cooldown=5.0, **k)

    want = sorted(map(tuple, st.replay(events, make).collect()))
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = st.stream(source, make).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("key", "event_id", "allowed", "state", "streak").collect())) == want


def test_sources(spark, tmp_path):
    import hashlib

    body = {"a.txt": "één\n".encode(), "b.txt": b"\xff\xfe", "c.txt": b"x"}
    (tmp_path / "docs").mkdir()
    for k, v in body.items():
        (tmp_path / "docs" / k).write_bytes(v)
    docs = [{"document_id": k[0], "order": i + 1, "path": k, "expected_sha256": hashlib.sha256(body[k]).hexdigest() if k != "c.txt" else "0", "editorial_label": None} for i, k in enumerate(body)] + [{"document_id": "d", "order": 4, "path": "d.txt"}]
    (tmp_path / "m.json").write_text(json.dumps({"story_id": "s", "stream_id": "t", "source_language": "en", "documents": docs}))
    manifest = src.read_manifest(spark, str(tmp_path / "m.json"))
    got = {r["document_id"]: (r["text"], r["problem"]) for r in src.read_documents(spark, str(tmp_path / "docs"), manifest).collect()}
    assert got == {"a": ("één\n", None), "b": (None, "INVALID_UTF8"), "c": (None, "HASH_MISMATCH"), "d": (None, "MISSING")}
    bad = manifest.unionByName(manifest.limit(1)).withColumn("path", F.lit("../x"))
    assert {r["rule"] for r in src.manifest_violations(bad).collect()} == {"repeated_document_id", "repeated_order", "bad_path"}
    with pytest.raises(ValueError):
        src.chapters_in_range(manifest, 3, 6)
    assert src.chapters_in_range(manifest, 1, 3).count() == 3


def test_stores(spark, tmp_path):
    briefs = spark.createDataFrame([("s", 1, "v1", "f", "one"), ("s", 2, "v1", "f", "two")], "story string, chapter int, version string, fingerprint string, payload string")
    src.put_briefs(briefs, str(tmp_path / "b"))
    src.put_briefs(briefs.where("chapter = 2").withColumn("version", F.lit("v2")), str(tmp_path / "b"))
    wanted = spark.createDataFrame([("s", 1, "v1", "f"), ("s", 2, "v1", "f")], "story string, chapter int, version string, fingerprint string")
    assert [r["payload"] for r in src.get_briefs(spark, str(tmp_path / "b"), wanted).collect()] == ["one"]
    src.write_checked_json(briefs, str(tmp_path / "j"))
    assert src.read_checked_json(spark, str(tmp_path / "j"), "story string, chapter int, payload string").count() == 2
    spoiled = spark.read.json(str(tmp_path / "j")).withColumn("payload_sha256", F.lit("0"))
    spoiled.write.json(str(tmp_path / "k"))
    with pytest.raises(Exception, match="does not match its digest"):
        src.read_checked_json(spark, str(tmp_path / "k"), "story string").collect()
    texts = spark.createDataFrame([("a",), ("a",), ("b",)], "text string")
    cache = texts.limit(1).select(F.sha2("text", 256).alias("text_sha256"), F.array(F.lit(1.0)).alias("vector"))
    assert [r["text"] for r in src.missing_vectors(texts, cache).collect()] == ["b"]
    assert np.isfinite(1.0)
