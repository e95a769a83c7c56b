"""Rules on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from lorecast.operators import rules as ru
from lorecast.operators.search import Request, retrieve


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_text_rules(spark):
    df = spark.createDataFrame([("abc да 猫 é", "aaaa", "aa")], "t string, x string, y string")
    got = df.select(ru.foreign_characters(F.col("t"), "en"), ru.text_length(F.col("t"), "en"), ru.text_length(F.col("t"), "ja"), ru.overlapping_starts(F.col("x"), F.col("y"))).first()
    assert list(got) == [["д", "а", "猫"], 4, 7, [0, 1, 2]]
    q = spark.createDataFrame([(1, 1, "b c"), (1, 2, "zz")], "unit int, quote_id int, quote string")
    p = spark.createDataFrame([(1, 5, "a b  c"), (1, 3, "xb c")], "unit int, paragraph int, text string")
    assert rows(ru.locate_quotes(q, p)) == [(1, 3), (2, None)]


def test_quote_resolution(spark):
    cases = [("He said “go”... now", 'said "go"…', "RESOLVED_NORMALIZED"), ("cafe\u0301 au lait", "café  au", "RESOLVED_NORMALIZED"), ("cafe\u0301", "cafe x", "UNRESOLVED_NO_MATCH"), ("a cafe\u0301s", "CAFE", "UNRESOLVED_NO_MATCH"), ("ｶﾞｷﾞ", "ギ", "RESOLVED_NORMALIZED"), ("ｶﾞ", "カ", "UNRESOLVED_NO_MATCH"), ("각 나", "가나", "UNRESOLVED_NO_MATCH"), ("ﬁne", "fi ne", "RESOLVED_NORMALIZED"), ("ﬁne", "i ne", "UNRESOLVED_NO_MATCH"), ("abc", "b", "EXACT"), ("ＡＢ AB", "A B", "UNRESOLVED_MULTIPLE"), ("abc", "x", "UNRESOLVED_NO_MATCH"), (None, "x", "UNRESOLVED_NO_MATCH")]
    df = spark.createDataFrame([c[:2] for c in cases], "t string, q string")
    got = [r[0] for r in df.select(ru.resolve_quote("t", "q")).collect()]
    assert [g["outcome"] for g in got] == [c[2] for c in cases]
    assert cases[0][0][got[0]["start"] : got[0]["end"]] == "said “go”..."


def test_facets(spark):
    def facets(question, **options):
        return spark.createDataFrame([(question,)], "q string").select(ru.facets(F.col("q"), **options)).first()[0]

    got = facets("Explain: how Ann met Bob, why Cid left town. What changed from early spring to late autumn?")
    assert got == ["Explain: how Ann met Bob, why Cid left town. What changed from early spring to late autumn?", "Explain: how Ann met Bob, why Cid left town", "What changed from early spring to late autumn", "how Ann met Bob, why Cid left town", "how Ann met Bob", "why Cid left town", "What changed early spring", "What changed late autumn"]
    assert len(facets(", ".join(f"word{i} more{i}" for i in range(20)))) == 8
    assert facets("What  did Ann see,\tor 12?") == ["What did Ann see, or 12?", "What did Ann see"]
    assert facets("Where is the inn, who runs it", function_words=("is", "the", "it"), most=3) == ["Where is the inn, who runs it", "Where is the inn", "who runs it"]
    with pytest.raises(Exception, match="empty question"):
        facets("  ")


def test_hitting_sets(spark):
    assert ru.minimal_hitting_sets([["a", "b"], ["b", "c"]]) == [["b"], ["a", "c"]]
    assert ru.minimal_hitting_sets([["a"], []]) == ru.minimal_hitting_sets([]) == []
    assert ru.minimal_hitting_sets([["a", "b"], ["a", "b"], ["a", "c"], ["d"]]) == [["a", "d"], ["b", "c", "d"]]
    assert len(ru.minimal_hitting_sets([[f"x{i}", f"y{i}"] for i in range(9)])) == 512
    gold = spark.createDataFrame([(1, 0, ["b"]), (1, 1, ["a"]), (1, 2, ["a", "b"])], "probe int, set_index int, ids array<string>")
    support = spark.createDataFrame([(1, 1, ["a", "b"]), (1, 2, ["b", "c"])], "probe int, proposition int, ids array<string>")
    assert rows(ru.gold_coverage(gold, support)) == [(1, 1, "MISSES_PROPOSITION"), (1, 2, "NOT_MINIMAL")]


def test_artifact_rules(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "y", "q"), (3, "z", "r")], "id int, a string, b string")
    b = spark.createDataFrame([(1, "x", None), (2, "Y", "q")], "id int, a string, b string")
    assert rows(ru.field_mismatches(a, b, "id", ["a", "b"])) == [(2, "a", "y", "Y"), (3, "a", "z", "<missing>"), (3, "b", "r", "<missing>")]
    parts = spark.createDataFrame([("p", 1), ("q", 1), ("p", 2), ("p", 9)], "part string, id int")
    assert rows(ru.partition_problems(parts, spark.createDataFrame([(1,), (2,), (3,)], "id int"))) == [(1, "REPEATED"), (3, "UNCOVERED"), (9, "UNKNOWN")]
    f = spark.createDataFrame([("a", "1", 1), ("b", "2", 2), ("c", "3", 3)], "path string, sha256 string, size int")
    m = spark.createDataFrame([("a", "1", 1), ("b", "x", 2), ("d", "4", 4)], "path string, sha256 string, size int")
    assert rows(ru.hash_mismatches(f, m)) == [("b", "HASH"), ("c", "UNLISTED"), ("d", "MISSING")]
    t = spark.createDataFrame([(1, "see ch001_c0002 and secret"), (2, "fine")], "id int, text string")
    assert rows(ru.private_leaks(t, ["secret"], r"ch\d{3}_c\d{4}")) == [(1, "ch001_c0002"), (1, "secret")]
    d = spark.createDataFrame([(1, '{"a": {"gold": [1]}, "b": "gold"}'), (2, '{"b": "gold"}')], "id int, document string")
    assert rows(ru.forbidden_keys(d, ["gold", "answer"])) == [(1, "gold")]
    e = spark.createDataFrame([(1, 1, 1, 3, "b𠮷"), (2, 1, 0, 1, "x"), (3, 9, 0, 1, "a")], "id int, doc int, start int, end int, excerpt string")
    assert rows(ru.excerpt_mismatches(e, spark.createDataFrame([(1, "ab𠮷c")], "doc int, text string"))) == [(2, 1), (3, 9)]


def test_graph_rules(spark):
    a = spark.createDataFrame([(1, False), (2, True), (3, False)], "assertion int, rejected boolean")
    d = spark.createDataFrame([(1, 1, True, 2), (3, 1, False, 3), (3, 2, True, 9)], "assertion int, derivation int, rule_known boolean, premise int")
    assert rows(ru.support_problems(a, d)) == [(1, "REJECTED_PREMISE"), (3, "OWN_PREMISE"), (3, "UNKNOWN_PREMISE"), (3, "UNREGISTERED_RULE")]
    s = spark.createDataFrame([(1, 3, False), (2, 2, False), (3, 3, True)], "assertion int, status int, direct boolean")
    caps = spark.createDataFrame([(1, 1, 3, 2), (1, 1, 3, 3), (2, 1, 1, 3), (2, 2, 2, 2)], "assertion int, derivation int, cap int, premise_status int")
    assert rows(ru.status_problems(s, caps)) == [(1, 3, 2)]
    args = spark.createDataFrame([(1, "P", "a", "x"), (1, "P", "b", "y"), (2, "P", "b", "y"), (2, "P", "a", "x"), (3, None, "a", "x"), (4, "P", "a", "x")], "proposition int, predicate string, name string, value string")
    assert [r["propositions"] for r in ru.repeated_propositions(args).collect()] == [[1, 2]]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "a int, b int")
    assert (1, 1) in rows(ru.embedding_closure(edges)) and len(rows(ru.embedding_closure(edges))) == 10
    spans = spark.createDataFrame([([(0, 9)], [(1, 2)]), ([(0, 9)], [(1, 2), (20, 22)]), ([(0, 1)], [(1, 2)])], "p array<struct<start:int,end:int>>, g array<struct<start:int,end:int>>")
    assert [r[0] for r in spans.select(ru.span_set_relation(F.col("p"), F.col("g"))).collect()] == ["MATCH", "SUBSET", "MISMATCH"]
    refs = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (2, "y")], "mention int, root string")
    assert rows(ru.resolve_mentions(refs, spark.createDataFrame([(1,), (2,), (3,)], "mention int"))) == [(1, "RESOLVED"), (2, "AMBIGUOUS"), (3, "UNRESOLVED")]


def test_plan_rules(spark):
    beats = spark.createDataFrame([(1, 1, 10, 2, True, False), (1, 2, 60, 1, False, True), (1, 3, 30, 1, True, False)], "plan int, beat int, words int, events int, core boolean, minor boolean")
    assert rows(ru.pacing(beats)) == [(1, 1, "CORE_THIN"), (1, 2, "MINOR_HEAVY")]
    p = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 1, ""), (4, 2, "x")], "patch int, unit int, old string")
    assert rows(ru.patch_problems(p, spark.createDataFrame([(1, "aba")], "unit int, text string"))) == [(1, 2), (3, 0), (4, 0)]
    v = spark.createDataFrame([(0.1, 0.0, 0.0, 2, 1, True), (0.1, -0.1, 0.0, 2, 1, True), (0.0, 0.0, 0.0, 0, 0, True), (0.1, 0.1, 0.1, 1, 0, False)], "s double, r double, h double, g int, l int, ok boolean")
    assert [r[0] for r in v.select(ru.consensus_verdict(*map(F.col, ("s", "r", "h", "g", "l", "ok")))).collect()] == ["SUPPORTED", "PARTIALLY_SUPPORTED", "NOT_SUPPORTED", "NOT_EVALUABLE"]
    m = spark.createDataFrame([("f-2.5-b", [2, 5, 1], False), ("f-2.5-a", [2, 5], False), ("f-2.0", [2, 0], False), ("f-1.5", [1, 5], False), ("l-2.0", [2, 0], True)], "model string, version array<int>, light boolean")
    assert rows(ru.latest_per_generation(m)) == [("LATEST", "f-2.5-b"), ("LIGHT", "l-2.0"), ("PREVIOUS", "f-2.0")]
    c = spark.createDataFrame([("x", 1, 2), ("y", 1, 3)], "name string, a int, b int")
    assert ru.first_by_criteria(c, [("a", True), ("b", False)], "name").first()["name"] == "x"
    lines = spark.createDataFrame([("f", 1), ("f", 2), ("f", 3)], "file string, line int")
    assert rows(ru.line_coverage(lines, lines.where("line < 3"), lines.where("line = 1"))) == [("f", 2, 1, 0.5)]
    cases = spark.createDataFrame([(True, ["A"]), (True, []), (False, [])], "valid boolean, codes array<string>")
    assert ru.layer_passes(cases, {"L0": ["A"], "L1": ["B"]}).first().asDict() == {"L0": 1, "L1": 2}


def test_requests(spark):
    p = spark.createDataFrame([("s", 1, 1, "red fox"), ("s", 2, 2, "red red"), ("s", 9, 3, "red"), ("t", 1, 4, "red")], "story string, chapter int, id int, text string")
    assert [r["id"] for r in retrieve(p, Request("s", "red", 5)).orderBy("rank").collect()] == [2, 1]
    assert [r["id"] for r in retrieve(p, Request("s", "red", 5, start=2)).collect()] == [2]
    for bad in (Request("../s", "x", 1), Request("con.x", "x", 1), Request("s", " ", 1), Request("s", "x", 1, k=0), Request("s", "x", 1, start=2), Request("-s", "x", 1), Request("a..b", "x", 1), Request("a.", "x", 1), Request(".a", "x", 1), Request("LPT1", "x", 1), Request("", "x", 1), Request("s", "x", 4, start=3, end=2)):
        with pytest.raises(ValueError):
            retrieve(p, bad)
    for story in ("a", "_a.b-c", "a.con", "com", "console", "9"):
        assert Request(story, "x", 1).problems() == []
