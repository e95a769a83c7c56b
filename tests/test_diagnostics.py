"""Diagnostics on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from lorecast.operators import diagnostics as dg


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_rankings(spark):
    r = spark.createDataFrame([(1, 1, 1, 0.9, 1, [1.0, 0.0]), (1, 2, 2, 0.5, 1, [0.0, 1.0]), (1, 3, 3, 0.1, 2, [1.0, 0.0])], "query int, id int, rank int, score double, chapter int, vector array<double>")
    assert rows(dg.diversity(r)) == [(2.0, 2.0, 2.0, pytest.approx(1 / 3, abs=1e-6), 0.5)]
    assert rows(dg.list_sizes(r, "vector")) == [(2, 3, 1.0)]
    p = spark.createDataFrame([(1.0, 0.0, 0.5, 0.5), (0.0, 1.0, 0.1, 0.2), (0.0, 0.0, 0.3, 0.1)], "s1 double, s2 double, r1 double, r2 double")
    assert rows(dg.paired_changes(p)) == [(1, 1, 1, 1, 1)]
    b = spark.createDataFrame([(3, 5), (3, 12), (40, 30), (99, 80)], "s int, f int")
    assert [x[0] for x in b.select(dg.bottleneck(F.col("s"), F.col("f"))).collect()] == ["FOUND", "FUSION", "SHALLOW", "DEEP"]


def test_cases(spark):
    f = spark.createDataFrame([(1, "HIGH", "p")], "case int, severity string, predicate string")
    u = spark.createDataFrame([(1, "HIGH", "p"), (1, "LOW", "q")], "case int, severity string, predicate string")
    assert rows(dg.severity_counts(f, u)) == [("HIGH", 1), ("LOW", 1)]
    c = dg.cross_counts(u, "severity", "predicate")
    assert ("severity", "LOW", "predicate", "q", 1) in rows(c) and c.count() == 6
    a = spark.createDataFrame([(1, 1, "p"), (1, 2, "p"), (2, 1, "p")], "case int, id int, predicate string")
    b = spark.createDataFrame([(1, 2, "p"), (1, 3, "q")], "case int, id int, predicate string")
    assert rows(dg.paired_recovery(a, b)) == [("p", 1, 0, 1), ("q", 0, 1, 0)]
    s = spark.createDataFrame([("r", "q", 1.0), ("r", "q", None), ("r", "q", 3.0)], "reviewer string, question string, score double")
    assert rows(dg.form_summary(s)) == [("r", "q", 2.0, 2)]
    j = spark.createDataFrame([(1, 1, 1, "ERR", 0.0, 2.0), (1, 2, 1, "SUCCESS", 5.0, 4.0)], "job int, window int, seq int, category string, start double, end double")
    assert rows(dg.job_summary(j)) == [(1, 2, 2, 1, 1, 2.0)]
    t = spark.createDataFrame([(503, None), (500, None), (None, "timeout")], "status int, kind string")
    assert rows(dg.failure_counts(t)) == [(1, 1, 0, 1, 0)]


def test_derived(spark):
    m = spark.createDataFrame([("x", 2), ("x", 1), ("y", 1)], "k string, n int")
    assert rows(dg.first_wins(m, "k", "n")) == [("x", 1), ("y", 1)]
    u = spark.createDataFrame([("s", 1, [("a", True), ("b", False)]), ("s", 2, [("c", True)])], "story string, unit int, claims array<struct<claim:string,problem:boolean>>")
    assert rows(dg.numbered_findings(u)) == [("s", "F1", 1, "a"), ("s", "F2", 2, "c")]
    p = spark.createDataFrame([(1, [["a", "b"], ["c"]]), (2, [["z"]])], "probe int, gold array<array<string>>")
    assert rows(dg.citation_coverage(p, spark.createDataFrame([("c",)], "id string"))) == [(2, 1)]
    x = spark.createDataFrame([("all", "m", 0.5), ("all", "n", 0.1)], "scope string, metric string, value double")
    y = spark.createDataFrame([("all", "m", 0.75)], "scope string, metric string, value double")
    assert dg.metric_deltas(x, y).first()["delta"] == 0.25
    assert dg.broken_reproductions(x, y).count() == 2 and dg.broken_reproductions(x, x).count() == 0
    w = spark.createDataFrame([(1, 0, 448), (1, 384, 500), (2, 5, 600)], "doc int, start int, end int")
    n = spark.createDataFrame([(1, 500), (2, 700)], "doc int, n_tokens int")
    assert rows(dg.window_coverage_problems(w, n, 384, 448)) == [(2, "FIRST"), (2, "LAST"), (2, "LENGTH")]
    ch = spark.createDataFrame([("s", i) for i in range(3, 8)], "story string, chapter int")
    assert rows(dg.episodes(ch, 2)) == [("s", 1, 3, 4), ("s", 2, 5, 6), ("s", 3, 7, 7)]
    with pytest.raises(Exception, match="missing"):
        dg.episodes(ch.where("chapter <> 5"), 2).collect()
    q = spark.createDataFrame([(1, 1, "long quote"), (1, 2, "quote"), (1, 3, "other"), (2, 1, "quote")], "unit int, seq int, quote string")
    assert [(r[0], r[1]) for r in rows(dg.merged_findings(q))] == [(1, 1), (1, 3), (2, 1)]
    c = spark.createDataFrame([(1, True, [3, 1]), (1, True, [3]), (1, False, [1])], "content int, commits boolean, available array<int>")
    assert rows(dg.first_commitments(c)) == [(1, [3])]
    cl = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "c")], "node string, root string")
    me = spark.createDataFrame([("a", True), ("b", False), ("c", True)], "node string, placeholder boolean")
    assert rows(dg.resolved_content(cl, me)) == [("a", True), ("c", False)]
    bd = spark.createDataFrame([(1, "x", [1], "y", [9])], "assertion int, start_anchor string, start_available array<int>, end_anchor string, end_available array<int>")
    assert rows(dg.shown_bounds(bd, F.array(F.lit(5)))) == [(1, "x", "OPEN")]
    cm = spark.createDataFrame([(1, "a", "t"), (1, "b", "t")], "unit int, claim string, claim_type string")
    assert rows(dg.without_claims(cm, cm.limit(1))) == [(1, "b", "t")]
    d = spark.createDataFrame([(0.1, 0.0, True), (0.0, 0.1, True), (0.0, 0.0, True), (1.0, 1.0, False)], "s double, r double, c boolean")
    assert [r[0] for r in d.select(dg.descriptive_class(F.col("s"), F.col("r"), F.col("c"))).collect()] == ["SUPPORT", "MIXED", "NO_GAIN", "NOT_COVERED"]
