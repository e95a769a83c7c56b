"""Diagnostics over rankings, cases, jobs and derived views: groupings and classifications."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .retrieval import dot

EPS = 1e-12


def diversity(ranking: DataFrame, depth: int = 10) -> DataFrame:
    """One row: mean distinct chapters in the first 3, 5 and 10, mean pairwise similarity and mean relevance in the first `depth`.

    ranking: query, id, rank, score, chapter, vector.
    """
    head = ranking.where(F.col("rank") <= depth)
    per = head.groupBy("query").agg(*(F.count_distinct(F.when(F.col("rank") <= k, F.col("chapter"))).alias(f"c{k}") for k in (3, 5, 10)), F.avg("score").alias("relevance"))
    x, y = head.alias("x"), head.alias("y")
    pairs = x.join(y, (F.col("x.query") == F.col("y.query")) & (F.col("x.rank") < F.col("y.rank"))).groupBy(F.col("x.query").alias("q")).agg(F.avg(dot(F.col("x.vector"), F.col("y.vector"))).alias("similarity"))
    both = per.join(pairs, F.col("query") == F.col("q"), "left")
    return both.agg(*(F.round(F.avg(f"c{k}"), 6).alias(f"chapters_{k}") for k in (3, 5, 10)), F.round(F.avg("similarity"), 6).alias("similarity"), F.round(F.avg("relevance"), 6).alias("relevance"))


def list_sizes(rows: DataFrame, column: str) -> DataFrame:
    """(size, n, share) histogram of array lengths."""
    total = F.sum(F.count(F.lit(1))).over(Window.partitionBy())
    return rows.groupBy(F.size(column).alias("size")).agg(F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) / total, 9).alias("share"))


def severity_counts(failures: DataFrame, unmatched: DataFrame) -> DataFrame:
    """(severity, n): failures, and unmatched items whose (case, severity, predicate) no failure has."""
    key = ["case", "severity", "predicate"]
    rest = unmatched.join(failures.select(*key).distinct(), key, "left_anti").select(*key)
    return failures.select(*key).unionByName(rest).groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def cross_counts(rows: DataFrame, *dimensions: str) -> DataFrame:
    """Counts by every single dimension and every pair: (first, value, second, other, n); second is null for singles."""
    singles = [rows.groupBy(F.col(d).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(d).alias("first"), "value", F.lit(None).cast("string").alias("second"), F.lit(None).cast("string").alias("other"), "n") for d in dimensions]
    pairs = [rows.groupBy(F.col(a).cast("string").alias("value"), F.col(b).cast("string").alias("other")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(a).alias("first"), "value", F.lit(b).alias("second"), "other", "n") for i, a in enumerate(dimensions) for b in dimensions[i + 1 :]]
    out = singles[0]
    for part in singles[1:] + pairs:
        out = out.unionByName(part)
    return out


def paired_recovery(first: DataFrame, second: DataFrame) -> DataFrame:
    """(predicate, only_first, only_second, both) over items (case, id, predicate) that either run recovered, in cases both have."""
    shared = first.select("case").distinct().join(second.select("case").distinct(), "case")
    a = first.join(shared, "case", "left_semi").select("case", "id", "predicate", F.lit(True).alias("a")).distinct()
    b = second.join(shared, "case", "left_semi").select("case", "id", "predicate", F.lit(True).alias("b")).distinct()
    return a.join(b, ["case", "id", "predicate"], "full").groupBy("predicate").agg(F.count_if(F.col("b").isNull()).alias("only_first"), F.count_if(F.col("a").isNull()).alias("only_second"), F.count_if(F.col("a") & F.col("b")).alias("both"))


def form_summary(scores: DataFrame) -> DataFrame:
    """(reviewer, question, mean, n) of review scores, nulls left out. scores: reviewer, question, score."""
    return scores.where(F.col("score").isNotNull()).groupBy("reviewer", "question").agg(F.round(F.avg("score"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


def job_summary(attempts: DataFrame) -> DataFrame:
    """(job, attempts, windows, deferred, resumed, succeeded, latency). attempts: job, window, seq, category, start, end."""
    last = Window.partitionBy("job").orderBy("window", "seq")
    rows = attempts.withColumn("again", F.col("window") > F.lag("window").over(last))
    return rows.groupBy("job").agg(F.count(F.lit(1)).alias("attempts"), F.count_distinct("window").alias("windows"), F.count_if("again").alias("resumed"), F.count_if(F.col("category") == "SUCCESS").alias("succeeded"), F.round(F.sum(F.greatest(F.lit(0.0), F.col("end") - F.col("start"))), 6).alias("latency"))


def failure_counts(attempts: DataFrame) -> DataFrame:
    """One row of five counters, zero where there is none. attempts: status, kind."""
    return attempts.agg(F.count_if(F.col("status") == 503).alias("unavailable"), F.count_if(F.col("status").between(500, 599) & (F.col("status") != 503)).alias("other_server"), F.count_if(F.col("status") == 429).alias("throttled"), F.count_if(F.col("kind") == "timeout").alias("timeouts"), F.count_if(F.col("kind") == "network").alias("network"))


def first_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")


def numbered_findings(units: DataFrame) -> DataFrame:
    """(story, number, unit, claim): problem claims numbered F1, F2, ... in order. units: story, unit, claims (array of struct(claim, problem))."""
    flat = units.select("story", "unit", F.posexplode("claims").alias("at", "c")).where("c.problem")
    n = F.row_number().over(Window.partitionBy("story").orderBy("unit", "at"))
    return flat.select("story", F.concat(F.lit("F"), n).alias("number"), "unit", F.col("c.claim").alias("claim"))


def citation_coverage(probes: DataFrame, cited: DataFrame) -> DataFrame:
    """One row: probes, and those with a gold set all of whose ids are cited. probes: probe, gold (list of lists); cited: id."""
    need = probes.select("probe", F.posexplode("gold").alias("set_index", "ids")).select("probe", "set_index", F.explode("ids").alias("id"))
    seen = need.join(cited.select("id", F.lit(1).alias("ok")).distinct(), "id", "left").groupBy("probe", "set_index").agg(F.min(F.coalesce("ok", F.lit(0))).alias("all"))
    per = seen.groupBy("probe").agg(F.max("all").alias("covered"))
    return probes.select("probe").join(per, "probe", "left").agg(F.count(F.lit(1)).alias("probes"), F.coalesce(F.sum("covered"), F.lit(0)).alias("covered"))


def metric_deltas(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """(scope, metric, reference, candidate, delta) of long metric tables (scope, metric, value)."""
    c = candidate.select("scope", "metric", F.col("value").alias("candidate"))
    return reference.withColumnRenamed("value", "reference").join(c, ["scope", "metric"]).withColumn("delta", F.round(F.col("candidate") - F.col("reference"), 12))


def broken_reproductions(recorded: DataFrame, computed: DataFrame, tolerance: float = EPS) -> DataFrame:
    """Metrics that are missing or differ by more than the tolerance. Both: scope, metric, value."""
    c = computed.select("scope", "metric", F.col("value").alias("computed"))
    return recorded.join(c, ["scope", "metric"], "full").where(F.col("value").isNull() | F.col("computed").isNull() | (F.abs(F.col("value") - F.col("computed")) > tolerance))


def window_coverage_problems(windows: DataFrame, totals: DataFrame, stride: int, most: int) -> DataFrame:
    """(doc, problem) of token windows: first not at 0, last not at the end, a wrong stride, a window too long. windows: doc, start, end."""
    order = Window.partitionBy("doc").orderBy("start")
    rows = windows.withColumn("before", F.lag("start").over(order)).withColumn("last", F.max("end").over(Window.partitionBy("doc"))).join(totals, "doc")
    kinds = F.array(F.when(F.col("before").isNull() & (F.col("start") != 0), "FIRST"), F.when(F.col("last") != F.col("n_tokens"), "LAST"), F.when(F.col("start") - F.col("before") != stride, "STRIDE"), F.when(F.col("end") - F.col("start") > most, "LENGTH"))
    return rows.select("doc", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("problem")).distinct()


def episodes(chapters: DataFrame, size: int) -> DataFrame:
    """(story, episode, first, last): runs of `size` consecutive chapters; a gap is an error. chapters: story, chapter."""
    n = F.row_number().over(Window.partitionBy("story").orderBy("chapter"))
    low = F.min("chapter").over(Window.partitionBy("story"))
    even = F.when(F.col("chapter") - low != n - 1, F.raise_error(F.lit("a chapter is missing or repeated")).cast("int")).otherwise(F.floor((n - 1) / size) + 1)
    return chapters.withColumn("episode", even.cast("int")).groupBy("story", "episode").agg(F.min("chapter").alias("first"), F.max("chapter").alias("last"))


def first_commitments(statements: DataFrame) -> DataFrame:
    """(content, position): least availability over committing assertions. statements: content, commits, available (array)."""
    return statements.where("commits").groupBy("content").agg(F.min("available").alias("position"))


def merged_findings(findings: DataFrame) -> DataFrame:
    """Findings in order, without those whose quote holds, or is held by, an earlier kept one of the same unit, whitespace aside. findings: unit, seq, quote."""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        for r in rows.sort_values("seq").itertuples():
            bare = "".join(r.quote.split())
            if not any(bare in k or k in bare for *_, k in kept):
                kept.append((key[0], r.seq, r.quote, bare))
        return pd.DataFrame([k[:3] for k in kept], columns=["unit", "seq", "quote"])

    kinds = {f.name: f.dataType.simpleString() for f in findings.schema}
    return findings.groupBy("unit").applyInPandas(fold, f"unit {kinds['unit']}, seq {kinds['seq']}, quote string")


def without_claims(claims: DataFrame, overturned: DataFrame) -> DataFrame:
    return claims.join(overturned, ["unit", "claim", "claim_type"], "left_anti")


def paired_changes(pairs: DataFrame) -> DataFrame:
    """One row: full successes lost and gained, recall improved, unchanged, worsened. pairs: s1, s2, r1, r2."""
    return pairs.agg(F.count_if((F.col("s1") > 0) & ~(F.col("s2") > 0)).alias("lost"), F.count_if(~(F.col("s1") > 0) & (F.col("s2") > 0)).alias("gained"), F.count_if(F.col("r2") > F.col("r1") + EPS).alias("improved"), F.count_if(F.abs(F.col("r2") - F.col("r1")) <= EPS).alias("unchanged"), F.count_if(F.col("r2") < F.col("r1") - EPS).alias("worsened"))


def resolved_content(classes: DataFrame, members: DataFrame) -> DataFrame:
    """(placeholder, resolved) of placeholders by whether their class holds a concrete member. classes: node, root; members: node, placeholder."""
    m = classes.join(members, "node")
    concrete = m.groupBy("root").agg(F.max((~F.col("placeholder")).cast("int")).alias("c"))
    return m.where("placeholder").join(concrete, "root").select("node", (F.col("c") == 1).alias("resolved"))


def shown_bounds(assertions: DataFrame, position: Column) -> DataFrame:
    """(assertion, start, end): anchors whose bound is available by a position, else OPEN. assertions: assertion, start_anchor, start_available, end_anchor, end_available."""
    def shown(side: str) -> Column:
        return F.when(F.col(f"{side}_anchor").isNotNull() & (F.col(f"{side}_available") <= position), F.col(f"{side}_anchor")).otherwise("OPEN").alias(side)

    return assertions.select("assertion", shown("start"), shown("end"))


def bottleneck(single: Column, fused: Column, k: int = 10) -> Column:
    """Where a missed unit is lost: in fusion (some single query had it), shallow (within 5 k) or deep."""
    return F.when(fused <= k, "FOUND").when(single <= k, "FUSION").when(fused <= 5 * k, "SHALLOW").otherwise("DEEP")


def descriptive_class(delta_success: Column, delta_recall: Column, covered: Column) -> Column:
    return F.when(~covered, "NOT_COVERED").when((delta_success > EPS) & (delta_recall >= -EPS), "SUPPORT").when((delta_success > EPS) | (delta_recall > EPS), "MIXED").otherwise("NO_GAIN")
