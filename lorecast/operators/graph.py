"""The assertion graph: components, availability, closures, identity, commitments and as-of visibility."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _scratch(spark: SparkSession) -> str:
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("iterations need a folder that all machines share: set spark.checkpoint.dir")
        folder = "file://" + tempfile.mkdtemp(prefix="lorecast-")  # one machine, as in tests
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/lorecast/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Written into the shared folder and read back: an iteration's lineage ends here."""
    path = _scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(node, root): the smallest node that each reaches. Rounds of least neighbour and pointer jumping until nothing changes.

    An error if something still changes after most_rounds.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    labels = stored(nodes.select("node", F.col("node").alias("root")).distinct())
    both = stored(both)
    for _ in range(most_rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        pulled = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        jump = labels.select(F.col("node").alias("j"), F.col("root").alias("of"))
        step = stored(pulled.join(jump, F.col("root") == F.col("j"), "left").select("node", "old", F.least("root", F.coalesce("of", "root")).alias("root")))
        labels = step.select("node", "root")
        if step.where("old <> root").limit(1).count() == 0:
            return labels
    raise RuntimeError("components did not settle")


def availability(assertions: DataFrame, sets: DataFrame, premises: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """(assertion, available): the least position at which each assertion's support is complete; null if it never is.

    assertions: assertion, rejected. sets: assertion, path, position (array of int), grounding, sufficient; a set is
    complete at its largest position if it is sufficient and all its evidence grounds. premises: assertion, path,
    premise; a derivation is complete at the largest availability of its premises, if all have one. An assertion is
    available at its earliest complete path; a rejected one never is. This is the least fixpoint, so support that
    runs in a circle gives nothing. Each round is a join and two aggregations; lineage is cut by a stored table. Rounds
    go on until nothing changes, at most one more than there are assertions (or most_rounds; an error beyond).
    """
    most_rounds = assertions.count() + 1 if most_rounds is None else most_rounds
    live = assertions.where(~F.col("rejected")).select("assertion")
    direct = sets.groupBy("assertion", "path").agg(F.max("position").alias("p"), F.min(F.col("grounding") & F.col("sufficient")).alias("ok")).where("ok")
    direct = stored(direct.join(live, "assertion", "left_semi").groupBy("assertion").agg(F.min("p").alias("available")))
    needs = stored(premises.join(live, "assertion", "left_semi").select("assertion", "path", "premise"))
    known = direct
    last = None
    for _ in range(most_rounds):
        held = known.select(F.col("assertion").alias("premise"), "available")
        derived = needs.join(held, "premise", "left").groupBy("assertion", "path").agg(F.max("available").alias("p"), F.count("available").alias("have"), F.count(F.lit(1)).alias("need")).where("have = need")
        new = derived.select("assertion", F.col("p").alias("available")).unionByName(direct).groupBy("assertion").agg(F.min("available").alias("available"))
        known = stored(new)
        sign = known.agg(F.count(F.lit(1)), F.sum(F.xxhash64("assertion", "available").cast("decimal(38,0)"))).first()
        if sign == last:
            break
        last = sign
    else:
        raise RuntimeError("availability did not settle")
    return assertions.select("assertion").join(known, "assertion", "left")


def circular(premises: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """Assertions that support themselves through derivations.

    Whatever is on a circle has a premise and is a premise of others on it; so assertions without a premise left, or
    that nothing left builds on, go round by round. What remains are the circles and the paths between them; there the
    reach of each is doubled until nothing is new. An error if that takes more than most_rounds (the number of edges).
    """
    reach = stored(premises.select(F.col("assertion").alias("a"), F.col("premise").alias("b")).distinct())
    left = reach.count()
    rounds = left + 1 if most_rounds is None else most_rounds
    for _ in range(rounds):
        builds, built = reach.select(F.col("a").alias("n")).distinct(), reach.select(F.col("b").alias("n")).distinct()
        reach = stored(reach.join(builds, F.col("b") == F.col("n"), "left_semi").join(built, F.col("a") == F.col("n"), "left_semi"))
        before, left = left, reach.count()
        if left == before:
            break
    for _ in range(rounds):
        further = reach.alias("x").join(reach.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b")
        reach = stored(reach.unionByName(further).distinct())
        before, left = left, reach.count()
        if left == before:
            return reach.where("a = b").select(F.col("a").alias("assertion")).distinct()
    raise RuntimeError("circles did not settle")


def visible(assertions: DataFrame, position: Column) -> DataFrame:
    """Assertions that are not rejected and available at or before a position (arrays compare item by item, shorter first)."""
    return assertions.where(~F.col("rejected") & (F.col("available") <= position))


def identity_conflicts(classes: DataFrame, negated: DataFrame) -> DataFrame:
    """Pairs said not to be the same that one class holds. classes: node, root; negated: a, b."""
    a, b = classes.select(F.col("node").alias("a"), F.col("root").alias("ra")), classes.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return negated.join(a, "a").join(b, "b").where("ra = rb").select("a", "b", F.col("ra").alias("root"))


def commitments(statements: DataFrame) -> DataFrame:
    """(content, status): AFFIRMED, NEGATED, OPEN, TIME_SCOPED, CONTESTED or UNCOMMITTED. statements: content, polarity, commits, bounded."""
    yes, no = F.count_if(F.col("commits") & (F.col("polarity") == "AFFIRMED")), F.count_if(F.col("commits") & (F.col("polarity") == "NEGATED"))
    loose = F.count_if(F.col("commits") & ~F.col("bounded"))
    status = F.when((yes > 0) & (no > 0), F.when(loose == 0, "TIME_SCOPED").otherwise("CONTESTED")).when(yes > 0, "AFFIRMED").when(no > 0, "NEGATED").when(F.count_if("commits") > 0, "OPEN").otherwise("UNCOMMITTED")
    return statements.groupBy("content").agg(status.alias("status"))


def knowledge(attitudes: DataFrame, status: DataFrame) -> DataFrame:
    """(holder, content, verdict): a held content meets its commitment. attitudes: holder, content, polarity, kind; status: content, status."""
    met = attitudes.join(status, "content", "left")
    agrees = ((F.col("polarity") == "AFFIRMED") & (F.col("status") == "AFFIRMED")) | ((F.col("polarity") == "NEGATED") & (F.col("status") == "NEGATED"))
    differs = ((F.col("polarity") == "AFFIRMED") & (F.col("status") == "NEGATED")) | ((F.col("polarity") == "NEGATED") & (F.col("status") == "AFFIRMED"))
    verdict = F.when(F.col("kind") != "BELIEVES", F.col("kind")).when(agrees, "KNOWS").when(differs, "MISTAKEN").otherwise("UNRESOLVED_BELIEF")
    return met.select("holder", "content", verdict.alias("verdict"))


def functional_conflicts(values: DataFrame) -> DataFrame:
    """Pairs of assertions that give one key different values and are not provably disjoint. values: key, assertion, value, start_anchor, end_anchor."""
    x, y = values.alias("x"), values.alias("y")
    disjoint = F.coalesce(F.col("x.end_anchor") == F.col("y.start_anchor"), F.lit(False)) | F.coalesce(F.col("y.end_anchor") == F.col("x.start_anchor"), F.lit(False))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.assertion") < F.col("y.assertion")) & (F.col("x.value") != F.col("y.value")))
    return pairs.where(~disjoint).select(F.col("x.key").alias("key"), F.col("x.assertion").alias("first"), F.col("y.assertion").alias("second"))


def _bin_width(spans: DataFrame, start: str, end: str) -> float:
    mean = spans.where(F.col(start) <= F.col(end)).agg(F.avg(F.col(end) - F.col(start))).first()[0]
    return max(1.0, float(mean or 0))


def _bins(start: str, end: str, width: float) -> Column:
    return F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width)))


def span_matches(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """Containment join in one segment: predicted spans that hold a gold span (exactly it, where the segment is narrow).

    predicted: p_id, segment, p_start, p_end; gold: g_id, segment, g_start, g_end, narrow. A segment is cut into bins of
    about a predicted span's mean length; a gold span meets, in the bin it starts in, the predicted spans that reach
    into that bin. Spans that end before they start, or lack an offset, match nothing.
    """
    width = _bin_width(predicted, "p_start", "p_end")
    predicted = predicted.where("p_start <= p_end").withColumn("bin", _bins("p_start", "p_end", width))
    gold = gold.where("g_start <= g_end").withColumn("bin", F.floor(F.col("g_start") / width))
    inside = (F.col("p_start") <= F.col("g_start")) & (F.col("g_end") <= F.col("p_end"))
    exact = (F.col("p_start") == F.col("g_start")) & (F.col("g_end") == F.col("p_end"))
    return predicted.join(gold, ["segment", "bin"]).where(F.when(F.col("narrow"), exact).otherwise(inside)).select("p_id", "g_id", "segment")


def span_overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """Half-open overlap join in one segment; null offsets never match. left: l_id, segment, l_start, l_end; right likewise.

    Both sides are dealt by the bins that they reach into; a pair counts in the bin where its overlap begins.
    """
    width = _bin_width(left, "l_start", "l_end")
    left = left.where("l_start <= l_end").withColumn("bin", _bins("l_start", "l_end", width))
    right = right.where("r_start <= r_end").withColumn("bin", _bins("r_start", "r_end", width))
    overlap = (F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end"))
    here = F.col("bin") == F.floor(F.greatest("l_start", "r_start") / width)
    return left.join(right, ["segment", "bin"]).where(overlap & here).select("l_id", "r_id", "segment")


def dangling(children: DataFrame, child_key: str, parents: DataFrame, parent_key: str, rule: str) -> DataFrame:
    """(rule, key) of references that lead nowhere."""
    return children.where(F.col(child_key).isNotNull()).join(parents.select(F.col(parent_key).alias("__p")), F.col(child_key) == F.col("__p"), "left_anti").select(F.lit(rule).alias("rule"), F.col(child_key).cast("string").alias("key"))


def duplicated(rows: DataFrame, key: str, rule: str) -> DataFrame:
    """(rule, key) of ids that occur more than once."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))
