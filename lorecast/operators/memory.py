"""Story memory and selection: rosters, timelines, recaps, hash-ordered and diversity-limited selection, audits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import bigram_set, dice


def roster(characters: DataFrame) -> DataFrame:
    """(story, chapter, character, key, matches): characters merged by shared names, in order.

    characters: story, chapter, seq, character, names (array). A character joins the first earlier entry with which it
    shares a name (case and spaces aside) and adds its names to it; `matches` counts the entries it could have joined.
    Order matters and merging is not transitive, so each story is a fold.
    """

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        entries: list[set] = []
        out = []
        for r in rows.sort_values(["chapter", "seq"]).itertuples():
            names = {"".join(str(n).casefold().split()) for n in r.names if n}
            hits = [i for i, e in enumerate(entries) if e & names]
            if hits:
                entries[hits[0]] |= names
            else:
                entries.append(set(names))
            out.append((key[0], r.chapter, r.character, f"P{(hits[0] if hits else len(entries) - 1) + 1}", len(hits)))
        return pd.DataFrame(out, columns=["story", "chapter", "character", "key", "matches"])

    kinds = {f.name: f.dataType.simpleString() for f in characters.schema}
    return characters.groupBy("story").applyInPandas(fold, f"story {kinds['story']}, chapter {kinds['chapter']}, character {kinds['character']}, key string, matches int")


def pair_key(a: Column, b: Column) -> Column:
    return F.array_sort(F.array(a, b))


def latest_states(states: DataFrame, before: Column) -> DataFrame:
    """(pair, state, as_of): each unordered pair's last state strictly before a position. states: a, b, position, state."""
    rows = states.where((F.col("a") != F.col("b")) & (F.col("position") < before)).withColumn("pair", pair_key(F.col("a"), F.col("b")))
    return rows.groupBy("pair").agg(F.max(F.struct("position", "state")).alias("last")).select("pair", F.col("last.state").alias("state"), F.col("last.position").alias("as_of"))


def timeline(states: DataFrame) -> DataFrame:
    """(pair, states): all states of each unordered pair in order."""
    rows = states.where(F.col("a") != F.col("b")).withColumn("pair", pair_key(F.col("a"), F.col("b")))
    return rows.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("position", "state"))).alias("states"))


def halo(segments: DataFrame, width: int = 2) -> DataFrame:
    """Segments within `width` positions of an exposed one in the same document, exposed ones left out. segments: doc, position, exposed."""
    around = Window.partitionBy("doc").orderBy("position").rowsBetween(-width, width)
    return segments.withColumn("near", F.max(F.col("exposed").cast("int")).over(around) == 1).where(F.col("near") & ~F.col("exposed")).select("doc", "position")


def clipped_windows(segments: DataFrame, before: int = 3, after: int = 3, least: int = 5) -> DataFrame:
    """(doc, position, low, high) of anchors whose window, clipped at excluded segments, is long enough. segments: doc, position, excluded."""
    rows = segments.withColumn("index", F.row_number().over(Window.partitionBy("doc").orderBy("position")))
    rows = rows.withColumn("island", F.sum(F.col("excluded").cast("int")).over(Window.partitionBy("doc").orderBy("position"))).where(~F.col("excluded"))
    whole = Window.partitionBy("doc", "island")
    rows = rows.withColumn("low", F.greatest(F.col("index") - before, F.min("index").over(whole))).withColumn("high", F.least(F.col("index") + after, F.max("index").over(whole)))
    return rows.where(F.col("high") - F.col("low") + 1 >= least).select("doc", "position", "low", "high")


def hash_order(protocol: str, fingerprint: Column, identifier: Column) -> Column:
    return F.sha2(F.concat(F.lit(protocol), fingerprint, identifier.cast("string")), 256)


def select_cases(windows: DataFrame, target: int, passes: int = 2) -> DataFrame:
    """(pool, doc, position, pass): anchors in hash order, at most one per document in the first pass and two in the second, windows disjoint.

    windows: pool, doc, position, low, high, hash. Greedy with state, so each pool is a fold.
    """

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        chosen: list = []
        order = rows.sort_values(["hash", "doc", "position"])
        for limit in range(1, passes + 1):
            for r in order.itertuples():
                if len(chosen) >= target:
                    break
                same = [c for c in chosen if c[1] == r.doc]
                if any(c[2] == r.position for c in same) or len(same) >= limit or any(c[3] <= r.high and r.low <= c[4] for c in same):
                    continue
                chosen.append((key[0], r.doc, r.position, r.low, r.high, limit))
        frame = pd.DataFrame(chosen, columns=["pool", "doc", "position", "low", "high", "pass"])
        return frame[["pool", "doc", "position", "pass"]]

    kinds = {f.name: f.dataType.simpleString() for f in windows.schema}
    return windows.groupBy("pool").applyInPandas(fold, f"pool {kinds['pool']}, doc {kinds['doc']}, position {kinds['position']}, pass int")


def hedge_audit(sentences: DataFrame, statements: DataFrame, least: float = 0.5) -> DataFrame:
    """(unit, sentence, statement, similarity): unhedged sentences whose nearest statement of the unit is hedged.

    sentences: unit, sentence, text, hedged; statements: unit, statement, text, hedged. Compared within a unit only.
    Texts of one unit with equal sets of pairs are compared once.
    """
    s = sentences.where(~F.col("hedged")).select("unit", "sentence", F.array_sort(bigram_set(F.col("text"))).alias("sb"))
    t = statements.where("hedged").select("unit", "statement", F.array_sort(bigram_set(F.col("text"))).alias("tb"))
    t = t.groupBy("unit", "tb").agg(F.min("statement").alias("statement"))
    pairs = s.select("unit", "sb").distinct().join(t, "unit").withColumn("similarity", F.round(dice(F.col("sb"), F.col("tb")), 9)).where(F.col("similarity") >= least)
    nearest = F.struct("similarity", (-F.col("statement")).alias("n"))
    sets = pairs.groupBy("unit", "sb").agg(F.max(nearest).alias("b"))
    best = s.join(sets, ["unit", "sb"]).groupBy("unit", "sentence").agg(F.max("b").alias("b"))
    return best.select("unit", "sentence", (-F.col("b.n")).alias("statement"), F.col("b.similarity").alias("similarity"))


def concept_hits(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(id, concepts): concepts whose phrases occur at word boundaries. texts: id, text; lexicon: concept, phrase (a small table)."""
    pairs = texts.join(F.broadcast(lexicon), F.expr(r"lower(text) rlike concat('(?<![\\p{L}\\p{N}])\\Q', lower(phrase), '\\E(?![\\p{L}\\p{N}])')"))
    return pairs.groupBy("id").agg(F.array_sort(F.collect_set("concept")).alias("concepts"))


def unanimous(votes: DataFrame, answer: str) -> DataFrame:
    """Flags that every vote answers alike. votes: flag, vote."""
    return votes.groupBy("flag").agg(F.min((F.col("vote") == answer).cast("int")).alias("all")).where("all = 1").select("flag")


def carry_over(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_position, new_position): units of equal content, the n-th occurrence with the n-th. old, new: position, sha."""
    def numbered(df: DataFrame, name: str) -> DataFrame:
        return df.select("sha", F.col("position").alias(name), F.row_number().over(Window.partitionBy("sha").orderBy("position")).alias("occurrence"))

    return numbered(old, "old_position").join(numbered(new, "new_position"), ["sha", "occurrence"]).select("old_position", "new_position")


def merged_spans(spans: DataFrame) -> DataFrame:
    """(doc, start, end): spans that overlap or touch are one; one without an end has its start only. spans: doc, start, end."""
    order = Window.partitionBy("doc").orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))
    rows = spans.withColumn("far", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("island", F.sum((F.col("far").isNull() | (F.col("start") > F.col("far"))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def greedy_alignment(pairs: DataFrame) -> DataFrame:
    """(case, gold, pred, score): one-to-one, best score first, ties by (gold, pred). pairs: case, gold, pred, score."""

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        g, p, out = set(), set(), []
        for r in rows.sort_values(["score", "gold", "pred"], ascending=[False, True, True]).itertuples():
            if r.gold not in g and r.pred not in p:
                g.add(r.gold)
                p.add(r.pred)
                out.append((key[0], r.gold, r.pred, r.score))
        return pd.DataFrame(out, columns=["case", "gold", "pred", "score"])

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    return pairs.groupBy("case").applyInPandas(fold, f"case {kinds['case']}, gold {kinds['gold']}, pred {kinds['pred']}, score double")


def extraction_scores(cases: DataFrame) -> DataFrame:
    """(case, precision, recall): to four digits; null for a zero denominator, precision null while a prediction awaits judgement.

    cases: case, predicted, supported, required, recovered, pending.
    """
    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) != 0, F.round(F.col(a) / F.col(b), 4))

    return cases.select("case", F.when(F.col("pending") == 0, ratio("supported", "predicted")).alias("precision"), ratio("recovered", "required").alias("recall"))


def micro_scores(cases: DataFrame) -> DataFrame:
    """One row of pooled precision and recall; precision null while any case has predictions pending."""
    total = cases.agg(*(F.sum(c).alias(c) for c in ("predicted", "supported", "required", "recovered", "pending")))
    return extraction_scores(total.withColumn("case", F.lit("all"))).drop("case")


def gates(findings: DataFrame, gate_of: DataFrame) -> DataFrame:
    """(gate, status, n): FAIL on a critical or high finding, FLAG on any other, PASS without. findings: category, severity; gate_of: gate, category."""
    hits = F.broadcast(gate_of).join(findings, "category", "left")
    grave = F.count_if(F.col("severity").isin("CRITICAL", "HIGH"))
    n = F.count("severity")
    return hits.groupBy("gate").agg(F.when(grave > 0, "FAIL").when(n > 0, "FLAG").otherwise("PASS").alias("status"), n.alias("n"))


def usage(calls: DataFrame) -> DataFrame:
    """(stage, calls, tokens) by stage and in total (stage null); missing token counts are 0. calls: stage, tokens."""
    return calls.rollup("stage").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(F.coalesce("tokens", F.lit(0.0))), 6).alias("tokens"))


def classify_error(status: Column, kind: Column) -> Column:
    """Failure category of an HTTP status (null: none) and an exception kind."""
    return F.when(status.isin(401, 403), "AUTH_FAILURE").when(status == 429, "RATE_LIMIT").when(status.between(500, 599), "SERVER_FAILURE").when(kind == "timeout", "TIMEOUT").when(kind == "network", "NETWORK_FAILURE").otherwise("PROVIDER_FAILURE")
