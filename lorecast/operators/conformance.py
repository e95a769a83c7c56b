"""Conformance of an assertion graph and of drafts: each rule gives rows of problems, and reports gather them by section."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _kinds(*cases: tuple[Column, str]) -> Column:
    """One row for each case that holds."""
    return F.explode(F.filter(F.array(*(F.when(c, F.lit(n)) for c, n in cases)), lambda x: x.isNotNull()))


def typing_problems(propositions: DataFrame, args: DataFrame, registry: DataFrame, tokens: DataFrame, forbidden: Sequence[str] = ()) -> DataFrame:
    """(proposition, problem) of predicates and arguments against a registry.

    propositions: proposition, predicate, placeholder (never checked); args: proposition, name, kind, ref; registry:
    predicate, name, kind, vocabulary, entity_kinds (array, null: any); tokens: vocabulary, value. Where the argument
    names differ nothing else is said of a proposition, and of an argument of a wrong kind only that.
    """
    live = propositions.where(~F.col("placeholder"))
    want = registry.groupBy("predicate").agg(F.array_sort(F.collect_set("name")).alias("wanted"))
    have = args.groupBy("proposition").agg(F.array_sort(F.collect_set("name")).alias("names"))
    rows = live.join(want, "predicate", "left").join(have, "proposition", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    banned = F.upper("predicate").isin(*forbidden) if forbidden else F.lit(False)
    whole = rows.select("proposition", "predicate", F.when(banned, "FORBIDDEN_VERDICT").when(F.col("wanted").isNull(), "UNREGISTERED_PREDICATE").when(F.col("names") != F.col("wanted"), "ARITY").alias("problem"))
    sound = whole.where("problem is null").select("proposition", "predicate")
    spec = registry.select("predicate", "name", F.col("kind").alias("want"), "vocabulary", "entity_kinds")
    each = args.join(sound, "proposition").join(spec, ["predicate", "name"])
    each = each.join(tokens.select("vocabulary", F.col("value").alias("ref"), F.lit(True).alias("listed")), ["vocabulary", "ref"], "left")
    stored_verdict = F.upper("ref").isin(*forbidden) if forbidden else F.lit(False)
    wrong = F.when(F.col("kind") != F.col("want"), "ARG_KIND").when((F.col("want") == "TOKEN") & stored_verdict, "FORBIDDEN_VERDICT").when((F.col("want") == "TOKEN") & F.col("listed").isNull(), "VOCABULARY")
    return whole.where("problem is not null").select("proposition", "problem").unionByName(each.select("proposition", wrong.alias("problem")).where("problem is not null")).distinct()


def grounding_problems(sets: DataFrame, evidence: DataFrame, excluded: Sequence[str] = ("PARATEXT",)) -> DataFrame:
    """(assertion, set, problem): sufficient sets with evidence of a role that does not ground, and unknown evidence. sets: assertion, set, sufficient, ref; evidence: ref, role."""
    rows = sets.join(evidence, "ref", "left")
    wrong = F.when(F.col("role").isNull(), "UNKNOWN_EVIDENCE").when(F.col("sufficient") & F.col("role").isin(*excluded), "NOT_GROUNDING")
    return rows.select("assertion", "set", wrong.alias("problem")).where("problem is not null").distinct()


def unsupported(assertions: DataFrame, available: DataFrame) -> DataFrame:
    """(assertion): those neither rejected nor ever available. assertions: assertion, rejected; available: assertion, available."""
    return assertions.where(~F.col("rejected")).join(available, "assertion", "left").where(F.col("available").isNull()).select("assertion")


def bound_problems(bounds: DataFrame, anchors: DataFrame) -> DataFrame:
    """(assertion, problem) of validity bounds. bounds: assertion, stative, rejected, start, end (anchors, null: open), start_known, end_known (a bound's support is complete or absent); anchors: anchor."""
    known = [anchors.select(F.col("anchor").alias(f"{s}_anchor"), F.lit(True).alias(f"{s}_there")) for s in ("start", "end")]
    rows = bounds
    for s, a in zip(("start", "end"), known, strict=True):
        rows = rows.join(a, F.col(s) == F.col(f"{s}_anchor"), "left")
    lost = lambda s: F.col(s).isNotNull() & F.col(f"{s}_there").isNull()
    loose = lambda s: F.col(f"{s}_there").isNotNull() & ~F.col(f"{s}_known") & ~F.col("rejected")
    return rows.select("assertion", _kinds((~F.col("stative"), "NOT_STATIVE"), (lost("start") | lost("end"), "UNKNOWN_ANCHOR"), (loose("start") | loose("end"), "INCOMPLETE_BOUND"), (F.coalesce(F.col("start") == F.col("end"), F.lit(False)), "SAME_ANCHOR")).alias("problem")).distinct()


def report(sections: dict[str, DataFrame]) -> DataFrame:
    """(section, passed, issues): each section's distinct problems, sorted; tables of (subject, problem)."""
    spark = next(iter(sections.values())).sparkSession
    named = spark.createDataFrame([(s,) for s in sections], "section string")
    found = None
    for s, rows in sections.items():
        one = rows.select(F.lit(s).alias("section"), F.concat_ws(": ", F.col("problem"), F.col("subject").cast("string")).alias("issue")).distinct()
        found = one if found is None else found.unionByName(one)
    per = found.groupBy("section").agg(F.count(F.lit(1)).alias("issues"))
    return F.broadcast(named).join(per, "section", "left").select("section", F.col("issues").isNull().alias("passed"), F.coalesce("issues", F.lit(0)).cast("long").alias("issues"))


def issue_codes(issues: DataFrame) -> DataFrame:
    """(code, n): what stands before an issue's first colon. issues: issue."""
    return issues.groupBy(F.trim(F.substring_index("issue", ":", 1)).alias("code")).agg(F.count(F.lit(1)).alias("n"))


def issue_template(message: Column) -> Column:
    """A message without its ids, quoted texts and numbers."""
    plain = F.regexp_replace(message, r"\b[A-Za-z]+[0-9]+(?:\.[A-Za-z]+[0-9]+)*\b", "<id>")
    plain = F.regexp_replace(plain, r"'[^']*'|\"[^\"]*\"", "<text>")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?<![\w<])[-+]?[0-9]+(?:\.[0-9]+)?(?![\w>])", "<n>"), r"\s+", " "))


def quote_relation(mention: Column, evidence: Column) -> Column:
    """How two quotes stand to each other."""
    return F.when(mention == evidence, "EQUAL").when(F.contains(evidence, mention), "MENTION_WITHIN_EVIDENCE").when(F.contains(mention, evidence), "EVIDENCE_WITHIN_MENTION").otherwise("DISTINCT")


def repair_effect(before: Column, after: Column, unchanged: Column, passed: Column) -> Column:
    """What a repair did; before and after are structs of the first failure's category, code and path."""
    return F.when(unchanged, "NO_CHANGE").when(passed, "FULL_STRUCTURAL_CORRECTION").when(before.eqNullSafe(after), "TRIGGER_PERSISTED").otherwise("NEXT_TRIGGER_EXPOSED")


def root_cause(category: Column, code: Column) -> Column:
    """The cause behind a structural failure, and none where there is no failure."""
    by_code = F.when(code == "MENTION_EVIDENCE_MISMATCH", "MENTION_HANDLE_POINTS_ELSEWHERE").when(code == "AMBIGUOUS_QUOTE", "REPEATED_QUOTE_WITHOUT_OCCURRENCE")
    by_category = F.when(category == "JSON_PARSE_FAILURE", "NOT_JSON").when(category == "DRAFT_SCHEMA_FAILURE", "AGAINST_SCHEMA")
    return F.when(category.isNull(), "NONE").otherwise(F.coalesce(by_code, by_category, F.lit("OTHER_REJECTION")))


def change_shape(before: DataFrame, after: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(collection, added, removed, changed) of two versions of records (collection, handle, fields)."""
    a = before.select("collection", "handle", F.struct(*fields).alias("a"))
    b = after.select("collection", "handle", F.struct(*fields).alias("b"))
    both = a.join(b, ["collection", "handle"], "full")
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("handle"))))
    out = both.groupBy("collection").agg(pick(F.col("a").isNull()).alias("added"), pick(F.col("b").isNull()).alias("removed"), pick(F.col("a") != F.col("b")).alias("changed"))
    return out.where("size(added) + size(removed) + size(changed) > 0")


def structural_items(args: DataFrame, roots: DataFrame, symmetric: Sequence[str] = (), depth: int = 8) -> DataFrame:
    """(root, path, kind, ref): every referent of a proposition and of those embedded in it, by the path of argument names.

    args: proposition, predicate, name, kind, ref; roots: root (propositions to start from). The names of a symmetric
    predicate's arguments count as one ('*'). Embedding beyond `depth` levels, and so any circle, is an error.
    """
    step = F.concat_ws(".", "predicate", F.when(F.col("predicate").isin(*symmetric), "*").otherwise(F.col("name"))) if symmetric else F.concat_ws(".", "predicate", "name")
    edges = args.select(F.col("proposition").alias("p"), step.alias("step"), "kind", "ref")
    level, out = roots.select("root", F.col("root").alias("at"), F.lit("").alias("above")), None
    for _ in range(depth):
        found = level.join(edges, F.col("at") == F.col("p")).select("root", F.concat_ws("/", F.when(F.col("above") != "", F.col("above")), F.col("step")).alias("path"), "kind", "ref")
        out = found if out is None else out.unionByName(found)
        level = found.where("kind = 'PROPOSITION'").select("root", F.col("ref").alias("at"), F.col("path").alias("above"))
    deeper = level.join(edges, F.col("at") == F.col("p")).select("root", F.raise_error(F.lit("propositions are embedded too deeply")).cast("string").alias("path"), "kind", "ref")
    return out.unionByName(deeper).where("kind <> 'PROPOSITION'").distinct()


def align_in_phases(pairs: DataFrame, phases: Sequence[str]) -> DataFrame:
    """(gold, pred, phase): one-to-one, phase by phase; in each, pairs that are the only choice of either side so far.

    pairs: gold, pred and a boolean column for each phase. A pair whose gold or predicted item has several open
    partners in a phase is left to the next one.
    """
    done = pairs.select("gold", "pred", F.lit("").alias("phase")).where("false")
    for phase in phases:
        open_ = pairs.where(F.col(phase)).join(done.select("gold"), "gold", "left_anti").join(done.select("pred"), "pred", "left_anti").select("gold", "pred").distinct()
        one = lambda side: open_.groupBy(side).agg(F.count(F.lit(1)).alias("n")).where("n = 1").select(side)  # noqa: B023, E731
        done = done.unionByName(open_.join(one("gold"), "gold", "left_semi").join(one("pred"), "pred", "left_semi").select("gold", "pred", F.lit(phase).alias("phase")))
    return done


def case_counts(predictions: DataFrame, required: DataFrame, aligned: DataFrame) -> DataFrame:
    """(case, predicted, supported, required, recovered, pending) from records.

    predictions: case, pred, verdict (SUPPORTED, UNSUPPORTED or null while it awaits judgement); required: case, gold;
    aligned: case, gold, pred. An aligned prediction is supported whatever its verdict.
    """
    hit = aligned.select("case", "pred", F.lit(True).alias("hit")).distinct()
    p = predictions.join(hit, ["case", "pred"], "left").withColumn("ok", F.coalesce(F.col("hit"), F.col("verdict") == "SUPPORTED"))
    per = p.groupBy("case").agg(F.count(F.lit(1)).alias("predicted"), F.count_if("ok").alias("supported"), F.count_if(F.col("ok").isNull()).alias("pending"))
    got = aligned.select("case", "gold", F.lit(True).alias("got")).distinct()
    r = required.join(got, ["case", "gold"], "left").groupBy("case").agg(F.count(F.lit(1)).alias("required"), F.count("got").alias("recovered"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return per.join(r, "case", "full").select("case", *(zero(c) for c in ("predicted", "supported", "required", "recovered", "pending")))


def miss_cause(required: DataFrame, predictions: DataFrame, aligned: DataFrame) -> DataFrame:
    """(case, gold, cause) of required items that nothing recovered, by the nearest prediction.

    required and predictions: case, gold or pred, predicate, subject, value, polarity.
    """
    missed = required.join(aligned.select("case", "gold"), ["case", "gold"], "left_anti")
    p = predictions.select("case", *(F.col(c).alias(f"p_{c}") for c in ("predicate", "subject", "value", "polarity")))
    same = lambda *cs: F.max(F.when(F.reduce(F.array(*(F.col(c) == F.col(f"p_{c}") for c in cs)), F.lit(True), lambda a, b: a & F.coalesce(b, F.lit(False))), 1)).isNotNull()
    found = missed.join(p, "case", "left").groupBy("case", "gold").agg(same("predicate", "subject", "value").alias("pol"), same("predicate", "value").alias("ref"), same("predicate", "subject").alias("val"), same("subject", "value").alias("pre"))
    return found.select("case", "gold", F.when(F.col("pol"), "POLARITY").when(F.col("ref"), "REFERENT").when(F.col("val"), "VALUE").when(F.col("pre"), "OTHER_PREDICATE").otherwise("NOT_EXTRACTED").alias("cause"))
