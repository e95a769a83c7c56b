"""The derived view of an assertion graph as of a position, as joins over normalised tables.

Tables: assertions (assertion, proposition, polarity, epistemic, rejected, available), propositions (proposition,
predicate, placeholder), args (proposition, name, kind, ref), bounds (assertion, side, anchor, available), mentions
(mention, available), paths (assertion, path, kind, available). Positions are arrays; a null one never comes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components, stored

#: What a status of its occurrence says of an event.
OCCURRENCE = {"AFFIRMED": "OCCURRED", "NEGATED": "NOT_OCCURRED", "OPEN": "OPEN", "CONTESTED": "CONTESTED", "TIME_SCOPED": "CONTESTED", "UNCOMMITTED": "NOT_ESTABLISHED"}
SETTLED = ("AFFIRMED", "NEGATED")
#: Fixed value: the attitude of holding a content true.
HOLDS_TRUE = "BELIEVES"


def seen_by(available: Column, position: Column) -> Column:
    return F.coalesce(available <= position, F.lit(False))


def visible(assertions: DataFrame, propositions: DataFrame, position: Column) -> DataFrame:
    """Assertions that are not rejected and available by the position, with their predicate."""
    return assertions.where(~F.col("rejected") & seen_by(F.col("available"), position)).join(propositions.select("proposition", "predicate"), "proposition")


def with_args(rows: DataFrame, args: DataFrame, predicate: str, *names: str) -> DataFrame:
    """The rows of one predicate with a column for each named argument."""
    wide = args.where(F.col("name").isin(*names)).groupBy("proposition").agg(*(F.max(F.when(F.col("name") == n, F.col("ref"))).alias(n) for n in names))
    return rows.where(F.col("predicate") == predicate).join(wide, "proposition")


def shown_bounds(rows: DataFrame, bounds: DataFrame, position: Column) -> DataFrame:
    """rows with start and end: the anchor of a bound that is available by the position, else null (open)."""
    known = bounds.where(seen_by(F.col("available"), position)).groupBy("assertion").agg(*(F.max(F.when(F.col("side") == s, F.col("anchor"))).alias(s) for s in ("start", "end")))
    return rows.drop("start", "end").join(known, "assertion", "left")


def visible_support(rows: DataFrame, paths: DataFrame, position: Column) -> DataFrame:
    """(assertion, sufficient, derivations, other): the paths of each visible assertion that are complete by the position."""
    complete = paths.where(seen_by(F.col("available"), position)).select("assertion", "path", "kind")
    listed = rows.select("assertion").join(complete, "assertion", "left")
    some = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("path"))))
    return listed.groupBy("assertion").agg(some("SUFFICIENT").alias("sufficient"), some("DERIVATION").alias("derivations"), some("OTHER").alias("other"))


def statuses(rows: DataFrame, key: str) -> DataFrame:
    """(key, status, affirmed, negated, open): what assertions (key, assertion, polarity, start, end) commit to.

    Both polarities are TIME_SCOPED if each affirming interval ends where each negating one starts or the other way
    round, and CONTESTED otherwise.
    """
    entry = F.struct("assertion", "start", "end")
    held = rows.groupBy(key).agg(*(F.array_sort(F.collect_list(F.when(F.col("polarity") == p, entry))).alias(n) for p, n in (("AFFIRMED", "y"), ("NEGATED", "n"), ("OPEN", "o"))))
    meets = lambda x, y: F.coalesce(x["end"] == y["start"], F.lit(False)) | F.coalesce(y["end"] == x["start"], F.lit(False))
    apart = F.forall("y", lambda x: F.forall("n", lambda y: meets(x, y)))
    status = F.when((F.size("y") > 0) & (F.size("n") > 0), F.when(apart, "TIME_SCOPED").otherwise("CONTESTED")).when(F.size("y") > 0, "AFFIRMED").when(F.size("n") > 0, "NEGATED").when(F.size("o") > 0, "OPEN").otherwise("UNCOMMITTED")
    return held.select(key, status.alias("status"), F.col("y.assertion").alias("affirmed"), F.col("n.assertion").alias("negated"), F.col("o.assertion").alias("open"))


def classes(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, root): nodes joined by pairs (a, b), the least member as root."""
    return components(nodes.select("node").unionByName(pairs.select(F.col("a").alias("node"))).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), pairs)


def affirmed_pairs(rows: DataFrame, args: DataFrame, predicate: str, first: str, second: str) -> DataFrame:
    """(a, b, status, assertion) of the predicate's pairs by the status of their proposition."""
    found = with_args(rows, args, predicate, first, second)
    return found.join(statuses(found, "proposition").select("proposition", "status"), "proposition").select(F.col(first).alias("a"), F.col(second).alias("b"), "status", "assertion")


def commitments(rows: DataFrame, content_classes: DataFrame) -> DataFrame:
    """(root, status, affirmed, negated, open) of each content class that any visible assertion is about."""
    return statuses(rows.join(content_classes, F.col("proposition") == F.col("node")), "root")


def _meets(polarity: Column, status: Column, same: str, other: str, neither: str) -> Column:
    both = status.isin(*SETTLED) & polarity.isin(*SETTLED)
    return F.when(~F.coalesce(both, F.lit(False)), neither).when(polarity == status, same).otherwise(other)


def _toward(rows: DataFrame, args: DataFrame, predicate: str, content_classes: DataFrame, committed: DataFrame, *names: str) -> DataFrame:
    """Affirmed assertions of a predicate about a content, with the content's class and status (UNCOMMITTED without)."""
    found = with_args(rows.where("polarity = 'AFFIRMED'"), args, predicate, *names, "content", "content_polarity")
    found = found.join(content_classes.select(F.col("node").alias("content"), F.col("root").alias("content_class")), "content", "left").withColumn("content_class", F.coalesce("content_class", "content"))
    return found.join(committed.select(F.col("root").alias("content_class"), "status"), "content_class", "left").withColumn("status", F.coalesce("status", F.lit("UNCOMMITTED")))


def reports(claims: DataFrame) -> DataFrame:
    """(assertion, speaker, content, relation): whether what is said agrees with what is committed. claims: assertion, speaker, content, content_polarity, status."""
    return claims.select("assertion", "speaker", "content", _meets(F.col("content_polarity"), F.col("status"), "CONSISTENT", "CONTRADICTED", "UNRESOLVED").alias("relation"))


def report_conflicts(claims: DataFrame) -> DataFrame:
    """(content_class, affirming, negating) of contents that are reported both ways."""
    lists = claims.groupBy("content_class").agg(*(F.array_sort(F.collect_list(F.when(F.col("content_polarity") == p, F.col("assertion")))).alias(n) for p, n in (("AFFIRMED", "affirming"), ("NEGATED", "negating"))))
    return lists.where((F.size("affirming") > 0) & (F.size("negating") > 0))


def secrets(concealed: DataFrame, attitudes: DataFrame) -> DataFrame:
    """(assertion, state, holding, learned, opposed, reader): concealments whose concealer holds the signed content.

    concealed: assertion, concealer, target (classes), content_class, content_polarity, end, status; attitudes:
    assertion, holder (class), attitude, content_class, content_polarity. A secret has ended once its target holds the
    signed content or its interval has a known end. reader: whether the canon's status matches the signed content.
    """
    opposite = F.when(F.col("content_polarity") == "AFFIRMED", "NEGATED").otherwise("AFFIRMED")
    held = attitudes.where(F.col("attitude") == HOLDS_TRUE).select(F.col("holder").alias("h"), F.col("content_class").alias("c"), F.col("content_polarity").alias("p"), F.col("assertion").alias("by"))

    def holding(name: str, who: str, polarity: Column) -> DataFrame:
        on = (F.col(who) == F.col("h")) & (F.col("content_class") == F.col("c")) & (polarity == F.col("p"))
        return concealed.join(held, on).groupBy("assertion").agg(F.array_sort(F.collect_list("by")).alias(name))

    out = concealed.join(holding("holding", "concealer", F.col("content_polarity")), "assertion")
    out = out.join(holding("learned", "target", F.col("content_polarity")), "assertion", "left").join(holding("opposed", "target", opposite), "assertion", "left")
    reader = _meets(F.col("content_polarity"), F.col("status"), "MATCHES_CANONICAL", "OPPOSES_CANONICAL", "UNRESOLVED")
    return out.select("assertion", F.when(F.col("learned").isNotNull() | F.col("end").isNotNull(), "ENDED").otherwise("ACTIVE").alias("state"), "holding", "learned", "opposed", reader.alias("reader"))


def reveals(committed: DataFrame, rows: DataFrame) -> DataFrame:
    """(root, status, position): where the reader first learns what a content class commits to."""
    said = committed.where(F.col("status").isin(*SETTLED, "TIME_SCOPED", "CONTESTED")).select("root", "status", F.explode(F.concat("affirmed", "negated")).alias("assertion"))
    return said.join(rows.select("assertion", "available"), "assertion").groupBy("root", "status").agg(F.min("available").alias("position"))


def embedded(propositions: DataFrame, args: DataFrame) -> DataFrame:
    """(proposition): the given ones and all that are arguments of them, at any depth. Ends on circles too."""
    inner = stored(args.where("kind = 'PROPOSITION'").select(F.col("proposition").alias("outer"), F.col("ref").alias("proposition")).distinct())
    reach, size = stored(propositions.select("proposition").distinct()), -1
    while (n := reach.count()) != size:
        size = n
        reach = stored(reach.unionByName(reach.withColumnRenamed("proposition", "outer").join(inner, "outer").select("proposition")).distinct())
    return reach


def held_events(rows: DataFrame, args: DataFrame, predicates: Sequence[str]) -> DataFrame:
    """(event): events in what visible assertions of holder-relative predicates have as content, however deeply embedded."""
    contents = rows.where(F.col("predicate").isin(*predicates)).join(args.where("name = 'content'"), "proposition").select(F.col("ref").alias("proposition"))
    return args.where("kind = 'EVENT'").join(embedded(contents, args), "proposition", "left_semi").select(F.col("ref").alias("event")).distinct()


def occurrences(rows: DataFrame, args: DataFrame, held: DataFrame) -> DataFrame:
    """(event, occurrence, assertions, held) of each event among the arguments. That an event exists says nothing of whether it occurred."""
    named = args.where("kind = 'EVENT'").select(F.col("ref").alias("event")).distinct()
    found = statuses(with_args(rows, args, "Occurred", "event"), "event")
    state = F.coalesce("status", F.lit("UNCOMMITTED"))
    mapped = F.coalesce(*(F.when(state == k, v) for k, v in OCCURRENCE.items()))
    none = F.array().cast("array<bigint>")
    listed = F.array_sort(F.concat(*(F.coalesce(c, none) for c in ("affirmed", "negated", "open"))))
    return named.join(found, "event", "left").join(held.withColumn("held", F.lit(True)), "event", "left").select("event", mapped.alias("occurrence"), listed.alias("assertions"), F.coalesce("held", F.lit(False)).alias("held"))


def stages(rows: DataFrame, entity_classes: DataFrame, symmetric: Column) -> DataFrame:
    """(predicate, subject, object, stages): each pair's relationship in order of availability.

    rows: assertion, predicate, subject, object, value, polarity, available. Symmetric predicates order their pair.
    """
    root = lambda c: entity_classes.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    both = rows.join(root("subject"), "subject", "left").join(root("object"), "object", "left").withColumn("s", F.coalesce("subject_root", "subject")).withColumn("o", F.coalesce("object_root", "object"))
    first, second = F.when(symmetric, F.least("s", "o")).otherwise(F.col("s")), F.when(symmetric, F.greatest("s", "o")).otherwise(F.col("o"))
    entry = F.struct("available", "assertion", "value", "polarity")
    return both.groupBy("predicate", first.alias("subject"), second.alias("object")).agg(F.array_sort(F.collect_list(entry)).alias("stages"))


def project(tables: dict[str, DataFrame], position: Column, holder_relative: Sequence[str] = ("Says", "Attitude", "Intends")) -> dict[str, DataFrame]:
    """All sections of the view as of a position, by name. Nothing that becomes available later has any part in it."""
    props, args = tables["propositions"], tables["args"]
    rows = stored(shown_bounds(visible(tables["assertions"], props, position), tables["bounds"], position))
    args = stored(args.join(embedded(rows, args), "proposition", "left_semi"))
    refs = args.select("kind", F.col("ref").alias("node")).distinct()
    same = stored(affirmed_pairs(rows, args, "SameAs", "first", "second"))
    identity = classes(refs.where("kind = 'ENTITY'").select("node"), same.where("status = 'AFFIRMED'").select("a", "b"))
    contents = affirmed_pairs(rows, args, "SameContent", "placeholder", "concrete").where("status = 'AFFIRMED'").select("a", "b")
    content = classes(rows.select(F.col("proposition").alias("node")).unionByName(refs.where("kind = 'PROPOSITION'").select("node")).distinct(), contents)
    committed = stored(commitments(rows, content))
    entity = identity.select(F.col("node").alias("e"), "root")
    says = _toward(rows, args, "Says", content, committed, "speaker")
    attitudes = _toward(rows, args, "Attitude", content, committed, "holder", "attitude")
    attitudes = attitudes.join(entity, F.col("holder") == F.col("e"), "left").withColumn("holder", F.coalesce("root", "holder")).drop("root", "e")
    concealed = _toward(rows, args, "Conceals", content, committed, "concealer", "concealed_from")
    for name in ("concealer", "concealed_from"):
        concealed = concealed.join(entity, F.col(name) == F.col("e"), "left").withColumn(name, F.coalesce("root", name)).drop("root", "e")
    mentions = tables["mentions"].where(seen_by(F.col("available"), position)).select("mention")
    refers = affirmed_pairs(rows, args, "RefersTo", "mention", "entity").where("status = 'AFFIRMED'").join(entity, F.col("b") == F.col("e"), "left")
    resolved = mentions.join(refers.select(F.col("a").alias("mention"), F.coalesce("root", "b").alias("root")).distinct(), "mention", "left").groupBy("mention").agg(F.array_sort(F.collect_list("root")).alias("entity_classes"))
    verdict = F.when(F.col("attitude") != HOLDS_TRUE, F.col("attitude")).otherwise(_meets(F.col("content_polarity"), F.col("status"), "KNOWS", "MISTAKEN", "UNRESOLVED_BELIEF"))
    placeholders = content.join(props.select(F.col("proposition").alias("node"), "placeholder"), "node")
    concrete = placeholders.groupBy("root").agg(F.array_sort(F.collect_list(F.when(~F.col("placeholder"), F.col("node")))).alias("resolved_to"))
    held = held_events(rows, args, holder_relative)
    broken = same.where("status = 'NEGATED'").join(identity.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(identity.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").where("ra = rb").select(F.lit("IDENTITY_CONFLICT").alias("code"), "assertion")
    contested = same.where("status = 'CONTESTED'").select(F.lit("IDENTITY_CONTESTED").alias("code"), "assertion")
    return {
        "visible_assertions": rows,
        "visible_support": visible_support(rows, tables["paths"], position),
        "visible_referents": refs,
        "visible_mentions": mentions,
        "identity_equivalence": identity,
        "mention_resolution": resolved.withColumn("status", F.when(F.size("entity_classes") == 0, "UNRESOLVED").when(F.size("entity_classes") == 1, "RESOLVED").otherwise("AMBIGUOUS")),
        "content_resolution": placeholders.where("placeholder").join(concrete, "root").select("node", "resolved_to"),
        "canonical_commitments": committed,
        "knowledge_verdicts": attitudes.select("assertion", "holder", "content", verdict.alias("verdict")),
        "reported_claims": reports(says),
        "report_conflicts": report_conflicts(says),
        "secrets": secrets(concealed.withColumnRenamed("concealed_from", "target"), attitudes),
        "reader_reveals": reveals(committed, rows),
        "event_occurrence": occurrences(rows, args, held),
        "temporal_relations": with_args(rows, args, "TemporalRelation", "subject", "relation", "object").select("assertion", "subject", "relation", "object", "polarity", "epistemic"),
        "diagnostics": broken.unionByName(contested),
    }
