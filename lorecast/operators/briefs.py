"""Briefs and sentences: rendered items, corpus identity, dossiers, clauses, names, forms and the rules over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import let
from .rules import foreign_characters, text_length

#: Fixed value: a reference to an event, a character's fact or a relationship of a chapter.
ITEM_REF = r"^c[0-9]+\.(?:E[0-9]+|CH[0-9]+\.F[0-9]+|R[0-9]+)$"


def canonical_sha(*columns: Column | str) -> Column:
    """Digest of a row's values as JSON, in the given order of columns."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def stream_fingerprint(docs: DataFrame, contract: str, domain: str = "corpus-fingerprint") -> DataFrame:
    """(story, stream, fingerprint) over the contract's version and the ordered documents. docs: story, stream, order, document, version."""
    listed = F.array_sort(F.collect_list(F.struct("order", F.col("document").alias("document_id"), "version")))
    body = F.to_json(F.struct(F.lit(contract).alias("contract_version"), listed.alias("documents"), F.col("story").alias("story_id"), F.col("stream").alias("stream_id")))
    return docs.groupBy("story", "stream").agg(F.sha2(F.concat_ws("\n", F.lit(domain), body), 256).alias("fingerprint"))


def evidence_refs(passages: DataFrame, roles: Sequence[str]) -> DataFrame:
    """passages with role and evidence_id given by the caller, checked: a role that is not listed, or an id that is not plain, is an error."""
    bad = F.when(~F.col("role").isin(*roles), F.raise_error(F.lit("an evidence role is not listed"))).when(~F.col("evidence_id").rlike(r"^[A-Za-z0-9][A-Za-z0-9_.:-]*$"), F.raise_error(F.lit("an evidence id is not plain")))
    return passages.withColumn("evidence_id", F.coalesce(bad.cast("string"), F.col("evidence_id")))


def is_item_ref(ref: Column) -> Column:
    return ref.rlike(ITEM_REF)


def rendered_events(events: DataFrame, labels: dict[str, str]) -> DataFrame:
    """(ref, chapter, text): an event's summary followed by whatever else is known of it, each under its label.

    events: chapter, event, summary, participants (array of names), location, motivation, motivation_status, consequence.
    """
    label = lambda k, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(labels[k] + ": "), value))
    why = F.when(F.coalesce("motivation", F.lit("")) != "", F.concat(F.lit(labels["motivation"] + " ("), F.coalesce("motivation_status", F.lit("?")), F.lit("): "), F.col("motivation")))
    text = F.concat_ws(". ", "summary", label("participants", F.array_join("participants", ", ")), label("location", F.col("location")), why, label("consequence", F.col("consequence")))
    return events.select(F.concat(F.lit("c"), "chapter", F.lit("."), "event").alias("ref"), "chapter", text.alias("text"))


def rendered_facts(facts: DataFrame) -> DataFrame:
    """(ref, chapter, text): facts numbered within their character, after all its names, each once. facts: chapter, character, names (array), seq, fact."""
    n = F.row_number().over(Window.partitionBy("chapter", "character").orderBy("seq"))
    return facts.select(F.concat(F.lit("c"), "chapter", F.lit("."), "character", F.lit(".F"), n).alias("ref"), "chapter", F.concat(F.array_join(F.array_distinct("names"), " / "), F.lit(": "), "fact").alias("text"))


def corpus_problems(items: DataFrame, passages: DataFrame, briefs: DataFrame, cutoff: int) -> DataFrame:
    """(subject, problem): chapters up to the cutoff without a brief, items without evidence, evidence that is unknown or of another chapter, repeated refs.

    items: ref, chapter, evidence (array); passages: passage, chapter; briefs: chapter.
    """
    spark = items.sparkSession
    missing = spark.range(1, cutoff + 1).select(F.col("id").alias("chapter")).join(briefs, "chapter", "left_anti").select(F.col("chapter").cast("string").alias("subject"), F.lit("NO_BRIEF").alias("problem"))
    here = items.where(F.col("chapter") <= cutoff)
    bare = here.where(F.size("evidence") == 0).select(F.col("ref").alias("subject"), F.lit("NO_EVIDENCE").alias("problem"))
    p = passages.where(F.col("chapter") <= cutoff).select("passage", F.col("chapter").alias("of"))
    cited = here.select("ref", "chapter", F.explode("evidence").alias("passage")).join(p, "passage", "left")
    wrong = cited.select(F.col("ref").alias("subject"), F.when(F.col("of").isNull(), "UNKNOWN_EVIDENCE").when(F.col("of") != F.col("chapter"), "OTHER_CHAPTER").alias("problem")).where("problem is not null").distinct()
    twice = here.groupBy("ref").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("ref").alias("subject"), F.lit("REPEATED").alias("problem"))
    return missing.unionByName(bare).unionByName(wrong).unionByName(twice)


def dossier(items: DataFrame, names: DataFrame) -> DataFrame:
    """(entity, refs): the items that name an entity at word boundaries, in order. Never complete: briefs keep selected facts only. items: ref, seq, text; names: entity, name (a small table)."""
    hit = items.join(F.broadcast(names.where("trim(name) <> ''")), F.expr(r"lower(text) rlike concat('(?U)(?<!\\w)\\Q', lower(name), '\\E(?!\\w)')"))
    return hit.select("entity", F.struct("seq", "ref").alias("at")).distinct().groupBy("entity").agg(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["ref"]).alias("refs"))


def expanded_evidence(hits: DataFrame, passages: DataFrame) -> DataFrame:
    """(query, rank, ref, passage, place, text): all evidence of each hit, in order; a passage that is not there is an error. hits: query, rank, ref, evidence (array)."""
    rows = hits.select("query", "rank", "ref", F.posexplode("evidence").alias("place", "passage")).join(passages.select("passage", "text"), "passage", "left")
    return rows.withColumn("text", F.coalesce("text", F.raise_error(F.concat(F.lit("no passage "), "passage")).cast("string")))


def chosen_items(items: DataFrame, kinds: Sequence[str] = (), cutoff: int | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Items of some kinds up to a cutoff, without the excluded refs."""
    out = items.where(F.col("kind").isin(*kinds)) if kinds else items
    out = out if cutoff is None else out.where(F.col("chapter") <= cutoff)
    return out if exclude is None else out.join(exclude, "ref", "left_anti")


# ------------------------------------------------------------ sentences

def split_lines(docs: DataFrame) -> DataFrame:
    """(doc, line, content, start, blank): lines ended by any of Unicode's line and separator controls, CRLF being one. docs: doc, text."""
    ends = r"\r\n|[\n\r\x{000B}\x{000C}\x{001C}-\x{001E}\x{0085}\x{2028}\x{2029}]"
    body = r"[^\n\r\x{000B}\x{000C}\x{001C}-\x{001E}\x{0085}\x{2028}\x{2029}]"
    raw = docs.select("doc", F.posexplode(F.regexp_extract_all("text", F.lit(rf"{body}*(?:{ends})|{body}+"), 0)).alias("line", "raw"))
    start = F.coalesce(F.sum(F.length("raw")).over(Window.partitionBy("doc").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    content = F.regexp_replace("raw", rf"(?:{ends})$", "")
    return raw.select("doc", "line", content.alias("content"), start.alias("start"), content.rlike(r"(?U)^[\s\x{001C}-\x{001F}]*$").alias("blank"))


def clauses(text: Column, markers: Sequence[str] = (), punctuation: str = ",;.!?、。，；()（）") -> Column:
    """Trimmed pieces between punctuation marks and marker words."""
    cut = f"[{punctuation}]+"
    if markers:
        cut += r"|(?U)(?<!\w)(?i:" + "|".join(sorted((rf"\Q{m}\E" for m in markers), key=len, reverse=True)) + r")(?!\w)"
    return F.filter(F.transform(F.split(text, cut), lambda x: F.trim(x)), lambda x: x != "")


def contrast_parts(text: Column, openers: Sequence[str], endings: Sequence[str]) -> Column:
    """Parts that a contrast separates: a piece begins one if the piece before ended a contrast, or if it opens one. Joined they are the text."""
    starts = F.lit(False)
    pieces = F.filter(F.split(text, r"(?<=[,;、，；])"), lambda x: x != "")
    opens = lambda x: F.lower(x).rlike(r"(?U)^\s*(?:" + "|".join(rf"\Q{o}\E" for o in openers) + r")(?![\p{L}\p{N}])") if openers else starts
    closes = lambda x: F.lower(x).rlike(r"(?U)(?:" + "|".join(rf"\Q{e}\E" for e in endings) + r")[\s,;、，；]*$") if endings else starts

    def fold(pieces: Column) -> Column:
        fresh = F.transform(pieces, lambda x, i: (i == 0) | opens(x) | F.coalesce(closes(F.get(pieces, i - 1)), F.lit(False)))
        bounds = F.filter(F.transform(fresh, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())
        stops = F.concat(F.slice(bounds, 2, F.greatest(F.size(bounds) - 1, F.lit(0))), F.array(F.size(pieces)))
        return F.zip_with(bounds, stops, lambda a, b: F.array_join(F.slice(pieces, a + 1, b - a), ""))

    return F.when(F.size(pieces) == 0, F.array().cast("array<string>")).otherwise(let(pieces, fold))


def without_dialogue(text: Column) -> Column:
    """The text with quoted speech taken out."""
    return F.regexp_replace(text, "\"[^\"]*\"|“[^”]*”|«[^»]*»|「[^」]*」|『[^』]*』", " ")


def speech_content_start(text: Column, verbs: Sequence[str], complementizers: Sequence[str], hedges: Sequence[str] = (), gap: int = 30) -> Column:
    """From where on the first reported speech stands: after a verb of saying and a complementizer within `gap` characters of one clause; null without. Hedge phrases do not count."""
    low = F.lower(text)
    for h in sorted(hedges, key=len, reverse=True):
        low = F.replace(low, F.lit(h), F.lit(" " * len(h)))
    either = lambda words: "|".join(rf"\Q{w}\E" for w in words)
    found = F.regexp_extract(low, rf"(?U)(?s)^(.*?(?<!\w)(?:{either(verbs)})(?!\w)[^,.;:!?、。，；]{{0,{gap}}}?(?<!\w)(?:{either(complementizers)})(?!\w))", 1)
    return F.when(found != "", F.length(found))


def quoted_sentences(text: Column, quote: Column) -> Column:
    """The sentences that a quote's first occurrence reaches into; empty where it does not occur."""
    sentences = F.regexp_extract_all(text, F.lit(r"(?s)[^.!?。！？]*[.!?。！？]+\s*|[^.!?。！？]+$"), 0)
    at = F.instr(text, quote) - 1

    def placed(parts: Column) -> Column:
        ends = F.transform(parts, lambda _, i: F.length(F.array_join(F.slice(parts, 1, i + 1), "")))
        return F.filter(parts, lambda p, i: (ends[i] > at) & (ends[i] - F.length(p) < at + F.length(quote)))

    return F.when((quote == "") | (at < 0), F.array().cast("array<string>")).otherwise(let(sentences, placed))


def script_check(text: Column, language: str, least: int, most: int, artifacts: Column) -> Column:
    """Length, language and cleanliness of a finished text."""
    n, foreign = text_length(text, language), F.size(foreign_characters(text, language))
    return F.struct(n.alias("words"), n.between(least, most).alias("length_ok"), foreign.alias("foreign"), (foreign == 0).alias("language_ok"), (F.size(artifacts) == 0).alias("clean_ok"))


def latin_name(name: Column) -> Column:
    """Whether a name is written in Latin script: it begins with a letter and has nothing from U+2E80 on."""
    return F.coalesce(name.rlike(r"^[A-Za-zÀ-ɏḀ-ỿ]") & ~name.rlike(r"[\x{2E80}-\x{10FFFF}]"), F.lit(False))


def new_names(text: Column, known: Column) -> Column:
    """Capitalised words that begin no sentence and whose lower-cased form is not in an array of known words, once each."""
    inner = F.regexp_extract_all(text, F.lit(r"(?<![.!?…:;\"“”(\s])\s+(\p{Lu}[\p{L}\p{N}'’-]*)"), 1)
    return F.filter(F.array_distinct(inner), lambda w: ~F.array_contains(known, F.lower(w)))


def new_numbers(text: Column, cited: Column) -> Column:
    """Numbers of a text that the cited text does not have, once each, in order."""
    numbers = lambda c: F.regexp_extract_all(c, F.lit(r"[0-9]+(?:[.,][0-9]+)*"), 0)
    return F.array_except(numbers(text), numbers(cited))


def form_entries(forms: DataFrame) -> DataFrame:
    """(form, section, key, value) from lines `key: value` under the last heading (`#`). forms: form, text."""
    lines = forms.select("form", F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw"))
    heading = F.when(F.col("raw").rlike(r"^#+\s"), F.trim(F.regexp_replace("raw", r"^#+\s+", "")))
    section = F.last(heading, ignorenulls=True).over(Window.partitionBy("form").orderBy("line"))
    rows = lines.withColumn("section", section).withColumn("key", F.trim(F.regexp_extract("raw", r"^\s*[-*]?\s*([^:#]+?)\s*:\s*(.+?)\s*$", 1))).withColumn("value", F.regexp_extract("raw", r"^\s*[-*]?\s*([^:#]+?)\s*:\s*(.+?)\s*$", 2))
    return rows.where("key <> ''").select("form", "line", "section", "key", "value")


# ------------------------------------------------------------ rules

def strengthened(texts: DataFrame, cited: DataFrame) -> DataFrame:
    """(unit, concepts): concepts of a text that nothing it cites has. texts: unit, concepts; cited: unit, concepts (one row for each cited item)."""
    seen = cited.groupBy("unit").agg(F.array_distinct(F.flatten(F.collect_list("concepts"))).alias("seen"))
    extra = F.array_sort(F.array_except("concepts", F.coalesce("seen", F.array().cast("array<string>"))))
    return texts.join(seen, "unit", "left").select("unit", extra.alias("concepts")).where("size(concepts) > 0")


def critic_problems(units: DataFrame, reviewed: DataFrame, words_per_claim: int = 30) -> DataFrame:
    """(script, problem): a review whose units are others or in another order, findings without severity, too few claims.

    units: script, place, unit, words; reviewed: script, place, unit, claims, problems, unrated.
    """
    ordered = lambda df, n: df.groupBy("script").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "unit"))), lambda x: x["unit"]).alias(n))
    totals = units.groupBy("script").agg(F.sum("words").alias("words"))
    given = reviewed.groupBy("script").agg(F.sum("claims").alias("claims"), F.sum("unrated").alias("unrated"))
    both = ordered(units, "want").join(totals, "script").join(ordered(reviewed, "have"), "script", "left").join(given, "script", "left")
    cases = F.array(F.when(~F.col("want").eqNullSafe(F.col("have")), "UNITS"), F.when(F.col("unrated") > 0, "SEVERITY"), F.when(F.coalesce("claims", F.lit(0)) * words_per_claim < F.col("words"), "DENSITY"))
    return both.select("script", F.explode(F.filter(cases, lambda x: x.isNotNull())).alias("problem"))


def answered_once(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """(key, n): keys that are not answered exactly once, and answers to what nobody asked. Both: key."""
    n = answers.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    both = asked.select("key", F.lit(True).alias("asked")).distinct().join(n, "key", "full")
    return both.where(F.col("asked").isNull() | F.coalesce(F.col("n") != 1, F.lit(True))).select("key", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def applied_patches(units: DataFrame, patches: DataFrame) -> DataFrame:
    """(unit, text) after each unit's patches in order. units: unit, text; patches: unit, seq, old, new. A patch whose old text does not occur exactly once then is an error."""
    listed = patches.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("seq", "old", "new"))).alias("p"))
    once = lambda t, p: (F.length(t) - F.length(F.replace(t, p["old"], F.lit("")))) == F.length(p["old"])
    step = lambda t, p: F.when((p["old"] != "") & once(t, p), F.replace(t, p["old"], p["new"])).otherwise(F.raise_error(F.lit("a patch does not apply exactly once")).cast("string"))
    return units.join(listed, "unit", "left").select("unit", F.when(F.col("p").isNull(), F.col("text")).otherwise(F.aggregate("p", F.col("text"), step)).alias("text"))


def edited_beats(beats: DataFrame, edits: DataFrame) -> DataFrame:
    """(plan, place, beat, words) after a review: dropped beats go, moved ones take their new place, resized ones their new length.

    beats: plan, place, beat, words; edits: plan, beat, action (DROP, MOVE, RESIZE), value. Places are numbered anew.
    """
    by = edits.groupBy("plan", "beat").agg(F.count_if(F.col("action") == "DROP").alias("drops"), F.max(F.when(F.col("action") == "MOVE", F.col("value"))).alias("to"), F.max(F.when(F.col("action") == "RESIZE", F.col("value"))).alias("size"))
    rows = beats.join(by, ["plan", "beat"], "left").where(F.coalesce("drops", F.lit(0)) == 0)
    order = Window.partitionBy("plan").orderBy(F.coalesce("to", "place"), F.col("to").isNull(), "place", "beat")
    return rows.select("plan", F.row_number().over(order).alias("place"), "beat", F.coalesce("size", "words").alias("words"))


def glossary_names(glossary: DataFrame, seen: DataFrame) -> DataFrame:
    """(key, display, source): the owner's entries as they are, then the first declaration of each further name.

    glossary: display; seen: seq, name. Names are one if they differ in case and spaces only; only Latin ones are taken.
    """
    key = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    owned = glossary.select(key(F.col("display")).alias("key"), "display", F.lit("OWNER").alias("source"))
    first = seen.where(latin_name(F.col("name"))).select(key(F.col("name")).alias("key"), F.struct("seq", "name").alias("at")).groupBy("key").agg(F.min("at").alias("at"))
    return owned.unionByName(first.join(owned.select("key"), "key", "left_anti").select("key", F.col("at.name").alias("display"), F.lit("BRIEF").alias("source")))


def glossary_drift(texts: DataFrame, glossary: DataFrame) -> DataFrame:
    """(unit, display, found): spellings of a glossary name that differ from it in case. texts: unit, text; glossary: display (a small table)."""
    hit = texts.join(F.broadcast(glossary), F.expr(r"lower(text) rlike concat('(?U)(?<!\\w)\\Q', lower(display), '\\E(?!\\w)')"))
    found = hit.select("unit", "display", F.explode(F.array_distinct(F.expr(r"regexp_extract_all(text, concat('(?iU)(?<!\\w)\\Q', display, '\\E(?!\\w)'), 0)"))).alias("found"))
    return found.where(F.col("found") != F.col("display"))


# ------------------------------------------------------------ classifications

def multiquery_verdict(recall: Column, success: Column, hit: Column, decomposed: Column, gates: Column, least: int = 10, collapse: float = -0.1) -> Column:
    eps = 1e-12
    up = [recall > eps, success > eps]
    return F.when(~gates | (decomposed < least), "NOT_EVALUABLE").when(up[0] & up[1] & (hit >= collapse - eps), "SUPPORTED").when(up[0] | up[1], "PARTIALLY_SUPPORTED").otherwise("NOT_SUPPORTED")


def depth_class(lost_share: Column, success_at_30: Column, deep_units: Column, units: Column, lost_above: float = 0.5, success_least: float = 0.5, deep_least: float = 0.25) -> Column:
    """Whether misses look like a matter of ordering (lost units were near, all are within 30), of depth, or of both."""
    ordering = F.coalesce(lost_share > lost_above, F.lit(False)) & (success_at_30 >= success_least - 1e-12)
    deep = (units > 0) & (deep_units >= (deep_least - 1e-12) * units)
    return F.when(ordering & deep, "MIXED").when(ordering, "ORDERING_CONSISTENT").when(deep, "DEEP_RELEVANCE_CONSISTENT").otherwise("MIXED_INCONCLUSIVE")


def enrichment(missing_share: Column, promoted_share: Column, least: float = 0.2) -> Column:
    known = missing_share.isNotNull() & promoted_share.isNotNull()
    return F.when(~known, "INSUFFICIENT_DATA").when(missing_share - promoted_share >= least - 1e-12, "ASSOCIATED").otherwise("NOT_CLEAR")


def probe_label(missing_ranks: Column) -> Column:
    """Whether all missing ranks are just beyond the first ten; an empty array is an error."""
    near = F.forall(missing_ranks, lambda r: r.between(11, 15))
    return F.when(F.size(missing_ranks) == 0, F.raise_error(F.lit("a failed probe misses something")).cast("string")).when(near, "NEAR_BOUNDARY_ORDERING").otherwise("MID_POOL_ORDERING")


def key_pool(requests: DataFrame, keys: int) -> DataFrame:
    """requests with `key`: round robin by arrival within a group. requests: group, seq."""
    return requests.withColumn("key", (F.row_number().over(Window.partitionBy("group").orderBy("seq")) - 1) % keys)


def fifo_admission(requests: DataFrame, slots: int, waiting: int) -> DataFrame:
    """(group, seq, outcome, start) of requests (group, seq, at, length): started at once, queued or rejected.

    `slots` run at a time and at most `waiting` wait, in order of arrival; a fold over each group's requests.
    """
    one = "struct<seq:bigint,outcome:string,start:double>"
    state = f"struct<ends:array<double>,queued:array<double>,out:array<{one}>>"

    def step(s: Column, r: Column) -> Column:
        at = r["at"]
        busy = F.array_sort(F.filter(s["ends"], lambda e: e > at))
        line = F.filter(s["queued"], lambda q: q > at)
        free, room = F.size(busy) < slots, F.size(line) < waiting
        start = F.when(free, at).otherwise(F.element_at(busy, F.greatest(F.size(busy) - slots + 1, F.lit(1))))
        taken = free | room
        row = F.struct(r["seq"].alias("seq"), F.when(free, "STARTED").when(room, "QUEUED").otherwise("REJECTED").alias("outcome"), F.when(taken, start).alias("start")).cast(one)
        ends = F.when(taken, F.concat(busy, F.array(start + r["length"]))).otherwise(busy)
        queued = F.when(~free & room, F.concat(line, F.array(start))).otherwise(line)
        return F.struct(ends.alias("ends"), queued.alias("queued"), F.concat(s["out"], F.array(row)).alias("out")).cast(state)

    begin = F.struct(F.array().cast("array<double>").alias("ends"), F.array().cast("array<double>").alias("queued"), F.array().cast(f"array<{one}>").alias("out")).cast(state)
    row = F.struct(F.col("at").cast("double").alias("at"), F.col("seq").cast("long").alias("seq"), F.col("length").cast("double").alias("length"))
    folded = requests.groupBy("group").agg(F.aggregate(F.array_sort(F.collect_list(row)), begin, step, lambda s: s["out"]).alias("o"))
    return folded.select("group", F.explode("o").alias("r")).select("group", "r.*")
