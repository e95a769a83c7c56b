"""Rules and checks over text, graph, plan and evidence tables; each returns violations or a classification."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import let, nfkc
from .graph import stored

EPS = 1e-12
#: Character ranges of writing systems.
SCRIPTS = {"latin": "A-Za-zÀ-ɏḀ-ỿ", "cyrillic": "Ѐ-ӿ", "han": "㐀-䶿一-鿿", "kana": "぀-ヿ", "hangul": "가-힯", "thai": "฀-๿", "arabic": "؀-ۿ"}
#: Writing systems of languages.
LANGUAGE_SCRIPTS = {"en": ("latin",), "fr": ("latin",), "de": ("latin",), "es": ("latin",), "vi": ("latin",), "ru": ("cyrillic",), "ja": ("han", "kana"), "zh": ("han",), "ko": ("hangul", "han"), "th": ("thai",), "ar": ("arabic",)}
SPACELESS = ("ja", "zh", "th")


# ------------------------------------------------------------ text

def foreign_characters(text: Column, language: str) -> Column:
    """Characters of writing systems that a language does not use, in order."""
    other = "".join(r for n, r in SCRIPTS.items() if n not in LANGUAGE_SCRIPTS.get(language.split("-")[0].strip().lower(), ()))
    return F.regexp_extract_all(text, F.lit(f"[{other}]"), 0)


def text_length(text: Column, language: str) -> Column:
    """Words with a letter or digit, or characters for languages that do not space words."""
    if language.split("-")[0].lower() in SPACELESS:
        return F.length(F.regexp_replace(text, r"(?U)\s", ""))
    return F.size(F.filter(F.split(F.trim(text), r"(?U)\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]")))


def overlapping_starts(text: Column, needle: Column) -> Column:
    """All start offsets (from 0) at which a non-empty needle occurs, overlaps included."""
    last = F.length(text) - F.length(needle)
    at = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(text, i + 1, F.length(needle)) == needle)
    return F.when((F.length(needle) == 0) | (last < 0), F.array().cast("array<int>")).otherwise(at)


def locate_quotes(quotes: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(quote_id, paragraph): the first paragraph that holds a quote, whitespace aside; null where none does.

    quotes: unit, quote_id, quote; paragraphs: unit, paragraph, text.
    """
    squash = lambda c: F.regexp_replace(c, r"(?U)\s+", "")
    pairs = quotes.join(paragraphs, "unit").where((squash(F.col("quote")) != "") & F.contains(squash(F.col("text")), squash(F.col("quote"))))
    first = pairs.groupBy("quote_id").agg(F.min("paragraph").alias("paragraph"))
    return quotes.select("quote_id").join(first, "quote_id", "left")


#: Characters that stand for one another in quotes.
ALIKE = {"\"": "\"'“”„‟‘’‚‛«»「」『』", "-": "-‐‑‒–—―−", "~": "~〜～"}
_UNIFIED = {ord(c): k for k, every in ALIKE.items() for c in every}
_UNIT = re.compile(r"\.{2,3}|\S")


class Folded:
    """A text as comparable units, one character each, with the source character that each unit begins and ends in.

    Every source character is decomposed by itself (NFKD), so that positions stay known; a unit is what is not blank,
    a run of two or three dots being one. Marks that follow a character are put in the order of their classes.
    """

    def __init__(self, text: str):
        parts = [unicodedata.normalize("NFKD", c.translate(_UNIFIED)).translate(_UNIFIED) for c in text]
        owner = [i for i, p in enumerate(parts) for _ in p]
        units = [("…" if len(m[0]) > 1 else m[0], owner[m.start()], owner[m.end() - 1]) for m in _UNIT.finditer("".join(parts))]
        rank = [unicodedata.combining(u) for u, _, _ in units]
        base = 0
        for i, r in enumerate(rank):
            base = i if r == 0 else base
            rank[i] = (base, r)
        order = sorted(range(len(units)), key=lambda i: rank[i])
        self.units = "".join(units[i][0] for i in order)
        self.first, self.last = [units[i][1] for i in order], [units[i][2] for i in order]
        self.mark = [r > 0 for _, r in rank]

    def whole(self, a: int, b: int) -> bool:
        """Whether units a to b begin and end where source characters and their marks do."""
        starts = not self.mark[a] and (a == 0 or self.last[a - 1] < self.first[a])
        return starts and (b == len(self.units) or not self.mark[b] and self.last[b - 1] < self.first[b])


@F.pandas_udf(T.StructType([T.StructField("outcome", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
def resolve_quote(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
    """EXACT, RESOLVED_NORMALIZED, UNRESOLVED_MULTIPLE or UNRESOLVED_NO_MATCH, and the span in the text where there is one."""

    def spans(t: str, q: str) -> set[tuple[int, int]]:
        hay, needle = Folded(t), Folded(q).units
        ends = ((m.start(), m.start() + len(needle)) for m in re.finditer(f"(?={re.escape(needle)})", hay.units)) if needle else ()
        return {(hay.first[a], hay.last[b - 1] + 1) for a, b in ends if hay.whole(a, b)}

    def outcome(t: str | None, q: str | None) -> tuple:
        if t and q and (at := t.find(q)) >= 0:
            return "EXACT", at, at + len(q)
        found = spans(t, q) if t and q else set()
        if len(found) == 1:
            return "RESOLVED_NORMALIZED", *found.pop()
        return "UNRESOLVED_MULTIPLE" if found else "UNRESOLVED_NO_MATCH", None, None

    return pd.DataFrame(map(outcome, text, quote), columns=["outcome", "start", "end"]).astype({"start": "Int32", "end": "Int32"})


def facets(question: Column, function_words: Sequence[str] = (), most: int = 8, least: int = 2) -> Column:
    """The question, then its sentences, clauses, listed items and range ends that hold enough content words, once each.

    An empty question is an error.
    """
    edge, none = F.lit(" .?!,;:"), F.array().cast("array<string>")
    ranges = (r"(?i)^(.*?)\bfrom\s+(.+?)\s+to\s+(.+)$", r"(?i)^(.*?)\bbetween\s+(.+?)\s+and\s+(.+)$")

    def some(items: Column) -> Column:
        return F.filter(F.transform(items, F.trim), lambda x: x != "")

    def ends(item: Column) -> Column:
        out = F.array(item)
        for p in reversed(ranges):
            lead, low, high = (F.trim(F.regexp_extract(item, p, i)) for i in (1, 2, 3))
            out = F.when(item.rlike(p), F.array(*(F.trim(F.concat_ws(" ", lead, x)) for x in (low, high)))).otherwise(out)
        return out

    def telling(x: Column) -> Column:
        words = F.regexp_extract_all(F.lower(x), F.lit(r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)?"), 0)
        return F.size(F.filter(words, lambda w: ~w.isin(*function_words) & ~w.rlike(r"^\p{Nd}+$"))) >= least

    def parts(whole: Column) -> Column:
        sentences = some(F.split(whole, r"(?<=[.?!]) "))
        bare = F.transform(sentences, lambda x: F.trim(F.regexp_replace(x, "^[^:]*:", "")))
        items = some(F.flatten(F.transform(bare, lambda x: F.split(x, "[,;]"))))
        found = F.concat(F.when(F.size(sentences) > 1, sentences).otherwise(none), bare, items, F.flatten(F.transform(items, ends)))
        found = F.filter(F.transform(found, lambda x: F.btrim(x, edge)), telling)
        same = lambda x, y: F.lower(F.btrim(x, edge)) == F.lower(F.btrim(y, edge))
        fresh = F.aggregate(F.concat(F.array(whole), found), none, lambda out, x: F.when(F.exists(out, lambda y: same(x, y)), out).otherwise(F.concat(out, F.array(x))))
        return F.when(whole == "", F.raise_error(F.lit("an empty question")).cast("array<string>")).otherwise(F.slice(fresh, 1, most))

    return let(F.trim(F.regexp_replace(nfkc(question), r"(?U)\s+", " ")), parts)


# ------------------------------------------------------------ evidence and fixtures

def minimal_hitting_sets(families: Sequence[Sequence]) -> list[list]:
    """All inclusion-minimal sets that meet every family, by size and then in order; none if a family is empty.

    Sets are bit masks. Family by family, every set so far that misses it is multiplied out by the family's members,
    and of the results only the minimal ones go on; nothing is enumerated beyond them.
    """
    names = sorted({x for f in families for x in f})
    bit = {x: 1 << i for i, x in enumerate(names)}
    partial = {0} if families else set()
    for family in families:
        own = [bit[x] for x in set(family)]
        grown = {s | b for s in partial for b in ([0] if any(s & m for m in own) else own)}
        least: list[int] = []
        for s in sorted(grown, key=int.bit_count):
            if all(s & t != t for t in least):
                least.append(s)
        partial = set(least)
    return sorted(([x for x in names if bit[x] & s] for s in partial), key=lambda x: (len(x), x))


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def minimal_hitting_sets_udf(families: pd.Series) -> pd.Series:
    return families.map(lambda f: minimal_hitting_sets([list(x) for x in f]))


def gold_coverage(gold: DataFrame, support: DataFrame) -> DataFrame:
    """(probe, set_index, problem): sets that miss a proposition, or hold an id without which they still hit all.

    gold: probe, set_index, ids; support: probe, proposition, ids.
    """
    families = support.groupBy("probe").agg(F.collect_list("ids").alias("families"))
    rows = gold.join(families, "probe")
    hits = lambda ids: F.forall("families", lambda f: F.arrays_overlap(f, ids))
    spare = F.exists("ids", lambda x: hits(F.array_remove(F.col("ids"), x)))
    problem = F.when(~hits(F.col("ids")), "MISSES_PROPOSITION").when(spare, "NOT_MINIMAL")
    return rows.select("probe", "set_index", problem.alias("problem")).where(F.col("problem").isNotNull())


def excerpt_mismatches(excerpts: DataFrame, texts: DataFrame) -> DataFrame:
    """Excerpts that are not the slice of their text. excerpts: id, doc, start, end, excerpt; texts: doc, text."""
    slice_ = F.expr("substring(text, cast(start + 1 as int), cast(`end` - start as int))")
    return excerpts.join(texts, "doc", "left").where(~(F.coalesce(slice_ == F.col("excerpt"), F.lit(False)))).select("id", "doc")


def field_mismatches(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, left, right) for each field of a matched pair that differs (null equals null); a missing partner shows as <missing>."""
    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias(name)) for f in fields)))
        return df.select(F.col(key), pairs.alias("p")).select(key, "p.field", f"p.{name}")

    both = long(left, "left").join(long(right, "right").withColumn("here", F.lit(True)), [key, "field"], "left")
    shown = F.when(F.col("here").isNull(), "<missing>").otherwise(F.col("right"))
    return both.where(F.col("here").isNull() | ~F.col("left").eqNullSafe(F.col("right"))).select(key, "field", "left", shown.alias("right"))


def partition_problems(parts: DataFrame, whole: DataFrame) -> DataFrame:
    """(id, problem): ids in several parts, in none, or in no whole. parts: part, id; whole: id."""
    counts = parts.groupBy("id").agg(F.count_distinct("part").alias("n"))
    both = whole.select("id", F.lit(True).alias("known")).join(counts, "id", "full")
    problem = F.when(F.col("known").isNull(), "UNKNOWN").when(F.col("n").isNull(), "UNCOVERED").when(F.col("n") > 1, "REPEATED")
    return both.select("id", problem.alias("problem")).where(F.col("problem").isNotNull())


def hash_mismatches(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, problem) of a file set against its manifest. files: path, sha256, size; manifest: path, sha256, size."""
    m = manifest.select("path", F.col("sha256").alias("want"), F.col("size").alias("want_size"))
    both = files.join(m, "path", "full")
    problem = F.when(F.col("sha256").isNull(), "MISSING").when(F.col("want").isNull(), "UNLISTED").when(F.col("sha256") != F.col("want"), "HASH").when(F.col("size") != F.col("want_size"), "SIZE")
    return both.select("path", problem.alias("problem")).where(F.col("problem").isNotNull())


def private_leaks(texts: DataFrame, forbidden: Sequence[str], pattern: str = "") -> DataFrame:
    """(id, leak): forbidden strings, or matches of a pattern, in texts. texts: id, text."""
    named = F.array(*(F.when(F.contains(F.col("text"), F.lit(x)), F.lit(x)) for x in forbidden)).cast("array<string>")
    found = F.filter(named, lambda x: x.isNotNull())
    if pattern:
        found = F.concat(found, F.regexp_extract_all("text", F.lit(pattern), 0))
    return texts.select("id", F.explode(F.array_distinct(found)).alias("leak"))


def forbidden_keys(documents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(id, key): forbidden keys at any depth of JSON documents. documents: id, document."""
    names = F.array_distinct(F.transform(F.regexp_extract_all("document", F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), 1), lambda k: k))
    return documents.select("id", F.explode(F.array_intersect(names, F.array(*map(F.lit, keys)))).alias("key"))


# ------------------------------------------------------------ graph rules

def support_problems(assertions: DataFrame, derivations: DataFrame) -> DataFrame:
    """(assertion, problem) of derivations: unknown rule or premise, itself or a rejected assertion as a premise.

    assertions: assertion, rejected; derivations: assertion, derivation, rule_known, premise.
    """
    p = assertions.select(F.col("assertion").alias("premise"), F.col("rejected").alias("premise_rejected"))
    rows = derivations.join(p, "premise", "left")
    kinds = F.array(F.when(~F.col("rule_known"), "UNREGISTERED_RULE"), F.when(F.col("premise_rejected").isNull(), "UNKNOWN_PREMISE"), F.when(F.col("premise") == F.col("assertion"), "OWN_PREMISE"), F.when(F.col("premise_rejected"), "REJECTED_PREMISE"))
    return rows.select("assertion", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("problem")).distinct()


def status_problems(assertions: DataFrame, caps: DataFrame) -> DataFrame:
    """Assertions whose status exceeds what their derivations allow: the best over derivations of the least of cap and premises.

    assertions: assertion, status (rank), direct; caps: assertion, derivation, cap (rank), premise_status (rank).
    """
    per = caps.groupBy("assertion", "derivation").agg(F.least(F.min("cap"), F.min("premise_status")).alias("c")).groupBy("assertion").agg(F.max("c").alias("allowed"))
    return assertions.where(~F.col("direct")).join(per, "assertion").where(F.col("status") > F.col("allowed")).select("assertion", "status", "allowed")


def repeated_propositions(arguments: DataFrame) -> DataFrame:
    """Signatures that several propositions share; placeholders (null predicate) never equal. arguments: proposition, predicate, name, value."""
    entry = F.struct("name", "value")
    per = arguments.where(F.col("predicate").isNotNull()).groupBy("proposition", "predicate").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("args"))
    return per.groupBy("predicate", "args").agg(F.array_sort(F.collect_list("proposition")).alias("propositions")).where(F.size("propositions") > 1)


def embedding_closure(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(a, b): all propositions b embedded, at any depth, in a. edges: a, b. Ends on circles too.

    Each round joins the reach so far with itself, so that depth doubles; an error beyond most_rounds.
    """
    reach = stored(edges.select("a", "b").distinct())
    size = reach.count()
    for _ in range(most_rounds):
        further = reach.alias("x").join(reach.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b")
        reach = stored(reach.unionByName(further).distinct())
        before, size = size, reach.count()
        if size == before:
            return reach
    raise ValueError("propositions are embedded too deeply")


def span_set_relation(predicted: Column, gold: Column) -> Column:
    """MATCH, SUBSET or MISMATCH of two arrays of (start, end): every predicted span holds some gold one, and all gold are held."""
    inside = lambda p, g: (p["start"] <= g["start"]) & (g["end"] <= p["end"])
    sound = F.forall(predicted, lambda p: F.exists(gold, lambda g: inside(p, g)))
    full = F.forall(gold, lambda g: F.exists(predicted, lambda p: inside(p, g)))
    return F.when(~sound, "MISMATCH").when(full, "MATCH").otherwise("SUBSET")


def resolve_mentions(references: DataFrame, mentions: DataFrame) -> DataFrame:
    """(mention, resolution): RESOLVED, AMBIGUOUS or UNRESOLVED by the distinct classes it refers to. references: mention, root."""
    n = references.groupBy("mention").agg(F.count_distinct("root").alias("n"))
    return mentions.select("mention").join(n, "mention", "left").select("mention", F.when(F.col("n") == 1, "RESOLVED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("UNRESOLVED").alias("resolution"))


# ------------------------------------------------------------ plans, patches, verdicts

def least_events(characters: Column, per_event: int) -> Column:
    return F.greatest(F.lit(2), F.ceil(characters / per_event).cast("int"))


def pacing(beats: DataFrame) -> DataFrame:
    """(beat, kind): core beats with under half the mean words per event, and beats over a quarter of all words without weight.

    beats: plan, beat, words, events, core (holds a core event), minor (no event, or minor ones only).
    """
    whole = Window.partitionBy("plan")
    rows = beats.withColumn("total", F.sum("words").over(whole)).withColumn("mean", F.sum("words").over(whole) / F.greatest(F.sum("events").over(whole), F.lit(1)))
    kinds = F.array(F.when(F.col("core") & (F.col("words") / F.col("events") < 0.5 * F.col("mean")), "CORE_THIN"), F.when(F.col("minor") & (F.col("words") / F.col("total") > 0.25), "MINOR_HEAVY"))
    return rows.select("plan", "beat", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("kind"))


def patch_problems(patches: DataFrame, texts: DataFrame) -> DataFrame:
    """(patch, occurrences) of patches whose old text does not occur exactly once. patches: patch, unit, old; texts: unit, text."""
    n = F.when(F.length("old") > 0, (F.length("text") - F.length(F.replace(F.col("text"), F.col("old"), F.lit("")))) / F.length("old")).otherwise(0).cast("int")
    return patches.join(texts, "unit", "left").select("patch", F.coalesce(n, F.lit(0)).alias("occurrences")).where("occurrences <> 1")


def consensus_verdict(success: Column, recall: Column, hit: Column, gained: Column, lost: Column, gates: Column) -> Column:
    """Verdict on three differences: all must not fall, success must rise, and more must be won than lost."""
    support = (success > EPS) & (recall >= -EPS) & (hit >= -EPS) & (gained > lost)
    return F.when(~gates, "NOT_EVALUABLE").when(support, "SUPPORTED").when((success > EPS) | (recall > EPS) | (hit > EPS), "PARTIALLY_SUPPORTED").otherwise("NOT_SUPPORTED")


def layer_passes(cases: DataFrame, layers: dict[str, Sequence[str]]) -> DataFrame:
    """One row: per layer, the cases that are valid and show none of its failure codes. cases: valid, codes (array)."""
    return cases.agg(*(F.count_if(F.col("valid") & ~F.arrays_overlap("codes", F.array(*map(F.lit, codes)))).alias(name) for name, codes in layers.items()))


def first_by_criteria(candidates: DataFrame, criteria: Sequence[tuple[str, bool]], tie: str) -> DataFrame:
    """The candidate that is best by ordered criteria (column, whether larger is better); ties by name."""
    return candidates.orderBy(*(F.desc(c) if larger else F.asc(c) for c, larger in criteria), tie).limit(1)


def latest_per_generation(models: DataFrame) -> DataFrame:
    """(role, model): the latest, the latest of the generation before, and the latest light model. models: model, version (array), light."""
    generation = F.slice("version", 1, 2)
    full = models.where(~F.col("light")).withColumn("generation", generation)
    best = full.withColumn("n", F.row_number().over(Window.partitionBy("generation").orderBy(F.desc("version"), "model"))).where("n = 1")
    ranked = best.withColumn("n", F.row_number().over(Window.orderBy(F.desc("generation")))).where("n <= 2")
    light = models.where("light").withColumn("n", F.row_number().over(Window.orderBy(F.desc("version"), "model"))).where("n = 1")
    return ranked.select(F.when(F.col("n") == 1, "LATEST").otherwise("PREVIOUS").alias("role"), "model").unionByName(light.select(F.lit("LIGHT").alias("role"), "model"))


def line_coverage(changed: DataFrame, executable: DataFrame, executed: DataFrame) -> DataFrame:
    """(file, lines, covered, share) of changed executable lines. All: file, line."""
    lines = changed.join(executable, ["file", "line"], "left_semi").distinct()
    hit = executed.distinct().withColumn("hit", F.lit(1))
    rows = lines.join(hit, ["file", "line"], "left")
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count("hit").alias("covered"), F.round(F.count("hit") / F.count(F.lit(1)), 6).alias("share"))
