"""Registered queries over the rules, diagnostics and memory operators, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import diagnostics as dg
from ..operators import evaluation as ev
from ..operators import graph as gr
from ..operators import memory as me
from ..operators import retrieval as rt
from ..operators import rules as ru
from . import catalog
from .catalog import DENSE, LINES, METRICS, STATED, WINDOWS, query

C = F.col
X = F.expr


# ---------------------------------------------------------------- text

FOREIGN = "[" + "".join(r for n, r in ru.SCRIPTS.items() if n != "cyrillic") + "]"


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{FOREIGN}'))::INTEGER AS n, sha256(array_to_string(regexp_extract_all(text, '{FOREIGN}'), '')) AS sha FROM documents")
def foreign_script(spark, t):
    """Characters that Russian does not use."""
    return t("documents").select("doc_id", ru.foreign_characters(C("text"), "ru").alias("f")).select("doc_id", F.size("f").alias("n"), F.sha2(F.array_join("f", ""), 256).alias("sha"))


@query(r"SELECT doc_id, len(list_filter(string_split_regex(trim(text), '\s+'), lambda w: regexp_matches(w, '[\p{L}\p{N}]')))::INTEGER AS words, length(regexp_replace(text, '\s', '', 'g'))::INTEGER AS characters FROM documents")
def text_lengths(spark, t):
    """Words where a language spaces them, characters where it does not."""
    return t("documents").select("doc_id", ru.text_length(C("text"), "en").alias("words"), ru.text_length(C("text"), "ja").alias("characters"))


@query("SELECT p_partkey, list_filter(range(0, length(p_name)), lambda i: substr(p_name, i + 1, 2) = substr(p_name, 2, 2)) AS starts FROM part")
def overlapping_occurrences(spark, t):
    """All places where the second and third character of a name stand, overlaps included."""
    return t("part").select("p_partkey", ru.overlapping_starts(C("p_name"), F.substring("p_name", 2, 2)).cast("array<bigint>").alias("starts"))


@query(r"""WITH q AS (SELECT conv_id, turn, regexp_replace(substr(text, 11, 25), '\s+', '', 'g') AS n FROM conversations), p AS (SELECT conv_id, turn, regexp_replace(text, '\s+', '', 'g') AS x FROM conversations)
    SELECT q.conv_id * 1000 + q.turn AS quote_id, min(p.turn) AS paragraph FROM q LEFT JOIN p ON p.conv_id = q.conv_id AND q.n <> '' AND contains(p.x, q.n) GROUP BY 1""")
def quote_location(spark, t):
    """The first turn of the conversation that holds a quote, whitespace aside."""
    c = t("conversations")
    quotes = c.select(C("conv_id").alias("unit"), X("conv_id * 1000 + turn").alias("quote_id"), F.substring("text", 11, 25).alias("quote"))
    return ru.locate_quotes(quotes, c.select(C("conv_id").alias("unit"), C("turn").alias("paragraph"), "text"))


@query("""WITH q AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN '#~#' ELSE '' END || substr(text, 5, 30) AS q FROM documents)
    SELECT doc_id, CASE WHEN strpos(text, q) > 0 AND q <> '' THEN 'EXACT' ELSE 'UNRESOLVED_NO_MATCH' END AS outcome, CASE WHEN strpos(text, q) > 0 AND q <> '' THEN strpos(text, q) - 1 END::INTEGER AS first, CASE WHEN strpos(text, q) > 0 AND q <> '' THEN strpos(text, q) - 1 + length(q) END::INTEGER AS past FROM q""")
def quote_resolution(spark, t):
    """Quotes with their place in the text, and altered ones without."""
    rows = t("documents").select("doc_id", ru.resolve_quote(C("text"), X("concat(if(doc_id % 3 = 0, '#~#', ''), substring(text, 5, 30))")).alias("r"))
    return rows.select("doc_id", "r.outcome", C("r.start").alias("first"), C("r.end").alias("past"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+') AS w FROM documents)
    SELECT doc_id, (greatest(2 * len(w) - 1, 0))::INTEGER AS n, sha256(array_to_string(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])), ' ')) AS sha FROM w""")
def latin_terms(spark, t):
    """Words and pairs of neighbours."""
    return t("documents").select("doc_id", tx.latin_tokens(C("text")).alias("w")).select("doc_id", F.size("w").alias("n"), F.sha2(F.array_join("w", " "), 256).alias("sha"))


@query(r"""SELECT p_partkey, list_transform(regexp_extract_all(p_name || '-' || p_partkey, '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(CAST(length(regexp_replace(p, '^0+([0-9])', '\1')) AS VARCHAR), 4, '0') || regexp_replace(p, '^0+([0-9])', '\1') ELSE p END) AS key FROM part""")
def natural_order_keys(spark, t):
    """Keys that order digit runs by value."""
    return t("part").select("p_partkey", tx.natural_key(F.concat_ws("-", "p_name", C("p_partkey").cast("string"))).alias("key"))


BIGRAMS = r"list_distinct(list_transform(range(1, length(regexp_replace(lower({0}), '\s+', '', 'g'))), lambda i: substr(regexp_replace(lower({0}), '\s+', '', 'g'), i, 2)))"


@query(f"WITH b AS (SELECT a.p_partkey AS x, b.p_partkey AS y, {BIGRAMS.format('a.p_name')} AS u, {BIGRAMS.format('b.p_name')} AS v FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1) SELECT x, y, round(CASE WHEN len(u) = 0 OR len(v) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(u, v)) / (len(u) + len(v)) END, 9)::DOUBLE AS dice FROM b")
def name_similarity(spark, t):
    """Dice similarity of neighbouring names' character pairs."""
    a = t("part").select(C("p_partkey").alias("x"), tx.bigram_set(C("p_name")).alias("u"))
    b = t("part").select(C("p_partkey").alias("y"), tx.bigram_set(C("p_name")).alias("v"))
    return a.join(b, X("y = x + 1")).select("x", "y", F.round(tx.dice(C("u"), C("v")), 9).alias("dice"))


LEXICON = (("WOOD", "le"), ("WOOD", "der"), ("STONE", "the"), ("STONE", "que"), ("RIVER", "an"))


@query(r"WITH x(concept, phrase) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in LEXICON) + r") SELECT doc_id AS id, list_sort(list(DISTINCT concept)) AS concepts FROM documents JOIN x ON regexp_matches(lower(text), '(^|[^\p{L}\p{N}])' || phrase || '($|[^\p{L}\p{N}])') GROUP BY doc_id")
def concept_lexicon(spark, t):
    """Concepts whose phrases stand in a text at word boundaries."""
    return me.concept_hits(t("documents").select(C("doc_id").alias("id"), "text"), spark.createDataFrame(LEXICON, "concept string, phrase string"))


# ---------------------------------------------------------------- evidence and artifacts



@query("""WITH f AS (SELECT p_partkey AS probe, (1 << (p_partkey % 3)) | (1 << (3 + p_partkey % 2)) AS f1, (1 << (p_partkey % 5)) | 2 AS f2, (1 << ((p_partkey // 5) % 6)) | 4 AS f3 FROM part),
    m AS (SELECT probe, f1, f2, f3, unnest(range(1, 64)) AS m FROM f), h AS (SELECT probe, m FROM m WHERE m & f1 <> 0 AND m & f2 <> 0 AND m & f3 <> 0),
    k AS (SELECT h.probe, h.m FROM h WHERE NOT EXISTS (SELECT 1 FROM h s WHERE s.probe = h.probe AND s.m <> h.m AND s.m & h.m = s.m))
    SELECT probe, list(x ORDER BY x) AS sets FROM (SELECT probe, array_to_string(list_filter(['0', '1', '2', '3', '4', '5'], lambda d: m & (1 << CAST(d AS INTEGER)) <> 0), '+') AS x FROM k) GROUP BY probe""")
def hitting_sets(spark, t):
    """Minimal sets that meet three families of alternatives."""
    families = F.array(*(F.array_sort(F.array_distinct(F.array(*(X(f"cast({e} as string)") for e in pair)))) for pair in (("p_partkey % 3", "3 + p_partkey % 2"), ("p_partkey % 5", "1"), ("(p_partkey div 5) % 6", "2"))))
    return t("part").select(C("p_partkey").alias("probe"), ru.minimal_hitting_sets_udf(families).alias("s")).select("probe", F.array_sort(F.transform("s", lambda x: F.array_join(x, "+"))).alias("sets"))


@query("""WITH g AS (SELECT p_partkey AS probe, 0 AS set_index, [p_partkey % 3, 3 + p_partkey % 4] AS ids FROM part UNION ALL SELECT p_partkey, 1, [p_partkey % 2, 5] FROM part),
    s AS (SELECT p_partkey AS probe, [p_partkey % 3, 9] AS ids FROM part UNION ALL SELECT p_partkey, [3 + p_partkey % 2, 5] FROM part),
    h AS (SELECT g.probe, g.set_index, g.ids, min(CASE WHEN list_has_any(s.ids, g.ids) THEN 1 ELSE 0 END) AS hits, max(CASE WHEN true THEN 1 END) AS o FROM g JOIN s USING (probe) GROUP BY ALL),
    l AS (SELECT h.probe, h.set_index, h.ids, h.hits, x FROM h, (SELECT unnest([1, 2]) AS x)),
    m AS (SELECT l.probe, l.set_index, l.x, min(l.hits) AS hits, min(CASE WHEN list_has_any(s.ids, list_filter(l.ids, lambda v: v <> l.ids[l.x])) THEN 1 ELSE 0 END) AS spare FROM l JOIN s USING (probe) GROUP BY ALL)
    SELECT probe, CAST(set_index AS INTEGER) AS set_index, CASE WHEN min(hits) = 0 THEN 'MISSES_PROPOSITION' ELSE 'NOT_MINIMAL' END AS problem FROM m GROUP BY probe, set_index HAVING min(hits) = 0 OR max(spare) = 1""")
def evidence_set_problems(spark, t):
    """Evidence sets that miss a proposition, or are larger than they need be."""
    p = t("part").select(C("p_partkey").alias("probe"))
    gold = p.select("probe", F.lit(0).alias("set_index"), X("array(probe % 3, 3 + probe % 4)").alias("ids")).unionByName(p.select("probe", F.lit(1).alias("set_index"), X("array(probe % 2, 5L)").alias("ids")))
    support = p.select("probe", F.lit(1).alias("proposition"), X("array(probe % 3, 9L)").alias("ids")).unionByName(p.select("probe", F.lit(2).alias("proposition"), X("array(3 + probe % 2, 5L)").alias("ids")))
    return ru.gold_coverage(gold, support)


@query("SELECT doc_id AS id, doc_id AS doc FROM documents WHERE substr(text, CAST(doc_id % 50 + 1 AS INTEGER), 10) <> CASE WHEN doc_id % 3 = 0 THEN '#' ELSE '' END || substr(text, CAST(doc_id % 50 + 1 AS INTEGER), 10)")
def excerpt_check(spark, t):
    """Excerpts that are not the slice of their text."""
    d = t("documents")
    e = d.select(C("doc_id").alias("id"), C("doc_id").alias("doc"), X("doc_id % 50").alias("start"), X("doc_id % 50 + 10").alias("end"), X("concat(if(doc_id % 3 = 0, '#', ''), substring(text, cast(doc_id % 50 + 1 as int), 10))").alias("excerpt"))
    return ru.excerpt_mismatches(e, d.select(C("doc_id").alias("doc"), "text"))


@query("""WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders WHERE o_orderkey % 7 <> 0)
    SELECT o_orderkey, 'status' AS field, o_orderstatus AS "left", CASE WHEN k IS NULL THEN '<missing>' ELSE s END AS "right" FROM orders LEFT JOIN r ON k = o_orderkey WHERE k IS NULL OR o_orderstatus IS DISTINCT FROM s
    UNION ALL SELECT o_orderkey, 'priority', o_orderpriority, CASE WHEN k IS NULL THEN '<missing>' ELSE p END FROM orders LEFT JOIN r ON k = o_orderkey WHERE k IS NULL OR o_orderpriority IS DISTINCT FROM p""")
def artifact_comparison(spark, t):
    """Fields that differ between two versions of a table, and rows that only the first has."""
    o = t("orders").select("o_orderkey", C("o_orderstatus").alias("status"), C("o_orderpriority").alias("priority"))
    changed = o.where("o_orderkey % 7 <> 0").select("o_orderkey", X("if(o_orderkey % 5 = 0, 'X', status)").alias("status"), X("if(o_orderkey % 4 = 0, null, priority)").alias("priority"))
    return ru.field_mismatches(o, changed, "o_orderkey", ("status", "priority"))


@query("""WITH c AS (SELECT l_partkey AS id, count(DISTINCT l_suppkey % 5) AS n FROM lineitem GROUP BY 1), w AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 10 <> 0)
    SELECT coalesce(w.id, c.id) AS id, CASE WHEN w.id IS NULL THEN 'UNKNOWN' WHEN n IS NULL THEN 'UNCOVERED' ELSE 'REPEATED' END AS problem FROM w FULL JOIN c ON w.id = c.id WHERE w.id IS NULL OR n IS NULL OR n > 1""")
def partition_check(spark, t):
    """Ids in several parts, in none, or in no whole."""
    return ru.partition_problems(t("lineitem").select(X("l_suppkey % 5").alias("part"), C("l_partkey").alias("id")), t("part").where("p_partkey % 10 <> 0").select(C("p_partkey").alias("id")))


@query("""WITH f AS (SELECT CAST(page_id AS VARCHAR) AS path, sha256(html) AS h, octet_length(encode(html)) AS z FROM pages WHERE page_id % 11 <> 0), m AS (SELECT CAST(page_id AS VARCHAR) AS path, sha256(CASE WHEN page_id % 5 = 0 THEN 'x' ELSE html END) AS h, octet_length(encode(html)) + CASE WHEN page_id % 4 = 0 THEN 1 ELSE 0 END AS z FROM pages WHERE page_id % 13 <> 0)
    SELECT coalesce(f.path, m.path) AS path, CASE WHEN f.path IS NULL THEN 'MISSING' WHEN m.path IS NULL THEN 'UNLISTED' WHEN f.h <> m.h THEN 'HASH' ELSE 'SIZE' END AS problem FROM f FULL JOIN m ON f.path = m.path WHERE f.path IS NULL OR m.path IS NULL OR f.h <> m.h OR f.z <> m.z""")
def file_set_check(spark, t):
    """Files against a manifest of digests and sizes."""
    p = t("pages")
    files = p.where("page_id % 11 <> 0").select(X("cast(page_id as string)").alias("path"), F.sha2("html", 256).alias("sha256"), F.octet_length("html").alias("size"))
    manifest = p.where("page_id % 13 <> 0").select(X("cast(page_id as string)").alias("path"), F.sha2(X("if(page_id % 5 = 0, 'x', html)"), 256).alias("sha256"), X("octet_length(html) + if(page_id % 4 = 0, 1, 0)").alias("size"))
    return ru.hash_mismatches(files, manifest)


@query(r"SELECT doc_id AS id, unnest(list_distinct(list_concat(list_filter([CASE WHEN contains(text, 'GNU') THEN 'GNU' END, CASE WHEN contains(text, 'MIT') THEN 'MIT' END], lambda x: x IS NOT NULL), regexp_extract_all(text, '[0-9]{4,}')))) AS leak FROM documents")
def private_content(spark, t):
    """Forbidden strings and patterns in texts."""
    return ru.private_leaks(t("documents").select(C("doc_id").alias("id"), "text"), ("GNU", "MIT"), "[0-9]{4,}")


@query("""SELECT event_id AS id, 'k' AS key FROM events WHERE contains(props, '"k":') UNION ALL SELECT event_id, 'gold' FROM events WHERE contains(props, '"gold":')""")
def forbidden_json_keys(spark, t):
    return ru.forbidden_keys(t("events").select(C("event_id").alias("id"), C("props").alias("document")), ("gold", "k", "answer"))


# ---------------------------------------------------------------- the assertion graph

@query("""WITH a AS (SELECT vec_id AS id, vec_id % 13 = 0 AS rejected FROM embeddings), d AS (SELECT vec_id AS id, vec_id % 4 <> 0 AS known, CASE WHEN vec_id % 6 = 0 THEN vec_id WHEN vec_id % 9 = 0 THEN vec_id + 1000000 ELSE vec_id // 2 END AS premise FROM embeddings),
    r AS (SELECT d.*, a.rejected FROM d LEFT JOIN a ON a.id = d.premise)
    SELECT id AS assertion, unnest(list_filter([CASE WHEN NOT known THEN 'UNREGISTERED_RULE' END, CASE WHEN rejected IS NULL THEN 'UNKNOWN_PREMISE' END, CASE WHEN premise = id THEN 'OWN_PREMISE' END, CASE WHEN rejected THEN 'REJECTED_PREMISE' END], lambda x: x IS NOT NULL)) AS problem FROM r""")
def derivation_problems(spark, t):
    """Derivations with unknown rules, or with unknown, own or rejected premises."""
    v = t("embeddings").select(C("vec_id").alias("assertion"))
    d = v.select("assertion", F.lit(1).alias("derivation"), X("assertion % 4 <> 0").alias("rule_known"), X("case when assertion % 6 = 0 then assertion when assertion % 9 = 0 then assertion + 1000000 else assertion div 2 end").alias("premise"))
    return ru.support_problems(v.withColumn("rejected", X("assertion % 13 = 0")), d)


@query("""WITH c AS (SELECT l_orderkey AS assertion, l_suppkey % 3 AS derivation, min(l_linenumber) AS cap, min(l_partkey % 5) AS premise FROM lineitem GROUP BY 1, 2), p AS (SELECT assertion, max(least(cap, premise)) AS allowed FROM c GROUP BY 1)
    SELECT assertion, CAST(assertion % 5 AS BIGINT) AS status, CAST(allowed AS BIGINT) AS allowed FROM p WHERE assertion % 2 = 0 AND assertion % 5 > allowed""")
def status_caps(spark, t):
    """Statuses above what the derivations allow."""
    caps = t("lineitem").select(C("l_orderkey").alias("assertion"), X("l_suppkey % 3").alias("derivation"), C("l_linenumber").cast("long").alias("cap"), X("l_partkey % 5").alias("premise_status"))
    a = t("lineitem").select(C("l_orderkey").alias("assertion")).distinct().select("assertion", X("assertion % 5").alias("status"), X("assertion % 2 = 1").alias("direct"))
    return ru.status_problems(a, caps)


@query("""WITH p AS (SELECT o_orderkey AS proposition, o_orderstatus AS predicate, list({'n': l_linenumber, 'v': l_returnflag} ORDER BY l_linenumber, l_returnflag) AS args FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 10 <> 0 GROUP BY 1, 2)
    SELECT predicate, count(*) AS n, min(proposition) AS first, max(proposition) AS last FROM p GROUP BY predicate, args HAVING count(*) > 1""")
def shared_signatures(spark, t):
    """Groups of propositions with one predicate and the same arguments; placeholders never equal."""
    rows = t("orders").join(t("lineitem"), X("l_orderkey = o_orderkey")).select(C("o_orderkey").alias("proposition"), X("if(o_orderkey % 10 = 0, null, o_orderstatus)").alias("predicate"), C("l_linenumber").alias("name"), C("l_returnflag").alias("value"))
    return ru.repeated_propositions(rows).select("predicate", F.size("propositions").cast("long").alias("n"), F.array_min("propositions").alias("first"), F.array_max("propositions").alias("last"))


@query("WITH RECURSIVE e AS (SELECT vec_id AS a, vec_id // 3 AS b FROM embeddings WHERE vec_id % 7 <> 0), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a, b FROM c")
def embedded_propositions(spark, t):
    """All propositions embedded in each, at any depth."""
    return ru.embedding_closure(t("embeddings").where("vec_id % 7 <> 0").select(C("vec_id").alias("a"), X("vec_id div 3").alias("b")))


@query("WITH RECURSIVE e AS (SELECT vec_id AS a, (vec_id * 3 + 1) % 101 AS b FROM embeddings), c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a AS assertion FROM c WHERE a = b")
def circular_support(spark, t):
    """Assertions that support themselves."""
    return gr.circular(t("embeddings").select(C("vec_id").alias("assertion"), X("(vec_id * 3 + 1) % 101").alias("premise")))


RELATION = "SELECT o_orderkey AS k, list({'s': l_linenumber * 10, 'e': l_linenumber * 10 + CAST(l_quantity AS INTEGER) // 5 + 4}) FILTER (l_linenumber % 2 = 1) AS p, list({'s': l_linenumber * 10 + 1, 'e': l_linenumber * 10 + 1 + l_partkey % 8}) FILTER (l_linenumber % 3 <> 0) AS g FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"


@query(f"WITH r AS ({RELATION}), q AS (SELECT k, list_filter(p, lambda x: len(list_filter(g, lambda y: x.s <= y.s AND y.e <= x.e)) > 0) AS sound, list_filter(g, lambda y: len(list_filter(p, lambda x: x.s <= y.s AND y.e <= x.e)) > 0) AS every, p, g FROM r WHERE p IS NOT NULL AND g IS NOT NULL) SELECT k, CASE WHEN len(sound) < len(p) THEN 'MISMATCH' WHEN len(every) = len(g) THEN 'MATCH' ELSE 'SUBSET' END AS relation FROM q")
def span_set_relations(spark, t):
    """Whether predicted spans hold gold spans, and all of them."""
    rows = t("lineitem").groupBy(C("l_orderkey").alias("k")).agg(
        F.collect_list(F.when(X("l_linenumber % 2 = 1"), F.struct(X("l_linenumber * 10").alias("start"), X("l_linenumber * 10 + cast(l_quantity as int) div 5 + 4").alias("end")))).alias("p"),
        F.collect_list(F.when(X("l_linenumber % 3 <> 0"), F.struct(X("l_linenumber * 10 + 1").alias("start"), X("l_linenumber * 10 + 1 + l_partkey % 8").alias("end")))).alias("g"),
    )
    return rows.where("size(p) > 0 and size(g) > 0").select("k", ru.span_set_relation(C("p"), C("g")).alias("relation"))


@query("SELECT p_partkey AS mention, CASE count(DISTINCT l_suppkey % 40) WHEN 0 THEN 'UNRESOLVED' WHEN 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS resolution FROM part LEFT JOIN lineitem ON l_partkey = p_partkey AND l_linenumber = 1 AND l_quantity > 20 GROUP BY 1")
def mention_resolution(spark, t):
    refs = t("lineitem").where("l_linenumber = 1 and l_quantity > 20").select(C("l_partkey").alias("mention"), X("l_suppkey % 40").alias("root"))
    return ru.resolve_mentions(refs, t("part").select(C("p_partkey").alias("mention")))


@query("SELECT content, list_extract(list_sort(list([p, q])), 1) AS position FROM (SELECT vec_id % 50 AS content, vec_id % 17 AS p, vec_id % 3 AS q FROM embeddings WHERE vec_id % 4 <> 0) GROUP BY content")
def commitment_positions(spark, t):
    """Least availability over committing assertions."""
    return dg.first_commitments(t("embeddings").select(X("vec_id % 50").alias("content"), X("vec_id % 4 <> 0").alias("commits"), X("array(vec_id % 17, vec_id % 3)").alias("available")))


@query("SELECT vec_id AS assertion FROM embeddings WHERE vec_id % 13 <> 0 AND [vec_id % 17, vec_id % 3] <= [9, 1]")
def visible_assertions(spark, t):
    """Assertions available at or before a position, rejected ones left out."""
    v = t("embeddings").select(C("vec_id").alias("assertion"), X("vec_id % 13 = 0").alias("rejected"), X("array(vec_id % 17, vec_id % 3)").alias("available"))
    return gr.visible(v, X("array(9L, 1L)")).select("assertion")


@query("""WITH a AS (SELECT doc_id, doc_id % 40 AS content, CASE WHEN quality = 1 THEN 'AFFIRMED' ELSE 'NEGATED' END AS polarity, CASE WHEN toxic = 1 THEN 'DENIES' ELSE 'BELIEVES' END AS kind FROM labels), s AS (SELECT range AS content, CASE range % 4 WHEN 0 THEN 'AFFIRMED' WHEN 1 THEN 'NEGATED' ELSE 'CONTESTED' END AS status FROM range(0, 35))
    SELECT doc_id AS holder, content, CASE WHEN kind <> 'BELIEVES' THEN kind WHEN polarity = status THEN 'KNOWS' WHEN status IN ('AFFIRMED', 'NEGATED') THEN 'MISTAKEN' ELSE 'UNRESOLVED_BELIEF' END AS verdict FROM a LEFT JOIN s USING (content)""")
def holder_knowledge(spark, t):
    """Whether a held content is known, mistaken or undecided."""
    a = t("labels").select(C("doc_id").alias("holder"), X("doc_id % 40").alias("content"), F.when(C("quality") == 1, "AFFIRMED").otherwise("NEGATED").alias("polarity"), F.when(C("toxic") == 1, "DENIES").otherwise("BELIEVES").alias("kind"))
    return gr.knowledge(a, spark.range(35).select(C("id").alias("content"), X("case id % 4 when 0 then 'AFFIRMED' when 1 then 'NEGATED' else 'CONTESTED' end").alias("status")))


@query("SELECT x.vec_id AS a, x.vec_id + 10 AS b, x.label AS root FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 10 WHERE x.label = y.label AND x.vec_id % 3 = 0")
def identity_breaks(spark, t):
    """Pairs said to differ that one class holds."""
    v = t("embeddings")
    return gr.identity_conflicts(v.select(C("vec_id").alias("node"), C("label").alias("root")), v.where("vec_id % 3 = 0").select(C("vec_id").alias("a"), X("vec_id + 10").alias("b")))


@query("""WITH m AS (SELECT vec_id, label, vec_id % 3 <> 0 AS ph FROM embeddings WHERE vec_id % 5 <> 0 OR label % 2 = 0)
    SELECT m.vec_id AS node, c.c > 0 AS resolved FROM m JOIN (SELECT label, count(*) FILTER (NOT ph AND vec_id % 2 = 0) AS c FROM m GROUP BY label) c USING (label) WHERE ph OR vec_id % 2 = 1""")
def placeholder_contents(spark, t):
    """Placeholders by whether their class holds a concrete member."""
    v = t("embeddings").where("vec_id % 5 <> 0 or label % 2 = 0")
    return dg.resolved_content(v.select(C("vec_id").alias("node"), C("label").alias("root")), v.select(C("vec_id").alias("node"), X("vec_id % 3 <> 0 or vec_id % 2 = 1").alias("placeholder")))


@query("SELECT vec_id AS assertion, CASE WHEN vec_id % 3 <> 0 AND [vec_id % 10] <= [5] THEN 'a' || vec_id ELSE 'OPEN' END AS start, CASE WHEN [vec_id % 7] <= [5] THEN 'b' || vec_id ELSE 'OPEN' END AS \"end\" FROM embeddings")
def validity_bounds(spark, t):
    """Bounds that are known by a position; the others are open."""
    rows = t("embeddings").select(C("vec_id").alias("assertion"), X("if(vec_id % 3 <> 0, concat('a', vec_id), null)").alias("start_anchor"), X("array(vec_id % 10)").alias("start_available"), X("concat('b', vec_id)").alias("end_anchor"), X("array(vec_id % 7)").alias("end_available"))
    return dg.shown_bounds(rows, X("array(5L)"))


# ---------------------------------------------------------------- plans, patches, verdicts

@query("""WITH b AS (SELECT o_custkey AS plan, o_orderkey AS beat, CAST(floor(o_totalprice) AS BIGINT) AS words, o_orderkey % 3 + 1 AS events FROM orders), t AS (SELECT *, sum(words) OVER w AS total, sum(words) OVER w / greatest(sum(events) OVER w, 1) AS mean FROM b WINDOW w AS (PARTITION BY plan))
    SELECT plan, beat, unnest(list_filter([CASE WHEN beat % 2 = 0 AND words / events < 0.5 * mean THEN 'CORE_THIN' END, CASE WHEN beat % 5 = 0 AND words / total > 0.25 THEN 'MINOR_HEAVY' END], lambda x: x IS NOT NULL)) AS kind FROM t""")
def beat_pacing(spark, t):
    """Core beats that are thin, and minor ones that are heavy."""
    return ru.pacing(t("orders").select(C("o_custkey").alias("plan"), C("o_orderkey").alias("beat"), X("cast(floor(o_totalprice) as long)").alias("words"), X("o_orderkey % 3 + 1").alias("events"), X("o_orderkey % 2 = 0").alias("core"), X("o_orderkey % 5 = 0").alias("minor")))


@query("SELECT o_orderkey, CAST(greatest(2, ceil(o_totalprice / 20000)) AS INTEGER) AS least FROM orders")
def event_floor(spark, t):
    return t("orders").select("o_orderkey", ru.least_events(C("o_totalprice"), 20000).alias("least"))


@query("SELECT conv_id * 1000 + turn AS patch, CASE WHEN text = '' THEN 0 ELSE ((length(text) - length(replace(text, substr(text, 1, 2 + CAST(turn AS INTEGER)), ''))) // length(substr(text, 1, 2 + CAST(turn AS INTEGER))))::INTEGER END AS occurrences FROM conversations WHERE occurrences <> 1")
def patch_targets(spark, t):
    """Patches whose old text does not occur exactly once."""
    c = t("conversations").select(X("conv_id * 1000 + turn").alias("unit"), "text", "turn")
    return ru.patch_problems(c.select(C("unit").alias("patch"), "unit", X("substring(text, 1, 2 + cast(turn as int))").alias("old")), c.select("unit", "text"))


@query("""WITH d AS (SELECT o_orderkey AS id, (o_orderkey % 3 - 1) * 0.1::DOUBLE AS s, (o_orderkey // 3 % 3 - 1) * 0.1::DOUBLE AS r, (o_orderkey // 9 % 3 - 1) * 0.1::DOUBLE AS h, o_orderkey % 4 AS g, o_orderkey % 5 AS l, o_orderkey % 7 <> 0 AS ok FROM orders)
    SELECT id, CASE WHEN NOT ok THEN 'NOT_EVALUABLE' WHEN s > 1e-12 AND r >= -1e-12 AND h >= -1e-12 AND g > l THEN 'SUPPORTED' WHEN s > 1e-12 OR r > 1e-12 OR h > 1e-12 THEN 'PARTIALLY_SUPPORTED' ELSE 'NOT_SUPPORTED' END AS verdict, CASE WHEN NOT ok THEN 'NOT_COVERED' WHEN s > 1e-12 AND r >= -1e-12 THEN 'SUPPORT' WHEN s > 1e-12 OR r > 1e-12 THEN 'MIXED' ELSE 'NO_GAIN' END AS class,
        CASE WHEN id % 90 + 1 <= 10 THEN 'FOUND' WHEN id % 40 + 1 <= 10 THEN 'FUSION' WHEN id % 90 + 1 <= 50 THEN 'SHALLOW' ELSE 'DEEP' END AS lost_in FROM d""")
def verdicts(spark, t):
    """Verdict, descriptive class and bottleneck of differences."""
    d = t("orders").select(C("o_orderkey").alias("id"), *(X(f"cast((o_orderkey div {k} % 3 - 1) * 0.1 as double)").alias(n) for n, k in (("s", 1), ("r", 3), ("h", 9))), X("o_orderkey % 4").alias("g"), X("o_orderkey % 5").alias("l"), X("o_orderkey % 7 <> 0").alias("ok"))
    return d.select("id", ru.consensus_verdict(*map(C, ("s", "r", "h", "g", "l", "ok"))).alias("verdict"), dg.descriptive_class(C("s"), C("r"), C("ok")).alias("class"), dg.bottleneck(X("id % 40 + 1"), X("id % 90 + 1")).alias("lost_in"))


@query("SELECT count(*) FILTER (value > 1 AND event_type <> 'error') AS L0, count(*) FILTER (value > 1 AND event_type NOT IN ('click', 'view')) AS L1 FROM events")
def layered_passes(spark, t):
    return ru.layer_passes(t("events").select(X("value > 1").alias("valid"), F.array("event_type").alias("codes")), {"L0": ("error",), "L1": ("click", "view")})


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY s_nationkey DESC, s_acctbal, s_name LIMIT 1")
def best_candidate(spark, t):
    """The best by ordered criteria."""
    return ru.first_by_criteria(t("supplier"), (("s_nationkey", True), ("s_acctbal", False)), "s_name").select("s_suppkey", "s_name")


@query("""WITH m AS (SELECT p_name || '-' || p_partkey AS model, [p_size, CAST(p_partkey % 3 AS INTEGER), CAST(p_partkey % 10 AS INTEGER)] AS v, p_partkey % 4 = 0 AS light FROM part),
    g AS (SELECT v[1:2] AS g, model FROM m WHERE NOT light QUALIFY row_number() OVER (PARTITION BY v[1:2] ORDER BY v DESC, model) = 1), r AS (SELECT model, row_number() OVER (ORDER BY g DESC) AS n FROM g)
    SELECT CASE n WHEN 1 THEN 'LATEST' ELSE 'PREVIOUS' END AS role, model FROM r WHERE n <= 2 UNION ALL SELECT 'LIGHT', model FROM (SELECT model FROM m WHERE light ORDER BY v DESC, model LIMIT 1)""")
def model_generations(spark, t):
    return ru.latest_per_generation(t("part").select(F.concat_ws("-", "p_name", C("p_partkey").cast("string")).alias("model"), X("array(p_size, cast(p_partkey % 3 as int), cast(p_partkey % 10 as int))").alias("version"), X("p_partkey % 4 = 0").alias("light")))


@query("""WITH c AS (SELECT DISTINCT l_suppkey AS file, l_partkey AS line FROM lineitem WHERE l_partkey % 2 = 0), x AS (SELECT DISTINCT l_suppkey AS file, l_partkey AS line FROM lineitem WHERE l_quantity > 20)
    SELECT c.file, count(*) AS lines, count(x.line) AS covered, round(count(x.line) / count(*), 6) AS share FROM c LEFT JOIN x USING (file, line) GROUP BY c.file""")
def changed_line_coverage(spark, t):
    rows = t("lineitem").select(C("l_suppkey").alias("file"), C("l_partkey").alias("line"), "l_quantity")
    return ru.line_coverage(rows.where("line % 2 = 0").select("file", "line"), rows.select("file", "line"), rows.where("l_quantity > 20").select("file", "line"))


# ---------------------------------------------------------------- diagnostics

@query(f"""WITH {DENSE}, h AS (SELECT k.*, label, x FROM k JOIN u USING (id) WHERE rank <= 10), c AS (SELECT query, count(DISTINCT label) FILTER (rank <= 3) AS c3, count(DISTINCT label) FILTER (rank <= 5) AS c5, count(DISTINCT label) AS c10, avg(score) AS r FROM h GROUP BY query),
    p AS (SELECT a.query, avg(list_dot_product(a.x, b.x)) AS s FROM h a JOIN h b ON a.query = b.query AND a.rank < b.rank GROUP BY a.query)
    SELECT round(avg(c3), 6) AS chapters_3, round(avg(c5), 6) AS chapters_5, round(avg(c10), 6) AS chapters_10, round(avg(s), 6) AS similarity, round(avg(r), 6) AS relevance FROM c LEFT JOIN p USING (query)""")
def ranking_diversity(spark, t):
    v = t("embeddings").select(C("vec_id").alias("id"), C("label").alias("chapter"), rt.unit(C("embedding")).alias("vector"))
    return dg.diversity(catalog.dense(t).where("rank <= 10").join(v, "id"))


@query("WITH s AS (SELECT user_id, count(DISTINCT event_type) AS z FROM events WHERE value > 20 GROUP BY 1) SELECT CAST(z AS INTEGER) AS size, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9)::DOUBLE AS share FROM s GROUP BY z")
def facet_counts(spark, t):
    """Histogram of list lengths."""
    return dg.list_sizes(t("events").where("value > 20").groupBy("user_id").agg(F.collect_set("event_type").alias("f")), "f")


EVENT_KEYS = "user_id AS \"case\", CASE WHEN value > 40 THEN 'HIGH' WHEN value > 20 THEN 'MEDIUM' ELSE 'LOW' END AS severity, event_type AS predicate"


@query(f"WITH f AS (SELECT {EVENT_KEYS} FROM events WHERE event_id % 2 = 0), m AS (SELECT {EVENT_KEYS} FROM events WHERE event_id % 2 = 1), x AS (SELECT * FROM f UNION ALL SELECT * FROM m WHERE (\"case\", severity, predicate) NOT IN (SELECT \"case\", severity, predicate FROM f)) SELECT severity, count(*) AS n FROM x GROUP BY severity")
def severities(spark, t):
    """Failures by severity, with the unmatched items that no failure covers."""
    e = t("events").select("event_id", C("user_id").alias("case"), X("case when value > 40 then 'HIGH' when value > 20 then 'MEDIUM' else 'LOW' end").alias("severity"), C("event_type").alias("predicate"))
    return dg.severity_counts(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"))


@query("""SELECT 'o_orderstatus' AS first, o_orderstatus AS value, NULL AS second, NULL AS other, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderpriority', o_orderpriority, NULL, NULL, count(*) FROM orders GROUP BY 2
    UNION ALL SELECT 'o_orderstatus', o_orderstatus, 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2, 4""")
def crossed_counts(spark, t):
    """Counts by every dimension and pair of dimensions."""
    return dg.cross_counts(t("orders"), "o_orderstatus", "o_orderpriority")


@query("""WITH a AS (SELECT DISTINCT user_id AS c, event_id % 200 AS i, event_type AS p FROM events WHERE value > 5), b AS (SELECT DISTINCT user_id AS c, event_id % 200 AS i, event_type AS p FROM events WHERE value < 25 AND user_id % 4 <> 0), s AS (SELECT c FROM a INTERSECT SELECT c FROM b)
    SELECT coalesce(a.p, b.p) AS predicate, count(*) FILTER (b.p IS NULL) AS only_first, count(*) FILTER (a.p IS NULL) AS only_second, count(*) FILTER (a.p IS NOT NULL AND b.p IS NOT NULL) AS "both" FROM (SELECT * FROM a SEMI JOIN s USING (c)) a FULL JOIN (SELECT * FROM b SEMI JOIN s USING (c)) b USING (c, i, p) GROUP BY 1""")
def recovered_by_either(spark, t):
    e = t("events").select(C("user_id").alias("case"), X("event_id % 200").alias("id"), C("event_type").alias("predicate"), "value")
    return dg.paired_recovery(e.where("value > 5"), e.where("value < 25 and case % 4 <> 0"))


@query("SELECT s_nationkey AS reviewer, s_suppkey % 4 AS question, round(avg(s_acctbal), 6) AS mean, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1, 2")
def review_summary(spark, t):
    """Mean score by reviewer and question, missing ones left out."""
    return dg.form_summary(t("supplier").select(C("s_nationkey").alias("reviewer"), X("s_suppkey % 4").alias("question"), X("if(s_acctbal > 0, s_acctbal, null)").alias("score")))


@query("""WITH a AS (SELECT user_id AS job, event_id // 1000 AS w, event_id AS seq, event_type AS c, value AS v, lag(event_id // 1000) OVER (PARTITION BY user_id ORDER BY event_id // 1000, event_id) AS before FROM events)
    SELECT job, count(*) AS attempts, count(DISTINCT w) AS windows, count(*) FILTER (w > before) AS resumed, count(*) FILTER (c = 'purchase') AS succeeded, round(sum(greatest(0, v - 3)), 6) AS latency FROM a GROUP BY job""")
def job_summaries(spark, t):
    """Attempts, windows, resumptions and latency by job."""
    rows = t("events").select(C("user_id").alias("job"), X("event_id div 1000").alias("window"), C("event_id").alias("seq"), X("if(event_type = 'purchase', 'SUCCESS', event_type)").alias("category"), F.lit(3.0).alias("start"), C("value").alias("end"))
    return dg.job_summary(rows)


STATUS = "CASE event_type WHEN 'error' THEN 500 + event_id % 5 WHEN 'click' THEN 429 WHEN 'view' THEN 401 WHEN 'signup' THEN 404 END"


@query(f"WITH a AS (SELECT {STATUS} AS s, CASE event_id % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'network' ELSE 'other' END AS k FROM events) SELECT count(*) FILTER (s = 503) AS unavailable, count(*) FILTER (s BETWEEN 500 AND 599 AND s <> 503) AS other_server, count(*) FILTER (s = 429) AS throttled, count(*) FILTER (k = 'timeout') AS timeouts, count(*) FILTER (k = 'network') AS network FROM a")
def failure_code_counts(spark, t):
    return dg.failure_counts(t("events").select(X(STATUS).alias("status"), X("case event_id % 3 when 0 then 'timeout' when 1 then 'network' else 'other' end").alias("kind")))


@query(f"WITH a AS (SELECT event_id, {STATUS} AS s, CASE event_id % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'network' ELSE 'other' END AS k FROM events) SELECT event_id, CASE WHEN s IN (401, 403) THEN 'AUTH_FAILURE' WHEN s = 429 THEN 'RATE_LIMIT' WHEN s BETWEEN 500 AND 599 THEN 'SERVER_FAILURE' WHEN k = 'timeout' THEN 'TIMEOUT' WHEN k = 'network' THEN 'NETWORK_FAILURE' ELSE 'PROVIDER_FAILURE' END AS category FROM a")
def error_classes(spark, t):
    return t("events").select("event_id", me.classify_error(X(STATUS), X("case event_id % 3 when 0 then 'timeout' when 1 then 'network' else 'other' end")).alias("category"))


@query("SELECT l_partkey AS part, l_orderkey AS first_order FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) = 1")
def first_by_name(spark, t):
    """The first row of each key."""
    return dg.first_wins(t("lineitem").select(C("l_partkey").alias("part"), C("l_orderkey").alias("first_order"), X("l_orderkey * 10 + l_linenumber").alias("at")), "part", "at").select("part", "first_order")


@query("SELECT o_custkey AS story, 'F' || row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber) AS number, l_orderkey AS unit, l_linenumber AS claim FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'")
def finding_numbers(spark, t):
    """Problem claims numbered through a story."""
    c = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag")))
    units = t("orders").join(t("lineitem"), X("l_orderkey = o_orderkey")).groupBy(C("o_custkey").alias("story"), C("o_orderkey").alias("unit")).agg(F.transform(c, lambda x: F.struct(x["l_linenumber"].alias("claim"), (x["l_returnflag"] == "R").alias("problem"))).alias("claims"))
    return dg.numbered_findings(units)


@query("""WITH g AS (SELECT o_orderkey AS q, l_linenumber % 2 AS i, l_partkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey), s AS (SELECT q, i, min(CASE WHEN id % 5 <> 0 THEN 1 ELSE 0 END) AS ok FROM g GROUP BY q, i), p AS (SELECT q, max(ok) AS ok FROM s GROUP BY q)
    SELECT count(*) AS probes, coalesce(sum(ok), 0)::BIGINT AS covered FROM (SELECT DISTINCT l_orderkey AS q FROM lineitem) LEFT JOIN p USING (q)""")
def brief_coverage(spark, t):
    """Probes with a gold set that the citations cover."""
    sets = t("lineitem").groupBy("l_orderkey", X("l_linenumber % 2")).agg(F.collect_set("l_partkey").alias("ids"))
    probes = sets.groupBy(C("l_orderkey").alias("probe")).agg(F.collect_list("ids").alias("gold"))
    return dg.citation_coverage(probes, t("part").where("p_partkey % 5 <> 0").select(C("p_partkey").alias("id")))


LONG = "SELECT CAST(query AS VARCHAR) AS scope, unnest(['hit_10', 'recall_10', 'mrr']) AS metric, unnest([hit_10, recall_10, mrr]) AS value FROM {0}"


def long_metrics(t, dims: int):
    m = ev.probe_metrics(catalog.gold(t), catalog.dense(t, dims))
    return m.select(C("query").cast("string").alias("scope"), F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), C(c).alias("value")) for c in ("hit_10", "recall_10", "mrr")))).alias("m")).select("scope", "m.*")


BOTH = f"WITH {DENSE}, {METRICS.format(r='k')}, {METRICS.format(r='m').replace('f AS', 'f2 AS').replace('ps AS', 'ps2 AS').replace('pm AS', 'pm2 AS').replace('FROM f GROUP', 'FROM f2 GROUP').replace('FROM ps GROUP', 'FROM ps2 GROUP')}"


@query(f"{BOTH}, a AS ({LONG.format('pm')}), b AS ({LONG.format('pm2')}) SELECT scope, metric, a.value AS reference, b.value AS candidate, round(b.value - a.value, 12) AS delta FROM a JOIN b USING (scope, metric)")
def metric_differences(spark, t):
    """Metrics of two rankings side by side."""
    return dg.metric_deltas(long_metrics(t, 64), long_metrics(t, 32))


@query(f"{BOTH}, a AS ({LONG.format('pm')}), b AS ({LONG.format('pm2')}) SELECT scope, metric, a.value, b.value AS computed FROM a JOIN b USING (scope, metric) WHERE abs(a.value - b.value) > 1e-12")
def reproduction_gate(spark, t):
    """Recorded metrics that a second run does not reproduce."""
    return dg.broken_reproductions(long_metrics(t, 64), long_metrics(t, 32))


@query(f"WITH {DENSE}, {METRICS.format(r='k')} SELECT query AS scope, '' AS metric FROM pm WHERE false")
def determinism_check(spark, t):
    """Two runs of one ranking differ in nothing."""
    return dg.broken_reproductions(long_metrics(t, 64), long_metrics(t, 64)).select(C("scope").cast("long").alias("scope"), "metric")


@query(f"WITH {WINDOWS}, w AS (SELECT doc, n, unnest(range(0, greatest(ceil((n - 448) / 384.0), 0)::BIGINT + 1)) AS k FROM n WHERE n > 0), x AS (SELECT doc, n, k * 384 + CASE WHEN doc % 5 = 0 AND k = 1 THEN 3 ELSE 0 END AS s, least(k * 384 + 448, n) + CASE WHEN doc % 7 = 0 THEN 1 ELSE 0 END AS e FROM w), y AS (SELECT *, lag(s) OVER (PARTITION BY doc ORDER BY s) AS before, max(e) OVER (PARTITION BY doc) AS last FROM x) SELECT DISTINCT doc, unnest(list_filter([CASE WHEN before IS NULL AND s <> 0 THEN 'FIRST' END, CASE WHEN last <> n THEN 'LAST' END, CASE WHEN s - before <> 384 THEN 'STRIDE' END, CASE WHEN e - s > 448 THEN 'LENGTH' END], lambda z: z IS NOT NULL)) AS problem FROM y")
def token_window_check(spark, t):
    """Token windows, some of them moved or too long, against their contract."""
    totals = t("documents").select(C("doc_id").alias("doc"), F.size(tx.word_tokens(C("text"))).cast("long").alias("n_tokens"))
    from ..operators.ingest import token_windows

    w = token_windows(totals)
    moved = w.select("doc", X("start + if(doc % 5 = 0 and window = 1, 3, 0)").alias("start"), X("`end` + if(doc % 7 = 0, 1, 0)").alias("end"))
    return dg.window_coverage_problems(moved, totals, 384, 448)


@query("SELECT conv_id AS story, CAST(turn // 3 + 1 AS INTEGER) AS episode, min(turn) AS first, max(turn) AS last FROM conversations GROUP BY 1, 2")
def episode_ranges(spark, t):
    """Runs of three consecutive turns."""
    return dg.episodes(t("conversations").select(C("conv_id").alias("story"), C("turn").alias("chapter")), 3)


@query("""WITH RECURSIVE q AS (SELECT conv_id AS unit, turn AS seq, substr(text, 1, 3) AS quote, regexp_replace(substr(text, 1, 3), '\\s', '', 'g') AS bare, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
    r AS (SELECT unit, n, [bare] AS kept, [seq] AS seqs FROM q WHERE n = 1 UNION ALL SELECT r.unit, q.n, CASE WHEN len(list_filter(r.kept, lambda k: contains(k, q.bare) OR contains(q.bare, k))) > 0 THEN r.kept ELSE list_append(r.kept, q.bare) END, CASE WHEN len(list_filter(r.kept, lambda k: contains(k, q.bare) OR contains(q.bare, k))) > 0 THEN r.seqs ELSE list_append(r.seqs, q.seq) END FROM r JOIN q ON q.unit = r.unit AND q.n = r.n + 1),
    e AS (SELECT unit, unnest(seqs) AS seq FROM r QUALIFY n = max(n) OVER (PARTITION BY unit)) SELECT q.unit, q.seq, q.quote FROM e JOIN q USING (unit, seq)""")
def findings_merged(spark, t):
    """Findings whose quotes no earlier one covers."""
    return dg.merged_findings(t("conversations").select(C("conv_id").alias("unit"), C("turn").alias("seq"), F.substring("text", 1, 3).alias("quote")))


@query("SELECT l_orderkey AS unit, l_partkey AS claim, l_returnflag AS claim_type FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_quantity > 25 AND b.l_orderkey = a.l_orderkey AND b.l_partkey = a.l_partkey AND b.l_returnflag = a.l_returnflag)")
def claims_that_stand(spark, t):
    rows = t("lineitem").select(C("l_orderkey").alias("unit"), C("l_partkey").alias("claim"), C("l_returnflag").alias("claim_type"), "l_quantity")
    return dg.without_claims(rows.drop("l_quantity"), rows.where("l_quantity > 25").drop("l_quantity"))


@query(f"{BOTH} SELECT count(*) FILTER (a.success_10 > 0 AND NOT b.success_10 > 0) AS lost, count(*) FILTER (NOT a.success_10 > 0 AND b.success_10 > 0) AS gained, count(*) FILTER (b.recall_10 > a.recall_10 + 1e-12) AS improved, count(*) FILTER (abs(a.recall_10 - b.recall_10) <= 1e-12) AS unchanged, count(*) FILTER (b.recall_10 < a.recall_10 - 1e-12) AS worsened FROM pm a JOIN pm2 b USING (query)")
def lost_and_gained(spark, t):
    a, b = (ev.probe_metrics(catalog.gold(t), catalog.dense(t, d)).select("query", C("success_10").alias(f"s{i}"), C("recall_10").alias(f"r{i}")) for i, d in ((1, 64), (2, 32)))
    return dg.paired_changes(a.join(b, "query"))


@query("SELECT l_orderkey AS query, CAST(l_linenumber % 2 AS INTEGER) AS set_index, l_partkey * 2 + l_linenumber % 2 AS id FROM lineitem GROUP BY ALL")
def gold_sets(spark, t):
    """Gold sets, checked and flat."""
    sets = t("lineitem").groupBy(C("l_orderkey").alias("query"), X("l_linenumber % 2").alias("s")).agg(F.collect_set(X("l_partkey * 2 + l_linenumber % 2")).alias("ids"))
    probes = sets.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("s", "ids"))).alias("g"))
    both = probes.select("query", C("g.s").alias("s"), C("g.ids").alias("gold"))
    found = ev.normalize_gold(both).join(both.select("query", "s"), "query")
    return found.select("query", F.element_at("s", C("set_index") + 1).cast("int").alias("set_index"), "id")


@query("SELECT user_id AS flag FROM events GROUP BY user_id HAVING min(CASE WHEN value > 0.5 THEN 1 ELSE 0 END) = 1")
def unanimous_flags(spark, t):
    return me.unanimous(t("events").select(C("user_id").alias("flag"), X("if(value > 0.5, 'YES', 'NO')").alias("vote")), "YES")


@query("SELECT [least(l_suppkey, l_partkey), greatest(l_suppkey, l_partkey)] AS pair, string_agg(l_orderkey || ':' || l_linenumber, ',' ORDER BY l_orderkey, l_linenumber) AS states FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1")
def relationship_stages(spark, t):
    """All states of each pair in order."""
    rows = t("lineitem").select(C("l_suppkey").alias("a"), C("l_partkey").alias("b"), C("l_orderkey").alias("position"), C("l_linenumber").alias("state"))
    return me.timeline(rows).select("pair", F.array_join(F.transform("states", lambda s: F.concat_ws(":", s["position"].cast("string"), s["state"].cast("string"))), ",").alias("states"))


@query("SELECT doc_id, sha256('protocol' || source || CAST(doc_id AS VARCHAR)) AS hash FROM documents")
def sampling_order(spark, t):
    """The order in which a protocol draws its sample."""
    return t("documents").select("doc_id", me.hash_order("protocol", C("source"), C("doc_id")).alias("hash"))


@query(f"""WITH s AS (SELECT p_brand AS unit, p_partkey AS k, {BIGRAMS.format('p_name')} AS b FROM part WHERE p_partkey % 2 = 1), h AS (SELECT p_brand AS unit, p_partkey AS k, {BIGRAMS.format('p_name')} AS b FROM part WHERE p_partkey % 2 = 0),
    j AS (SELECT s.unit, s.k AS sentence, h.k AS statement, round(CASE WHEN len(s.b) = 0 OR len(h.b) = 0 THEN 0 ELSE 2.0 * len(list_intersect(s.b, h.b)) / (len(s.b) + len(h.b)) END, 9)::DOUBLE AS similarity FROM s JOIN h USING (unit))
    SELECT * FROM j WHERE similarity >= 0.5 QUALIFY row_number() OVER (PARTITION BY unit, sentence ORDER BY similarity DESC, statement) = 1""")
def hedges_dropped(spark, t):
    """Sentences without a hedge whose nearest statement is hedged."""
    p = t("part").select(C("p_brand").alias("unit"), "p_partkey", C("p_name").alias("text"))
    return me.hedge_audit(p.where("p_partkey % 2 = 1").select("unit", C("p_partkey").alias("sentence"), "text", F.lit(False).alias("hedged")), p.where("p_partkey % 2 = 0").select("unit", C("p_partkey").alias("statement"), "text", F.lit(True).alias("hedged")))
