"""Registered queries over the as-of view, on a graph that the vectors' ids spell out, with SQL oracles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import story_view as sv
from .catalog import query

X = F.expr
#: Argument rows of each predicate: name, kind, value. Two assertions share each even id as their proposition.
CONTENT = "cast(((p * {0}) % greatest(m, 1)) * 18 + 16 as string)"
POLARITY = "if(p % 3 = 0, 'NEGATED', 'AFFIRMED')"
ARGS = {
    "SameAs": (("first", "ENTITY", "concat('e', p % 30)"), ("second", "ENTITY", "concat('e', (p * 7 + 4) % 30)")),
    "SameContent": (("placeholder", "PROPOSITION", CONTENT.format(5)), ("concrete", "PROPOSITION", CONTENT.format(11))),
    "Attitude": (("holder", "ENTITY", "concat('e', p % 12)"), ("attitude", "TOKEN", "case when p % 5 < 3 then 'BELIEVES' else 'UNAWARE' end"), ("content", "PROPOSITION", CONTENT.format(7)), ("content_polarity", "TOKEN", POLARITY)),
    "Says": (("speaker", "ENTITY", "concat('e', p % 30)"), ("content", "PROPOSITION", CONTENT.format(13)), ("content_polarity", "TOKEN", POLARITY)),
    "Conceals": (("concealer", "ENTITY", "concat('e', p % 12)"), ("concealed_from", "ENTITY", "concat('e', (p + 3) % 12)"), ("content", "PROPOSITION", CONTENT.format(7)), ("content_polarity", "TOKEN", POLARITY)),
    "Occurred": (("event", "EVENT", "concat('v', p % 25)"),),
    "TemporalRelation": (("subject", "ANCHOR", "concat('t', p % 9)"), ("relation", "TOKEN", "'BEFORE'"), ("object", "ANCHOR", "concat('t', p % 7)")),
    "RefersTo": (("mention", "MENTION", "concat('m', p % 40)"), ("entity", "ENTITY", "concat('e', (p * 3) % 30)")),
    "Fact": (("event", "EVENT", "concat('v', p % 31)"),),
}
NAMES = tuple(ARGS)
POSITION = "array(30L, 1L)"


def graph(t) -> dict[str, DataFrame]:
    v = t("embeddings").select(F.col("vec_id").alias("i"))
    m = v.count() // 18
    i = v.withColumn("p", X("i - i % 2"))
    predicate = reduce(lambda out, k: F.when(X(f"p div 2 % {len(NAMES)} = {k}"), NAMES[k]).otherwise(out), range(len(NAMES)), F.lit(None).cast("string"))
    props = i.select("p").distinct().withColumn("m", F.lit(m)).withColumn("predicate", predicate)
    args = reduce(DataFrame.unionByName, (props.where(F.col("predicate") == n).select(F.col("p").cast("string").alias("proposition"), F.lit(a).alias("name"), F.lit(k).alias("kind"), X(e).alias("ref")) for n, rows in ARGS.items() for a, k, e in rows))
    bounds = i.where("i % 4 < 2").select(F.col("i").alias("assertion"), X("if(i % 4 = 0, 'end', 'start')").alias("side"), X("concat('t', i div 72)").alias("anchor"), X("array(i % 20, 0L)").alias("available"))
    return {
        "assertions": i.select(F.col("i").alias("assertion"), F.col("p").cast("string").alias("proposition"), X("case i % 5 when 0 then 'NEGATED' when 1 then 'OPEN' else 'AFFIRMED' end").alias("polarity"), X("if(i % 3 = 0, 'EXPLICIT', 'INFERRED')").alias("epistemic"), X("i % 17 = 0").alias("rejected"), X("if(i % 23 = 0, null, array(i % 40, i % 3))").alias("available")),
        "propositions": props.select(F.col("p").cast("string").alias("proposition"), "predicate", X("predicate = 'Fact' and p % 4 = 0").alias("placeholder")),
        "args": args,
        "bounds": bounds,
        "mentions": F.broadcast(t("embeddings").select(X("concat('m', vec_id % 45)").alias("mention"), X("array(vec_id % 45, 0L)").alias("available")).distinct()),
        "paths": i.select(F.col("i").alias("assertion"), X("i * 10").alias("path"), X("case i % 3 when 0 then 'SUFFICIENT' when 1 then 'DERIVATION' else 'OTHER' end").alias("kind"), X("array(i % 33, 0L)").alias("available")),
    }


def _sql(e: str) -> str:
    """The same expression in the other dialect: integer division and the conditional function."""
    return e.replace("if(p % 3 = 0, 'NEGATED', 'AFFIRMED')", "CASE WHEN p % 3 = 0 THEN 'NEGATED' ELSE 'AFFIRMED' END").replace("cast(", "CAST(").replace("as string)", "AS VARCHAR)")


BASE = f"""i AS (SELECT vec_id AS i, vec_id - vec_id % 2 AS p FROM embeddings), m AS (SELECT count(*) // 18 AS m FROM embeddings),
    pr AS (SELECT DISTINCT p, m, (p // 2) % {len(NAMES)} AS k FROM i, m), a AS (SELECT i AS assertion, p, CASE i % 5 WHEN 0 THEN 'NEGATED' WHEN 1 THEN 'OPEN' ELSE 'AFFIRMED' END AS polarity, CASE WHEN i % 3 = 0 THEN 'EXPLICIT' ELSE 'INFERRED' END AS epistemic, [i % 40, i % 3] AS available,
        CASE WHEN i % 4 = 1 AND [i % 20, 0] <= [30, 1] THEN 't' || (i // 72) END AS start, CASE WHEN i % 4 = 0 AND [i % 20, 0] <= [30, 1] THEN 't' || (i // 72) END AS "end" FROM i WHERE i % 17 <> 0 AND i % 23 <> 0 AND [i % 40, i % 3] <= [30, 1]),
    """ + ",\n    ".join(f"{n} AS (SELECT a.*, " + ", ".join(f"{_sql(e)} AS {x}" for x, _, e in rows) + f" FROM a JOIN pr USING (p) WHERE k = {NAMES.index(n)})" for n, rows in ARGS.items())


def status_sql(rows: str, key: str, name: str) -> str:
    return f"""{name} AS (SELECT {key}, CASE WHEN y > 0 AND n > 0 THEN CASE WHEN open_pairs = 0 THEN 'TIME_SCOPED' ELSE 'CONTESTED' END WHEN y > 0 THEN 'AFFIRMED' WHEN n > 0 THEN 'NEGATED' ELSE 'OPEN' END AS status FROM
        (SELECT {key}, count(*) FILTER (polarity = 'AFFIRMED') AS y, count(*) FILTER (polarity = 'NEGATED') AS n FROM {rows} GROUP BY 1) LEFT JOIN
        (SELECT x.{key}, count(*) FILTER (NOT (coalesce(x."end" = z.start, false) OR coalesce(z."end" = x.start, false))) AS open_pairs FROM {rows} x JOIN {rows} z ON x.{key} = z.{key} AND x.polarity = 'AFFIRMED' AND z.polarity = 'NEGATED' GROUP BY 1) USING ({key}))"""


def classes_sql(pairs: str, nodes: str, name: str) -> str:
    return f"""{name}_e AS (SELECT a, b FROM ({pairs}) UNION ALL SELECT b, a FROM ({pairs})), {name}_w AS (SELECT node, node AS root FROM ({nodes}) UNION SELECT w.node, e.b FROM {name}_w w JOIN {name}_e e ON w.root = e.a), {name} AS (SELECT node, min(root) AS root FROM {name}_w GROUP BY node)"""


ENTITIES = " UNION ".join(f"SELECT {x} AS node FROM {n}" for n, rows in ARGS.items() for x, k, _ in rows if k == "ENTITY")
CONTENTS = "SELECT CAST(p AS VARCHAR) AS node FROM a UNION " + " UNION ".join(f"SELECT {x} FROM {n}" for n, rows in ARGS.items() for x, k, _ in rows if k == "PROPOSITION")
FULL = f"""{BASE}, {status_sql('SameAs', 'p', 'sas')}, {classes_sql("SELECT first AS a, second AS b FROM SameAs JOIN sas USING (p) WHERE status = 'AFFIRMED'", ENTITIES, 'ent')},
    {status_sql('SameContent', 'p', 'scs')}, {classes_sql("SELECT placeholder AS a, concrete AS b FROM SameContent JOIN scs USING (p) WHERE status = 'AFFIRMED'", CONTENTS, 'con')},
    ac AS (SELECT a.*, root FROM a JOIN con ON node = CAST(p AS VARCHAR)), {status_sql('ac', 'root', 'com')},
    claims AS (SELECT s.assertion, s.speaker, s.content, s.content_polarity, con.root AS content_class, coalesce(com.status, 'UNCOMMITTED') AS status FROM Says s JOIN con ON con.node = s.content LEFT JOIN com ON com.root = con.root WHERE s.polarity = 'AFFIRMED'),
    att AS (SELECT s.assertion, ent.root AS holder, s.attitude, s.content, s.content_polarity, con.root AS content_class, coalesce(com.status, 'UNCOMMITTED') AS status FROM Attitude s JOIN con ON con.node = s.content JOIN ent ON ent.node = s.holder LEFT JOIN com ON com.root = con.root WHERE s.polarity = 'AFFIRMED')"""
SETTLED = "status IN ('AFFIRMED', 'NEGATED')"


SECTIONS: dict[str, tuple[tuple[str, ...], str]] = {}


def section(name: str, columns: str, sql: str) -> None:
    SECTIONS[name] = (tuple(columns.split()), sql)


LIST = "coalesce(string_agg(CAST({0} AS VARCHAR), ',' ORDER BY {0}) FILTER ({1}), '')"
section("visible_assertions", "assertion proposition polarity epistemic available start end", f"WITH {BASE} SELECT assertion, CAST(p AS VARCHAR) AS proposition, polarity, epistemic, array_to_string(available, ',') AS available, start, \"end\" FROM a")
section("visible_support", "assertion sufficient derivations other", f"WITH {BASE}, x AS (SELECT assertion, assertion * 10 AS path, assertion % 3 AS k, [assertion % 33, 0] <= [30, 1] AS done FROM a) SELECT assertion, {LIST.format('path', 'done AND k = 0')} AS sufficient, {LIST.format('path', 'done AND k = 1')} AS derivations, {LIST.format('path', 'done AND k = 2')} AS other FROM x GROUP BY assertion")
section("identity_equivalence", "node root", f"WITH RECURSIVE {FULL} SELECT node, root FROM ent")
section("mention_resolution", "mention entity_classes status", f"""WITH RECURSIVE {FULL}, {status_sql('RefersTo', 'p', 'rts')}, v AS (SELECT DISTINCT 'm' || (vec_id % 45) AS mention FROM embeddings WHERE [vec_id % 45, 0] <= [30, 1]), r AS (SELECT DISTINCT mention, root FROM RefersTo JOIN rts USING (p) JOIN ent ON ent.node = entity WHERE status = 'AFFIRMED')
    SELECT mention, coalesce(string_agg(root, ',' ORDER BY root), '') AS entity_classes, CASE count(root) WHEN 0 THEN 'UNRESOLVED' WHEN 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS status FROM v LEFT JOIN r USING (mention) GROUP BY mention""")
section("content_resolution", "node resolved_to", f"WITH RECURSIVE {FULL}, f AS (SELECT node, root, k = 8 AND p % 4 = 0 AS ph FROM con JOIN pr ON CAST(p AS VARCHAR) = node) SELECT x.node, coalesce(string_agg(y.node, ',' ORDER BY y.node) FILTER (NOT y.ph), '') AS resolved_to FROM f x JOIN f y USING (root) WHERE x.ph GROUP BY x.node")
section("canonical_commitments", "root status", f"WITH RECURSIVE {FULL} SELECT root, status FROM com")
section("knowledge_verdicts", "assertion holder content verdict", f"WITH RECURSIVE {FULL} SELECT assertion, holder, content, CASE WHEN attitude <> 'BELIEVES' THEN attitude WHEN {SETTLED} THEN CASE WHEN status = content_polarity THEN 'KNOWS' ELSE 'MISTAKEN' END ELSE 'UNRESOLVED_BELIEF' END AS verdict FROM att")
section("reported_claims", "assertion speaker content relation", f"WITH RECURSIVE {FULL} SELECT assertion, speaker, content, CASE WHEN {SETTLED} THEN CASE WHEN status = content_polarity THEN 'CONSISTENT' ELSE 'CONTRADICTED' END ELSE 'UNRESOLVED' END AS relation FROM claims")
YES, NO = ("content_polarity = '" + p + "'" for p in ("AFFIRMED", "NEGATED"))
section("report_conflicts", "content_class affirming negating", f"WITH RECURSIVE {FULL} SELECT content_class, {LIST.format('assertion', YES)} AS affirming, {LIST.format('assertion', NO)} AS negating FROM claims GROUP BY content_class HAVING count(*) FILTER ({YES}) > 0 AND count(*) FILTER ({NO}) > 0")
section("secrets", "assertion state holding learned opposed reader", f"""WITH RECURSIVE {FULL}, c AS (SELECT s.assertion, x.root AS concealer, y.root AS target, con.root AS content_class, s.content_polarity, s."end", coalesce(com.status, 'UNCOMMITTED') AS status FROM Conceals s JOIN con ON con.node = s.content JOIN ent x ON x.node = s.concealer JOIN ent y ON y.node = s.concealed_from LEFT JOIN com ON com.root = con.root WHERE s.polarity = 'AFFIRMED'),
    h AS (SELECT * FROM att WHERE attitude = 'BELIEVES'), hold AS (SELECT c.assertion, string_agg(CAST(h.assertion AS VARCHAR), ',' ORDER BY h.assertion) AS holding FROM c JOIN h ON h.holder = c.concealer AND h.content_class = c.content_class AND h.content_polarity = c.content_polarity GROUP BY 1),
    le AS (SELECT c.assertion, string_agg(CAST(h.assertion AS VARCHAR), ',' ORDER BY h.assertion) AS learned FROM c JOIN h ON h.holder = c.target AND h.content_class = c.content_class AND h.content_polarity = c.content_polarity GROUP BY 1),
    op AS (SELECT c.assertion, string_agg(CAST(h.assertion AS VARCHAR), ',' ORDER BY h.assertion) AS opposed FROM c JOIN h ON h.holder = c.target AND h.content_class = c.content_class AND h.content_polarity <> c.content_polarity GROUP BY 1)
    SELECT assertion, CASE WHEN learned IS NOT NULL OR "end" IS NOT NULL THEN 'ENDED' ELSE 'ACTIVE' END AS state, holding, learned, opposed, CASE WHEN {SETTLED} THEN CASE WHEN status = content_polarity THEN 'MATCHES_CANONICAL' ELSE 'OPPOSES_CANONICAL' END ELSE 'UNRESOLVED' END AS reader FROM c JOIN hold USING (assertion) LEFT JOIN le USING (assertion) LEFT JOIN op USING (assertion)""")
section("reader_reveals", "root status position", f"WITH RECURSIVE {FULL} SELECT root, status, array_to_string(list_extract(list_sort(list(available)), 1), ',') AS position FROM com JOIN ac USING (root) WHERE status <> 'OPEN' AND polarity <> 'OPEN' GROUP BY root, status")
section("event_occurrence", "event occurrence assertions held", f"""WITH RECURSIVE {FULL}, {status_sql('Occurred', 'event', 'occ')}, held AS (SELECT DISTINCT 'v' || (CAST(content AS BIGINT) % 31) AS event FROM (SELECT content FROM Says UNION ALL SELECT content FROM Attitude) JOIN pr ON CAST(p AS VARCHAR) = content AND k = 8), ev AS (SELECT event FROM Occurred UNION SELECT event FROM Fact UNION SELECT 'v' || (CAST(c AS BIGINT) % 31) FROM (SELECT content AS c FROM Says UNION SELECT content FROM Attitude UNION SELECT content FROM Conceals UNION SELECT placeholder FROM SameContent UNION SELECT concrete FROM SameContent) JOIN pr ON CAST(p AS VARCHAR) = c AND k = 8)
    SELECT ev.event, CASE coalesce(status, 'UNCOMMITTED') WHEN 'AFFIRMED' THEN 'OCCURRED' WHEN 'NEGATED' THEN 'NOT_OCCURRED' WHEN 'OPEN' THEN 'OPEN' WHEN 'UNCOMMITTED' THEN 'NOT_ESTABLISHED' ELSE 'CONTESTED' END AS occurrence, coalesce((SELECT string_agg(CAST(assertion AS VARCHAR), ',' ORDER BY assertion) FROM Occurred o WHERE o.event = ev.event), '') AS assertions, held.event IS NOT NULL AS held FROM ev LEFT JOIN occ ON occ.event = ev.event LEFT JOIN held ON held.event = ev.event""")
section("temporal_relations", "assertion subject relation object polarity epistemic", f"WITH {BASE} SELECT assertion, subject, relation, object, polarity, epistemic FROM TemporalRelation")
section("diagnostics", "code assertion", f"WITH RECURSIVE {FULL} SELECT 'IDENTITY_CONFLICT' AS code, assertion FROM SameAs JOIN sas USING (p) JOIN ent x ON x.node = first JOIN ent y ON y.node = second WHERE status = 'NEGATED' AND x.root = y.root UNION ALL SELECT 'IDENTITY_CONTESTED', assertion FROM SameAs JOIN sas USING (p) WHERE status = 'CONTESTED'")


def as_of_view(spark, t):
    """The whole view as of a position: every section's rows, as text."""
    parts = sv.project(graph(t), X(POSITION))

    def text(rows: DataFrame, c: str):
        kind = dict(rows.dtypes)[c]
        value = F.array_join(F.transform(c, lambda x: x.cast("string")), ",") if kind.startswith("array<") else F.col(c).cast("string")
        return F.coalesce(value, F.lit("null"))

    rows = (parts[n].select(F.lit(n).alias("section"), F.concat_ws("|", *(text(parts[n], c) for c in columns)).alias("row")) for n, (columns, _) in SECTIONS.items())
    return reduce(DataFrame.unionByName, rows)


query(" UNION ALL ".join(f"SELECT '{n}' AS section, " + " || '|' || ".join(f"coalesce(CAST(\"{c}\" AS VARCHAR), 'null')" for c in columns) + f' AS "row" FROM ({sql})' for n, (columns, sql) in SECTIONS.items()))(as_of_view)
