"""Registry of the engine's queries and of their SQL oracles, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions.shipping import ship
from ..operators import evaluation as ev
from ..operators import graph as gr
from ..operators import ingest as ig
from ..operators import memory as me
from ..operators import retrieval as rt
from ..sources import tables as src
from ..streaming import stateful as st

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, lambda name: src.table(spark, sf_dir, name))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- retrieval

LAST = "(SELECT max(doc_id) FROM documents)"
WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
TOP = 10


def bm25_sql(where: str, cutoff: str) -> str:
    return f"""t AS (SELECT doc_id AS id, doc_id AS position, {WORDS.format('text')} AS tokens FROM documents WHERE {where}),
    s AS (SELECT count(*) AS n, avg(len(tokens)) AS mean FROM t),
    e AS (SELECT id, position, len(tokens) AS length, unnest(tokens) AS token FROM t),
    f AS (SELECT id, position, length, token, count(*) AS tf FROM e GROUP BY ALL),
    d AS (SELECT token, count(*) AS df FROM f GROUP BY token),
    q AS (SELECT DISTINCT item_id AS query, {cutoff} AS cutoff, unnest({WORDS.format('text')}) AS token FROM benchmark),
    sc AS (SELECT query, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) AS score
        FROM q JOIN f USING (token) JOIN d USING (token), s WHERE position <= cutoff GROUP BY query, id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM sc WHERE score > 0)"""


BM25 = bm25_sql("true", f"{LAST} * (item_id % 8 + 1) // 8")
BM25_HALF = bm25_sql(f"doc_id <= {LAST} // 2", f"{LAST} // 2")


def passages(t) -> DataFrame:
    """Documents as passages of their source's story; a passage's position is its id."""
    return t("documents").select(F.col("source").alias("story"), F.col("doc_id").alias("id"), F.col("doc_id").alias("position"), "text", "lang")


def bm25(t, half: bool = False) -> DataFrame:
    """Every item with a cutoff of its own, an eighth to all of the table's positions; or all items and the index up to its middle."""
    last = t("documents").agg(F.max("doc_id")).first()[0] or 0
    p = passages(t).withColumn("tokens", tx.word_tokens(F.col("text")))
    cutoff = F.lit(last // 2) if half else F.floor(F.lit(last) * (F.col("item_id") % 8 + 1) / 8)
    q = t("benchmark").select(F.col("item_id").alias("query"), cutoff.alias("cutoff"), tx.word_tokens(F.col("text")).alias("tokens"))
    return rt.bm25_scores(p.where(F.col("position") <= last // 2) if half else p, q)


@query(f"WITH {BM25} SELECT query, id, CAST(rank AS INTEGER) AS rank, score FROM r WHERE rank <= {TOP}")
def bm25_topk(spark, t):
    """BM25 top-k over passages at or before each query's cutoff, statistics over all passages."""
    return rt.ranked(bm25(t), "id", k=TOP).select("query", "id", "rank", "score")


@query(f"WITH {BM25_HALF} SELECT query, id, CAST(rank AS INTEGER) AS rank, score FROM r WHERE rank <= {TOP}")
def bm25_topk_cutoff_index(spark, t):
    """The same with an index that ends at the table's middle position: statistics over the passages up to it only."""
    return rt.ranked(bm25(t, half=True), "id", k=TOP).select("query", "id", "rank", "score")


@query(f"WITH {BM25} SELECT query, to_json(struct_pack(query := query, hits := list(struct_pack(rank := rank, id := id) ORDER BY rank))) AS document FROM r WHERE rank <= 3 GROUP BY query")
def bm25_result_documents(spark, t):
    """Results as one JSON document per query (scores left out: engines print doubles differently)."""
    hits = rt.ranked(bm25(t), "id", k=3)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "id")))
    return hits.groupBy("query").agg(F.to_json(F.struct("query", ordered.alias("hits"))).alias("document"))


@query(f"WITH t AS (SELECT doc_id AS id, {WORDS.format('text')} AS tokens FROM documents), e AS (SELECT id, unnest(tokens) AS token FROM t) SELECT token, count(DISTINCT id) AS df, count(*) AS tf FROM e GROUP BY token")
def corpus_statistics(spark, t):
    """Document and term frequencies of tokens."""
    e = t("documents").select("doc_id", F.explode(tx.word_tokens(F.col("text"))).alias("token"))
    per = e.groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("tf"))


@query()
def bm25_latin_bigrams(spark, t):
    """BM25 over words and word pairs, of all passages."""
    p = passages(t).withColumn("tokens", tx.tokens_by_language(F.col("text"), F.col("lang")))
    q = t("benchmark").select(F.col("item_id").alias("query"), tx.latin_tokens(F.col("text")).alias("tokens"))
    return rt.ranked(rt.bm25_scores(p, q), "id", k=TOP)


#: The stated query set, which grows with the table.
STATED = "id % 50 = 0"
DENSE = f"""v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings),
    u AS (SELECT id, label, list_transform(x, lambda y: y / sqrt(list_sum(list_transform(x, lambda z: z * z)))) AS x, list_transform(x[1:32], lambda y: y / sqrt(list_sum(list_transform(x[1:32], lambda z: z * z)))) AS h FROM v),
    ks AS (SELECT q.id AS query, p.id, round(list_dot_product(q.x, p.x), 9) AS score FROM u q, u p WHERE q.{STATED} AND q.id <> p.id),
    k AS (SELECT query, id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank, score FROM ks),
    ms AS (SELECT q.id AS query, p.id, round(list_dot_product(q.h, p.h), 9) AS score FROM u q, u p WHERE q.{STATED} AND q.id <> p.id),
    m AS (SELECT query, id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank, score FROM ms),
    g AS (SELECT q.id AS query, CAST(p.id % 2 AS INTEGER) AS set_index, p.id FROM u q, u p WHERE q.{STATED} AND q.label = p.label AND p.id <> q.id)"""


def dense(t, dims: int = 64) -> DataFrame:
    v = t("embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, dims).alias("vector"))
    return rt.ranked(rt.cosine_scores(v, v.where(STATED).select(F.col("id").alias("query"), "vector")).where("query <> id"), "id")


def stated(t) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("id"), "label").where(STATED).select(F.col("id").alias("query"), "label")


def gold(t) -> DataFrame:
    """Required evidence of every stated query: the other vectors of its label, the even and the odd ids as alternative sets."""
    v = t("embeddings").select(F.col("vec_id").alias("id"), "label")
    return v.join(stated(t), "label").where("id <> query").select("query", F.expr("cast(id % 2 as int)").alias("set_index"), "id")


def whole_gold(t) -> DataFrame:
    """The same as one set."""
    return gold(t).withColumn("set_index", F.lit(0))


@query(f"WITH {DENSE} SELECT query, id, rank, score FROM k WHERE rank <= 10")
def dense_topk(spark, t):
    """Cosine top-k with ties by id."""
    return dense(t).where("rank <= 10").select("query", "id", "rank", "score")


@query(f"WITH {DENSE} , w AS (SELECT query, id % 50 AS id, max(score) AS score FROM ks GROUP BY ALL) SELECT query, CAST(id AS BIGINT) AS id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank, score FROM w")
def window_max_pooling(spark, t):
    """A parent's score is that of its best window (windows: vectors, parents: id mod 50)."""
    windows = dense(t).select("query", F.expr("id % 50").alias("id"), "score")
    parents = spark.range(50).select(F.col("id"))
    best = rt.window_max(windows, parents).where("score > -1")
    return rt.ranked(best, "id").select("query", "id", "rank", "score")


@query(f"WITH {DENSE}, a AS (SELECT query, id, rank FROM k UNION ALL SELECT query, id, rank FROM m), s AS (SELECT query, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM a GROUP BY query, id) SELECT query, id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20")
def rrf_full(spark, t):
    """Reciprocal rank fusion of two full rankings."""
    return rt.rrf([dense(t), dense(t, 32)]).where("rank <= 20").select("query", "id", "score", "rank")


@query(f"WITH {DENSE}, a AS (SELECT query, id, rank FROM k WHERE rank <= 100 UNION ALL SELECT query, id, rank FROM m WHERE rank <= 100), s AS (SELECT query, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM a GROUP BY query, id) SELECT query, id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20")
def rrf_hybrid(spark, t):
    """Fusion of two rankings cut at max(k, 100)."""
    return rt.rrf([dense(t), dense(t, 32)], depth=rt.hybrid_depth(20)).where("rank <= 20").select("query", "id", "score", "rank")


CONSENSUS = "c AS (SELECT k.query, k.id, k.rank AS k, x.new AS m FROM k JOIN (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, old, id) AS new FROM (SELECT k.query, k.id, k.rank AS old, m.score FROM k JOIN m USING (query, id) WHERE k.rank <= 30)) x USING (query, id))"


def reranked(t) -> DataFrame:
    return rt.rerank_splice(dense(t), dense(t, 32), 30)


@query(f"WITH {DENSE}, {CONSENSUS} SELECT query, id, CAST(coalesce(c.m, k.rank) AS INTEGER) AS rank FROM k LEFT JOIN c USING (query, id)")
def rerank_top30(spark, t):
    """The first 30 in another model's order, the rest as before."""
    return reranked(t)


@query(f"WITH {DENSE}, {CONSENSUS} SELECT query, id, CAST(k AS INTEGER) AS k, CAST(m AS INTEGER) AS m, CAST(k + m AS INTEGER) AS rank_sum, CAST(row_number() OVER (PARTITION BY query ORDER BY k + m, greatest(k, m), least(k, m), id) AS INTEGER) AS rank FROM c")
def consensus_rank_sum(spark, t):
    """Rank-sum consensus of the first 30 of two rankings."""
    return rt.rank_sum_consensus(rt.top_candidates(dense(t)), rt.top_candidates(reranked(t)))


@query()
def mmr_top10(spark, t):
    """Maximal marginal relevance over each query's first 50."""
    v = t("embeddings").select(F.col("vec_id").alias("id"), rt.unit(F.col("embedding")).alias("vector"))
    return rt.mmr(dense(t).where("rank <= 50").join(v, "id"), 10)


@query(f"WITH {DENSE}, a AS (SELECT query, id % 40 AS id, rank FROM k WHERE rank <= 60), o AS (SELECT query, id, min(rank) AS f FROM a GROUP BY query, id) SELECT query, id, CAST(row_number() OVER (PARTITION BY query ORDER BY f, id) AS INTEGER) AS place, row_number() OVER (PARTITION BY query ORDER BY f, id) <= 8 AS delivered FROM o")
def delivery_budget(spark, t):
    """Distinct passages in rank order within a budget, the rest reported."""
    return rt.deliver(dense(t).where("rank <= 60").select("query", F.expr("id % 40").alias("id"), "rank"), 8)


@query(f"WITH {DENSE}, a AS (SELECT query, id, 0 AS route, rank FROM k WHERE rank <= 6 UNION ALL SELECT query, id, 1, rank FROM m WHERE rank <= 12), o AS (SELECT query, id, min(route * 1000 + rank) AS f FROM a GROUP BY query, id), n AS (SELECT query, id, f, row_number() OVER (PARTITION BY query ORDER BY f, id) AS place FROM o) SELECT query, id, CAST(f // 1000 AS INTEGER) AS route, CAST(place AS INTEGER) AS place FROM n WHERE place <= 10")
def route_concatenation(spark, t):
    """First route's ids, then the second's new ones, cut at the budget."""
    return rt.concatenate_routes(dense(t).where("rank <= 6"), dense(t, 32).where("rank <= 12"), 10)


@query(f"WITH {DENSE}, a AS (SELECT query % 3 AS pool, query, id, rank FROM k WHERE rank <= 20 AND id % 5 <> 0), b AS (SELECT *, row_number() OVER (PARTITION BY pool, query ORDER BY rank) AS pl FROM a QUALIFY pl <= 2), o AS (SELECT pool, id, min(query * 10 + pl) AS f FROM b GROUP BY pool, id), n AS (SELECT pool, id, f, row_number() OVER (PARTITION BY pool ORDER BY f) AS place FROM o) SELECT pool, CAST(f // 10 AS BIGINT) AS query, id, CAST(place AS INTEGER) AS place FROM n WHERE place <= 5")
def callback_pool(spark, t):
    """Each query's best two that are not excluded, pooled."""
    r = dense(t).where("rank <= 20").select(F.expr("query % 3").alias("pool"), "query", "id", "rank")
    excluded = spark.range(3).withColumnRenamed("id", "pool").crossJoin(t("embeddings").select(F.col("vec_id").alias("id")).where("id % 5 = 0"))
    return rt.pool_callbacks(r, excluded, 2, 5)


# ---------------------------------------------------------------- evaluation

METRICS = """f AS (SELECT g.*, {r}.rank FROM g LEFT JOIN {r} USING (query, id)),
    ps AS (SELECT query, set_index, min(rank) AS best, """ + ", ".join(f"avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END) AS r{k}" for k in ev.DEPTHS) + """ FROM f GROUP BY ALL),
    pm AS (SELECT query, """ + ", ".join(f"max(CASE WHEN r{k} > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit_{k}, round(max(r{k}), 9)::DOUBLE AS recall_{k}, max(CASE WHEN r{k} = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS success_{k}" for k in ev.DEPTHS) + """, round(coalesce(1.0::DOUBLE / min(best), 0), 9) AS mrr FROM ps GROUP BY query)"""


@query(f"WITH {DENSE}, {METRICS.format(r='k')} SELECT * FROM pm")
def multi_gold_metrics(spark, t):
    """hit, recall, success and MRR with alternative gold sets."""
    return ev.probe_metrics(gold(t), dense(t))


MEANS = ("hit_10", "recall_10", "success_10", "mrr")


@query(f"WITH {DENSE}, {METRICS.format(r='k')}, j AS (SELECT pm.*, u.label FROM pm JOIN u ON u.id = pm.query) SELECT CASE WHEN grouping(label) = 0 THEN 'label' ELSE 'overall' END AS scope, CAST(label AS VARCHAR) AS value, count(*) AS n, " + ", ".join(f"round(avg({c}), 9) AS {c}" for c in MEANS) + " FROM j GROUP BY GROUPING SETS ((), (label))")
def macro_means(spark, t):
    """Macro means over all probes and by label."""
    labels = t("embeddings").select(F.col("vec_id").alias("query"), "label")
    return ev.macro_means(ev.probe_metrics(gold(t), dense(t)).join(labels, "query"), MEANS, "label")


@query(f"WITH {DENSE}, h AS (SELECT k.query, k.id % 60 AS position, 20 + k.query % 40 AS cutoff FROM k WHERE rank <= 10) SELECT query, CAST(max(CASE WHEN position > cutoff THEN 1 ELSE 0 END) AS INTEGER) AS any_beyond, round(avg(CASE WHEN position > cutoff THEN 1.0 ELSE 0.0 END), 9) AS share_beyond FROM h GROUP BY query")
def spoiler_rates(spark, t):
    """Both spoiler definitions at depth 10."""
    r = dense(t).select("query", "rank", F.expr("id % 60").alias("position"))
    return ev.spoilers(r, stated(t).select("query", F.expr("20 + query % 40").alias("cutoff")))


def units(t) -> DataFrame:
    g = gold(t).where("set_index = 0").select("query", "id")
    return g.join(dense(t).select("query", "id", F.col("rank").alias("before")), ["query", "id"], "left").join(rt.rrf([dense(t), dense(t, 32)], depth=100).select("query", "id", F.col("rank").alias("after")), ["query", "id"], "left")


UNITS = f"""{DENSE}, a AS (SELECT query, id, rank FROM k WHERE rank <= 100 UNION ALL SELECT query, id, rank FROM m WHERE rank <= 100),
    s AS (SELECT query, id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score FROM a GROUP BY query, id),
    h AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s),
    un AS (SELECT g.query, g.id, k.rank AS before, h.rank AS after FROM g LEFT JOIN k USING (query, id) LEFT JOIN h USING (query, id) WHERE set_index = 0)"""
BUCKET = "CASE WHEN {0} IS NULL THEN 'MISSING' WHEN {0} <= 10 THEN 'TOP_10' WHEN {0} <= 20 THEN 'NEAR_MISS' WHEN {0} <= 50 THEN 'MID_RANK' ELSE 'DEEP_RANK' END"


@query(f"WITH {UNITS} SELECT query, id, CAST(before AS INTEGER) AS before, CAST(after AS INTEGER) AS after, {BUCKET.format('after')} AS bucket, CASE WHEN coalesce(before <= 10, false) AND coalesce(after <= 10, false) THEN 'STABLE_IN' WHEN coalesce(before <= 10, false) THEN 'LOST' WHEN coalesce(after <= 10, false) THEN 'GAINED' ELSE 'STABLE_OUT' END AS move FROM un")
def evidence_units(spark, t):
    """Per required unit: rank in two rankings, bucket and transition."""
    return units(t).withColumn("bucket", ev.rank_bucket(F.col("after"))).withColumn("move", ev.transition(F.col("before"), F.col("after")))


KEYS = ("TOP_10", "NEAR_MISS", "MID_RANK", "DEEP_RANK", "MISSING")


@query(f"WITH {UNITS}, b AS (SELECT {BUCKET.format('after')} AS key FROM un), c AS (SELECT key, count(*) AS c FROM b GROUP BY key) SELECT d.key, coalesce(c.c, 0)::BIGINT AS n, round(coalesce(c.c, 0) / greatest((SELECT count(*) FROM b), 1), 9) AS fraction FROM (VALUES " + ", ".join(f"('{k}')" for k in KEYS) + ") d(key) LEFT JOIN c USING (key)")
def bucket_distribution(spark, t):
    """Counts and fractions of every declared bucket, zero-filled."""
    return ev.distribution(units(t).withColumn("bucket", ev.rank_bucket(F.col("after"))), "bucket", KEYS)


@query(f"WITH {UNITS} SELECT count(*) AS n, count(*) FILTER (after < before) AS improved, count(*) FILTER (after = before) AS same, count(*) FILTER (after > before) AS worse, count(*) FILTER (coalesce(after <= 10, false) AND NOT coalesce(before <= 10, false)) AS gained, count(*) FILTER (coalesce(before <= 10, false) AND NOT coalesce(after <= 10, false)) AS lost, round(median(before), 9)::DOUBLE AS median_before, round(median(after), 9)::DOUBLE AS median_after FROM un")
def rank_shift(spark, t):
    """Improved, same, worse, crossings and medians."""
    return ev.rank_shift(units(t))


@query(f"WITH {UNITS}, c AS (SELECT kk.k, query, avg(CASE WHEN coalesce(before <= kk.k, false) THEN 1.0 ELSE 0.0 END) AS r, min(CASE WHEN coalesce(before <= kk.k, false) THEN 1 ELSE 0 END) AS al FROM un, (VALUES (1), (5), (10), (20), (50), (100)) kk(k) GROUP BY kk.k, query) SELECT CAST(k AS INTEGER) AS k, round(avg(r), 9) AS recall, round(avg(al), 9) AS success FROM c GROUP BY k")
def completeness_curve(spark, t):
    """Macro recall and full success over several depths."""
    return ev.completeness_curve(units(t).select("query", F.col("before").alias("rank")), (1, 5, 10, 20, 50, 100))


@query(f"WITH {UNITS} SELECT query, CASE WHEN count(after) = count(*) THEN max(after) END::INTEGER AS worst FROM un GROUP BY query")
def worst_required_rank(spark, t):
    return ev.worst_required(units(t).select("query", F.col("after").alias("rank")))


@query(f"WITH {UNITS}, p AS (SELECT query, avg(CASE WHEN coalesce(after <= 10, false) THEN 1.0 ELSE 0.0 END) AS r, count(*) FILTER (after <= 10) AS hits, count(*) AS u FROM un GROUP BY query) SELECT round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 9) AS any_rate, round(avg(CASE WHEN r = 1 THEN 1.0 ELSE 0.0 END), 9) AS all_rate, round(avg(r), 9) AS macro_recall, sum(hits)::BIGINT AS hit_units, sum(u)::BIGINT AS all_units, round(sum(hits) / sum(u), 9) AS micro_recall FROM p")
def micro_and_macro(spark, t):
    return ev.micro_and_macro(units(t).select("query", F.col("after").alias("rank")))


@query(f"WITH {DENSE}, a AS (SELECT query, id, 0 AS i, rank FROM k UNION ALL SELECT query, id, 1, rank FROM m), b AS (SELECT query, id, min(rank * 10 + i) AS x FROM a GROUP BY ALL) SELECT query, id, CAST(x // 10 AS INTEGER) AS best_rank, CAST(x % 10 AS INTEGER) AS best_index FROM b WHERE x // 10 <= 5")
def best_subquery_rank(spark, t):
    """Least rank over sub-queries and the lowest index that reaches it."""
    r = dense(t).select("query", "id", F.lit(0).alias("index"), "rank").unionByName(dense(t, 32).select("query", "id", F.lit(1).alias("index"), "rank"))
    return ev.best_subquery(r).where("best_rank <= 5")


@query(f"WITH {DENSE}, a AS (SELECT query, list(id) AS x FROM k WHERE rank <= 10 GROUP BY query), b AS (SELECT query, list(id) AS y FROM m WHERE rank <= 10 GROUP BY query), c AS (SELECT query, len(y) - len(list_intersect(x, y)) AS introduced, len(list_intersect(x, y)) AS i FROM a JOIN b USING (query)) SELECT query, CAST(introduced AS INTEGER) AS introduced, round(i / (20 - i), 9) AS jaccard, introduced > 0 AS changed FROM c")
def top10_changes(spark, t):
    return ev.top_changes(dense(t), dense(t, 32))


def paired(t) -> DataFrame:
    a, b = (ev.probe_metrics(whole_gold(t), dense(t, dims)) for dims in (64, 32))
    return a.select("query", F.col("recall_10").alias("x"), F.col("hit_1").alias("hx")).join(b.select("query", F.col("recall_10").alias("y"), F.col("hit_1").alias("hy")), "query")


@query()
def paired_statistics(spark, t):
    """Bootstrap interval, exact McNemar and exact sign-flip test of two rankings."""
    p = paired(t)
    return ev.paired_bootstrap(p, "x", "y", 2000).crossJoin(ev.mcnemar(p, "hx", "hy").withColumnRenamed("p", "p_mcnemar")).crossJoin(ev.sign_flip(p, "x", "y").withColumnRenamed("p", "p_sign_flip"))


# ---------------------------------------------------------------- ingestion

LINES = """l0 AS (SELECT doc_id AS doc, unnest(regexp_extract_all(text, '[^\\r\\n]*(?:\\r\\n|\\n|\\r)|[^\\r\\n]+')) AS raw, generate_subscripts(regexp_extract_all(text, '[^\\r\\n]*(?:\\r\\n|\\n|\\r)|[^\\r\\n]+'), 1) - 1 AS line FROM documents),
    l1 AS (SELECT doc, line, regexp_replace(raw, '(\\r\\n|\\n|\\r)$', '') AS content, raw, coalesce(sum(length(raw)) OVER w, 0)::BIGINT AS char_start, coalesce(sum(strlen(raw)) OVER w, 0)::BIGINT AS byte_start FROM l0 WINDOW w AS (PARTITION BY doc ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT doc, line, content, char_start, char_start + length(content) AS char_end, byte_start, byte_start + strlen(content) AS byte_end FROM l1)"""


def line_rows(t) -> DataFrame:
    return ig.scan_lines(t("documents").select(F.col("doc_id").alias("doc"), "text"))


@query(f"WITH {LINES} SELECT doc, CAST(line AS INTEGER) AS line, char_start, char_end, byte_start, byte_end, sha256(content) AS sha FROM l")
def line_scan(spark, t):
    """Lines with exact code point and byte offsets."""
    return line_rows(t).select("doc", "line", "char_start", "char_end", "byte_start", "byte_end", F.sha2("content", 256).alias("sha"))


def dense_paragraphs(t) -> DataFrame:
    """Documents without blank lines: each non-blank line is a paragraph (the dense layout's rule)."""
    rows = line_rows(t).where("not blank")
    return rows.select("doc", F.row_number().over(Window.partitionBy("doc").orderBy("line")).alias("ordinal"), "char_start", "char_end", "byte_start", "byte_end")


@query(f"WITH {LINES}, s AS (SELECT *, sum(CASE WHEN regexp_matches(content, '^\\s*$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line) AS island FROM l) SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY min(char_start)) AS INTEGER) AS ordinal, min(char_start) AS char_start, max(char_end) AS char_end, min(byte_start) AS byte_start, max(byte_end) AS byte_end FROM s WHERE NOT regexp_matches(content, '^\\s*$') GROUP BY doc, island")
def paragraph_spans(spark, t):
    """Maximal runs of lines that are not blank."""
    return ig.paragraphs(line_rows(t)).select("doc", "ordinal", "char_start", "char_end", "byte_start", "byte_end")


PACKED = """d AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY line) AS n, char_start AS a, char_end AS b FROM l WHERE NOT regexp_matches(content, '^\\s*$')),
    w AS (SELECT doc, n, a, b, CASE WHEN b - a <= 1200 THEN a END AS s, n AS f FROM d WHERE n = 1
        UNION ALL SELECT d.doc, d.n, d.a, d.b, CASE WHEN d.b - d.a > 1200 THEN NULL WHEN d.b - w.s <= 1200 THEN w.s ELSE d.a END, CASE WHEN d.b - w.s <= 1200 AND d.b - d.a <= 1200 THEN w.f ELSE d.n END FROM w JOIN d ON d.doc = w.doc AND d.n = w.n + 1),
    x AS (SELECT doc, s AS char_start, max(b) AS char_end, f AS first_paragraph, max(n) AS last_paragraph, 'PACK' AS reason FROM w WHERE s IS NOT NULL GROUP BY doc, s, f
        UNION ALL SELECT doc, c, least(c + 1200, b), n, n, 'HARD_SPLIT' FROM (SELECT doc, n, b, unnest(range(a, b, 1200)) AS c FROM w WHERE s IS NULL))"""


@query(f"WITH RECURSIVE {LINES}, {PACKED} SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY char_start) AS INTEGER) AS chunk, char_start, char_end, CAST(first_paragraph AS INTEGER) AS first_paragraph, CAST(last_paragraph AS INTEGER) AS last_paragraph, reason FROM x")
def paragraph_pack(spark, t):
    """Paragraphs packed into chunks of at most 1,200 characters."""
    return ig.pack_paragraphs(dense_paragraphs(t))


GAPS = """g AS (SELECT doc, ordinal, char_start, char_end + CASE WHEN ordinal % 4 = 1 THEN 9 ELSE 0 END AS char_end FROM x WHERE ordinal % 3 <> 0),
    y AS (SELECT doc, char_start, coalesce(lag(char_end) OVER (PARTITION BY doc ORDER BY char_start), 0) AS last_end FROM g UNION ALL SELECT doc, NULL, max(char_end) FROM g GROUP BY doc),
    z AS (SELECT doc, char_start, last_end, substr(text, last_end + 1, greatest(coalesce(char_start, length(text)) - last_end, 0)) AS gap FROM y JOIN documents ON doc_id = doc)"""
ISLANDS = "s AS (SELECT *, sum(CASE WHEN regexp_matches(content, '^\\s*$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line) AS island FROM l), x AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY min(char_start)) AS ordinal, min(char_start) AS char_start, max(char_end) AS char_end FROM s WHERE NOT regexp_matches(content, '^\\s*$') GROUP BY doc, island)"


@query(f"WITH {LINES}, {ISLANDS}, {GAPS} SELECT doc, coalesce(char_start, last_end)::BIGINT AS char_start, CASE WHEN char_start < last_end THEN 'OVERLAP' ELSE 'TEXT_OUTSIDE' END AS kind FROM z WHERE coalesce(char_start < last_end, false) OR NOT regexp_matches(gap, '^\\s*$')")
def coverage_gaps(spark, t):
    """Text outside all spans, and overlaps, where every third paragraph is taken out and every fourth reaches too far."""
    spans = ig.paragraphs(line_rows(t)).where("ordinal % 3 <> 0").withColumn("char_end", F.expr("char_end + if(ordinal % 4 = 1, 9, 0)"))
    return ig.gap_violations(spans, t("documents").select(F.col("doc_id").alias("doc"), "text"))


@query("SELECT doc_id AS doc, 0::BIGINT AS char_start, '' AS kind FROM documents WHERE false")
def paragraph_coverage(spark, t):
    """The paragraphs as they are leave nothing out and do not overlap."""
    return ig.gap_violations(ig.paragraphs(line_rows(t)), t("documents").select(F.col("doc_id").alias("doc"), "text"))


@query("SELECT source AS story, sha256(string_agg(CASE WHEN doc_id < 100 THEN lpad(CAST(doc_id AS VARCHAR), 3, '0') ELSE CAST(doc_id AS VARCHAR) END || ':' || sha256(text), chr(10) ORDER BY doc_id)) AS fingerprint FROM documents GROUP BY source")
def corpus_fingerprints(spark, t):
    return ig.corpus_fingerprint(passages(t).select("story", F.col("position").alias("order"), "text"))


WINDOWS = "n AS (SELECT doc_id AS doc, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS n FROM documents)"


@query(f"WITH {WINDOWS}, w AS (SELECT doc, n, unnest(range(0, greatest(ceil((n - 448) / 384.0), 0)::BIGINT + 1)) AS k FROM n WHERE n > 0) SELECT doc, CAST(k AS INTEGER) AS \"window\", k * 384 AS start, least(k * 384 + 448, n) AS \"end\" FROM w")
def token_windows(spark, t):
    """Overlapping windows of 448 tokens every 384."""
    return ig.token_windows(t("documents").select(F.col("doc_id").alias("doc"), F.size(tx.word_tokens(F.col("text"))).alias("n_tokens")))


@query("WITH s AS (SELECT doc_id AS doc, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS r FROM documents) SELECT doc, len(r)::DOUBLE AS lines_per_paragraph, round(len(list_filter(r, lambda x: regexp_matches(x, '[.!?。！？」』…]\"?$'))) / greatest(len(r), 1), 9)::DOUBLE AS sentence_end_share, CASE WHEN len(r) >= 4 AND len(list_filter(r, lambda x: regexp_matches(x, '[.!?。！？」』…]\"?$'))) / greatest(len(r), 1) >= 0.7 THEN 'SPLIT_LINES' ELSE 'KEEP' END AS decision FROM s")
def layout_decision(spark, t):
    return ig.layout(t("documents").select(F.col("doc_id").alias("doc"), "text"))


@query("SELECT page_id AS id, list_filter([CASE WHEN contains(html, '```') THEN 'code_fence' END, CASE WHEN regexp_matches(html, '(?m)^#{1,6} ') THEN 'heading' END, CASE WHEN regexp_matches(html, '</?[a-z]+[^>]*>') THEN 'html_tag' END, CASE WHEN regexp_matches(html, '(?i)\\[(todo|tbd|insert[^\\]]*|placeholder)\\]') THEN 'placeholder' END], lambda x: x IS NOT NULL) AS found FROM pages")
def artifact_detection(spark, t):
    return t("pages").select(F.col("page_id").alias("id"), tx.artifacts(F.col("html")).alias("found"))


@query("SELECT doc_id, CAST(i - 1 AS INTEGER) AS unit, substr(sha256(u), 1, 16) AS sha FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS u, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)")
def text_units(spark, t):
    """Units of a text with short digests."""
    return t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("unit", "u")).select("doc_id", "unit", F.substring(F.sha2("u", 256), 1, 16).alias("sha"))


# ---------------------------------------------------------------- rules and memory

@query("""SELECT 'orders.customer' AS rule, CAST(o_custkey AS VARCHAR) AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'lineitem.order', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'labels.document', CAST(doc_id AS VARCHAR) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT 'documents.id', CAST(doc_id AS VARCHAR) FROM documents GROUP BY doc_id HAVING count(*) > 1
    UNION ALL SELECT 'unlabelled', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def reference_integrity(spark, t):
    """Dangling references and repeated ids."""
    d, lab = t("documents"), t("labels")
    parts = [gr.dangling(t("orders"), "o_custkey", t("customer"), "c_custkey", "orders.customer"), gr.dangling(t("lineitem"), "l_orderkey", t("orders"), "o_orderkey", "lineitem.order"), gr.dangling(lab, "doc_id", d, "doc_id", "labels.document"), gr.duplicated(d, "doc_id", "documents.id"), gr.dangling(d, "doc_id", lab, "doc_id", "unlabelled")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT event_type AS stage, count(*) AS calls, round(sum(coalesce(value, 0)), 6) AS tokens FROM events GROUP BY ROLLUP (event_type)")
def usage_rollup(spark, t):
    return me.usage(t("events").select(F.col("event_type").alias("stage"), F.col("value").alias("tokens")))


@query("SELECT event_type, count(*) AS n, round(coalesce(quantile_cont(value, 0.5), 0), 6) AS p50, round(coalesce(quantile_cont(value, 0.95), 0), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark, t):
    """Exact percentiles by linear interpolation; empty is 0."""
    return t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), *(F.round(F.coalesce(F.percentile("value", p), F.lit(0.0)), 6).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"))))


@query("SELECT event_type, list_sort(list(user_id))[len(list(user_id)) // 2 + 1] AS upper_median FROM events GROUP BY event_type")
def upper_medians(spark, t):
    return t("events").groupBy("event_type").agg(ev.upper_median(F.col("user_id")).alias("upper_median"))


@query("""WITH h AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS rn FROM conversations WHERE [conv_id, turn] <= [(SELECT max(conv_id) * 3 // 4 FROM conversations), 3])
    SELECT conv_id, role, turn AS as_of, sha256(text) AS state FROM h WHERE rn = 1""")
def as_of_latest(spark, t):
    """Latest state per conversation and role at or before a position (lexicographic)."""
    last = t("conversations").agg(F.max("conv_id")).first()[0] or 0
    c = t("conversations").withColumn("position", F.array("conv_id", "turn")).where(F.col("position") <= F.array(F.lit(last * 3 // 4).cast("long"), F.lit(3).cast("long")))
    return c.groupBy("conv_id", "role").agg(F.max(F.struct("turn", "text")).alias("m")).select("conv_id", "role", F.col("m.turn").alias("as_of"), F.sha2("m.text", 256).alias("state"))


@query("""WITH s AS (SELECT least(p.l_suppkey, p.l_partkey) AS a, greatest(p.l_suppkey, p.l_partkey) AS b, p.l_orderkey AS pos, p.l_linenumber AS ln FROM lineitem p WHERE p.l_suppkey <> p.l_partkey AND p.l_orderkey < (SELECT max(l_orderkey) FROM lineitem)),
    r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY pos DESC, ln DESC) AS n FROM s) SELECT [CAST(a AS BIGINT), CAST(b AS BIGINT)] AS pair, CAST(ln AS BIGINT) AS state, CAST(pos AS BIGINT) AS as_of FROM r WHERE n = 1""")
def latest_pair_states(spark, t):
    """Latest state of each unordered pair strictly before a position."""
    rows = t("lineitem").select(F.col("l_suppkey").cast("long").alias("a"), F.col("l_partkey").cast("long").alias("b"), F.col("l_orderkey").cast("long").alias("position"), F.col("l_linenumber").cast("long").alias("state"))
    return me.latest_states(rows, F.lit(rows.agg(F.max("position")).first()[0]))


SEGMENTS = "s AS (SELECT conv_id AS doc, turn AS position, (conv_id * 31 + turn * 17) % 9 = 0 AS exposed FROM conversations)"


def exposure(t) -> DataFrame:
    return t("conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("position"), F.expr("(conv_id * 31 + turn * 17) % 9 = 0").alias("exposed"))


@query(f"WITH {SEGMENTS}, h AS (SELECT *, max(CASE WHEN exposed THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY position ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM s) SELECT doc, position FROM h WHERE near = 1 AND NOT exposed")
def exposure_halo(spark, t):
    return me.halo(exposure(t))


CLIPPED = "s1 AS (SELECT doc, position, exposed, row_number() OVER (PARTITION BY doc ORDER BY position) AS i, sum(CASE WHEN exposed THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY position) AS island FROM s), s2 AS (SELECT doc, position, greatest(i - 3, min(i) OVER w) AS low, least(i + 3, max(i) OVER w) AS high FROM s1 WHERE NOT exposed WINDOW w AS (PARTITION BY doc, island))"


@query(f"WITH {SEGMENTS}, {CLIPPED} SELECT doc, position, CAST(low AS INTEGER) AS low, CAST(high AS INTEGER) AS high FROM s2 WHERE high - low + 1 >= 3")
def clipped_windows(spark, t):
    return me.clipped_windows(exposure(t).withColumnRenamed("exposed", "excluded"), least=3)


@query()
def case_selection(spark, t):
    """Hash-ordered, diversity-limited selection of disjoint windows."""
    w = me.clipped_windows(exposure(t).withColumnRenamed("exposed", "excluded"), least=3)
    h = me.hash_order("protocol", F.lit("corpus"), F.concat_ws(".", "doc", "position"))
    return me.select_cases(w.withColumn("pool", F.expr("doc % 4")).withColumn("hash", h), 20)


@query("""WITH o AS (SELECT substr(sha256(text), 1, 16) AS sha, doc_id AS pos, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents WHERE doc_id % 2 = 0),
    w AS (SELECT substr(sha256(text), 1, 16) AS sha, doc_id AS pos, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS n FROM documents WHERE doc_id % 2 = 1)
    SELECT o.pos AS old_position, w.pos AS new_position FROM o JOIN w USING (sha, n)""")
def unit_carry_over(spark, t):
    """Equal units of two versions, n-th occurrence with n-th."""
    d = t("documents").select(F.col("doc_id").alias("position"), F.substring(F.sha2("text", 256), 1, 16).alias("sha"))
    return me.carry_over(d.where("position % 2 = 0"), d.where("position % 2 = 1"))


@query("""WITH s AS (SELECT l_orderkey AS doc, l_linenumber * 10 AS start, l_linenumber * 10 + CAST(l_quantity AS INTEGER) AS "end" FROM lineitem),
    f AS (SELECT *, max("end") OVER (PARTITION BY doc ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s),
    g AS (SELECT *, sum(CASE WHEN far IS NULL OR start > far THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM f)
    SELECT CAST(doc AS BIGINT) AS doc, CAST(min(start) AS BIGINT) AS start, CAST(max("end") AS BIGINT) AS "end" FROM g GROUP BY doc, island""")
def highlight_spans(spark, t):
    """Overlapping and touching spans merged."""
    s = t("lineitem").select(F.col("l_orderkey").cast("long").alias("doc"), (F.col("l_linenumber") * 10).cast("long").alias("start"), (F.col("l_linenumber") * 10 + F.rint("l_quantity")).cast("long").alias("end"))
    return me.merged_spans(s)


SPANS = """a AS (SELECT l_orderkey * 10 + l_linenumber AS p_id, l_suppkey AS segment, l_partkey AS p_start, l_partkey + CAST(l_quantity AS INTEGER) AS p_end FROM lineitem WHERE l_orderkey % 2 = 0),
    b AS (SELECT l_orderkey * 10 + l_linenumber AS g_id, l_suppkey AS segment, l_partkey + 2 AS g_start, l_partkey + 2 + CAST(l_quantity AS INTEGER) // 4 AS g_end, l_suppkey % 5 = 0 AS narrow FROM lineitem WHERE l_orderkey % 2 = 1)"""


def spans(t, odd: int) -> DataFrame:
    x = t("lineitem").where(F.expr(f"l_orderkey % 2 = {odd}"))
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long")
    q = F.floor("l_quantity").cast("int")
    if odd:
        return x.select(key.alias("g_id"), F.col("l_suppkey").cast("long").alias("segment"), (F.col("l_partkey") + 2).alias("g_start"), (F.col("l_partkey") + 2 + F.floor(q / 4)).alias("g_end"), (F.col("l_suppkey") % 5 == 0).alias("narrow"))
    return x.select(key.alias("p_id"), F.col("l_suppkey").cast("long").alias("segment"), F.col("l_partkey").alias("p_start"), (F.col("l_partkey") + q).alias("p_end"))


@query(f"WITH {SPANS} SELECT CAST(p_id AS BIGINT) AS p_id, CAST(g_id AS BIGINT) AS g_id, CAST(segment AS BIGINT) AS segment FROM a JOIN b USING (segment) WHERE CASE WHEN narrow THEN p_start = g_start AND p_end = g_end ELSE p_start <= g_start AND g_end <= p_end END")
def containment_join(spark, t):
    """Predicted spans that hold gold spans in the same segment."""
    return gr.span_matches(spans(t, 0), spans(t, 1))


@query(f"WITH {SPANS} SELECT CAST(p_id AS BIGINT) AS l_id, CAST(g_id AS BIGINT) AS r_id, CAST(segment AS BIGINT) AS segment FROM a JOIN b USING (segment) WHERE p_start < g_end AND g_start < p_end")
def overlap_join(spark, t):
    left = spans(t, 0).select(F.col("p_id").alias("l_id"), "segment", F.col("p_start").alias("l_start"), F.col("p_end").alias("l_end"))
    right = spans(t, 1).select(F.col("g_id").alias("r_id"), "segment", F.col("g_start").alias("r_start"), F.col("g_end").alias("r_end"))
    return gr.span_overlaps(left, right)


@query("""WITH RECURSIVE e AS (SELECT vec_id AS a, vec_id // 2 AS b FROM embeddings WHERE vec_id % 7 <> 0),
    w AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT w.node, e.b FROM w JOIN e ON w.root = e.a)
    SELECT node, min(root) AS root FROM w GROUP BY node""")
def component_roots(spark, t):
    """Connected components with the smallest member as root (edges: id to id div 2)."""
    v = t("embeddings").select(F.col("vec_id").alias("node"))
    return gr.components(v, v.where("node % 7 <> 0").select(F.col("node").alias("a"), F.expr("node div 2").alias("b")))


@query()
def availability_fixpoint(spark, t):
    """Least positions at which assertions are supported (synthetic sets and derivations over ids)."""
    v = t("embeddings").select(F.col("vec_id").alias("assertion"))
    sets = v.where("assertion % 5 < 2").select("assertion", F.lit(0).alias("path"), F.expr("array(cast(assertion % 17 as int), cast(assertion % 3 as int))").alias("position"), F.expr("assertion % 10 <> 0").alias("grounding"), F.lit(True).alias("sufficient"))
    premises = v.where("assertion % 5 > 1").select("assertion", F.lit(1).alias("path"), F.explode(F.expr("array(assertion div 2, assertion div 3)")).alias("premise"))
    return gr.availability(v.withColumn("rejected", F.expr("assertion % 13 = 0")), sets, premises)


@query("""WITH s AS (SELECT doc_id % 200 AS content, CASE WHEN quality = 1 THEN 'AFFIRMED' ELSE 'NEGATED' END AS polarity, toxic = 0 AS commits, doc_id % 3 = 0 AS bounded FROM labels),
    c AS (SELECT content, count(*) FILTER (commits AND polarity = 'AFFIRMED') AS y, count(*) FILTER (commits AND polarity = 'NEGATED') AS n, count(*) FILTER (commits AND NOT bounded) AS loose FROM s GROUP BY content)
    SELECT content, CASE WHEN y > 0 AND n > 0 THEN CASE WHEN loose = 0 THEN 'TIME_SCOPED' ELSE 'CONTESTED' END WHEN y > 0 THEN 'AFFIRMED' WHEN n > 0 THEN 'NEGATED' ELSE 'UNCOMMITTED' END AS status FROM c""")
def commitment_status(spark, t):
    s = t("labels").select(F.expr("doc_id % 200").alias("content"), F.when(F.col("quality") == 1, "AFFIRMED").otherwise("NEGATED").alias("polarity"), (F.col("toxic") == 0).alias("commits"), F.expr("doc_id % 3 = 0").alias("bounded"))
    return gr.commitments(s)


@query("""WITH v AS (SELECT o_custkey AS k, o_orderkey AS a, o_orderstatus AS v, o_orderkey % 7 AS s, o_orderkey % 11 AS e FROM orders)
    SELECT CAST(x.k AS BIGINT) AS key, CAST(x.a AS BIGINT) AS first, CAST(y.a AS BIGINT) AS second FROM v x JOIN v y ON x.k = y.k AND x.a < y.a AND x.v <> y.v WHERE NOT (x.e = y.s OR y.e = x.s)""")
def functional_conflicts(spark, t):
    """Different values of one key that are not provably disjoint in time."""
    return gr.functional_conflicts(t("orders").select(F.col("o_custkey").cast("long").alias("key"), F.col("o_orderkey").cast("long").alias("assertion"), F.col("o_orderstatus").alias("value"), F.expr("o_orderkey % 7").alias("start_anchor"), F.expr("o_orderkey % 11").alias("end_anchor")))


GATES = (("CONSISTENCY", "view"), ("CONSISTENCY", "click"), ("SAFETY", "error"), ("COVERAGE", "nothing"))


@query("WITH f AS (SELECT event_type AS category, CASE WHEN value > 95 THEN 'CRITICAL' ELSE 'LOW' END AS severity FROM events), g(gate, category) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in GATES) + ") SELECT gate, CASE WHEN count(*) FILTER (severity = 'CRITICAL') > 0 THEN 'FAIL' WHEN count(severity) > 0 THEN 'FLAG' ELSE 'PASS' END AS status, count(severity) AS n FROM g LEFT JOIN f USING (category) GROUP BY gate")
def gate_report(spark, t):
    f = t("events").select(F.col("event_type").alias("category"), F.when(F.col("value") > 95, "CRITICAL").otherwise("LOW").alias("severity"))
    return me.gates(f, spark.createDataFrame(GATES, "gate string, category string"))


CASES = "c AS (SELECT user_id AS \"case\", count(*) AS predicted, count(*) FILTER (value > 30) AS supported, count(*) FILTER (event_type = 'purchase') AS required, count(*) FILTER (event_type = 'purchase' AND value > 50) AS recovered, count(*) FILTER (value < 0.02) AS pending FROM events GROUP BY user_id)"


def cases(t) -> DataFrame:
    return t("events").groupBy(F.col("user_id").alias("case")).agg(F.count(F.lit(1)).alias("predicted"), F.count_if(F.col("value") > 30).alias("supported"), F.count_if(F.col("event_type") == "purchase").alias("required"), F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 50)).alias("recovered"), F.count_if(F.col("value") < 0.02).alias("pending"))


@query(f"WITH {CASES} SELECT \"case\", CASE WHEN pending = 0 THEN round(supported / nullif(predicted, 0), 4) END AS precision, round(recovered / nullif(required, 0), 4) AS recall FROM c")
def extraction_scores(spark, t):
    """Precision (null while a prediction is pending) and recall per case."""
    return me.extraction_scores(cases(t))


@query(f"WITH {CASES} SELECT CASE WHEN sum(pending) = 0 THEN round(sum(supported) / nullif(sum(predicted), 0), 4) END AS precision, round(sum(recovered) / nullif(sum(required), 0), 4) AS recall FROM c")
def extraction_micro(spark, t):
    return me.micro_scores(cases(t))


def machine_events(t) -> DataFrame:
    return t("events").select(F.col("user_id").cast("long").alias("key"), F.col("event_id").cast("long").alias("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").cast("double").alias("value"), F.col("event_type").alias("kind")).withColumn("at", F.col("us") / 1e6).drop("us")


@query()
def rolling_limiter(spark, t):
    """Rolling request and token limits per key, replayed."""
    return st.replay(machine_events(t), lambda **k: st.RollingLimiter(2, 120.0, 86400.0, **k))


@query()
def adaptive_limiter(spark, t):
    return st.replay(machine_events(t), lambda **k: st.AdaptiveLimiter(4, 200.0, 86400.0, 3600.0, **k))


@query()
def circuit_breaker(spark, t):
    return st.replay(machine_events(t), lambda **k: st.CircuitBreaker(threshold=1, cooldown=86400.0, **k))


@query()
def durable_jobs(spark, t):
    return st.replay(machine_events(t), lambda **k: st.DurableJob(cooldown=3600.0, **k))
