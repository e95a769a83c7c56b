"""Retrieval: BM25, dense cosine, window pooling, fusion, re-ranking, diversity and delivery, all as DataFrames.

A ranking is a DataFrame (query, id, rank, score), ranks from 1, without gaps.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import stored

DIGITS = 9
#: Query tokens that may be broadcast; beyond that the join shuffles.
BROADCAST_TOKENS = 1_000_000
#: Query vectors that may be broadcast.
BROADCAST_QUERIES = 10_000


def ranked(scores: DataFrame, *ties: str | Column, k: int | None = None, partition: Sequence[str] = ("query",)) -> DataFrame:
    """Rank rows by falling score within a partition, ties by the given columns; at most k each.

    The row-number limit is applied before the shuffle, so that a partition sends at most k rows per task.
    """
    over = Window.partitionBy(*partition).orderBy(F.desc("score"), *(ties or ("id",)))
    out = scores.withColumn("rank", F.row_number().over(over))
    return out if k is None else out.where(F.col("rank") <= k)


def bm25_scores(passages: DataFrame, queries: DataFrame, allowed: Column | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query, id, score) for positive scores. passages: id, tokens and whatever `allowed` needs; queries: query, tokens.

    Statistics cover all passages given; `allowed` only restricts which are scored. Where queries have a column
    `cutoff`, passages must have `position`, and a query scores those up to its own cutoff. A query's repeated tokens
    count once. Term counts are taken only for tokens that some query holds; they are written once and read twice.
    """
    as_of = "cutoff" in queries.columns
    stats = passages.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("tokens")).alias("mean_length"))
    wanted = queries.select("query", *(["cutoff"] if as_of else []), F.explode(F.array_distinct("tokens")).alias("token"))
    vocabulary = wanted.select("token").distinct()
    if vocabulary.limit(BROADCAST_TOKENS + 1).count() <= BROADCAST_TOKENS:
        vocabulary = F.broadcast(vocabulary)
    carried = passages.withColumn("ok", F.lit(True) if allowed is None else F.coalesce(allowed, F.lit(False)))
    at = ["position"] if as_of else []
    terms = carried.select("id", "ok", *at, F.size("tokens").alias("length"), F.explode("tokens").alias("token"))
    terms = stored(terms.join(vocabulary, "token", "left_semi").groupBy("id", "ok", *at, "length", "token").agg(F.count(F.lit(1)).alias("tf")))
    df = terms.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weights = df.crossJoin(F.broadcast(stats)).select("token", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "mean_length")
    matched = terms.where("ok").join(weights, "token").join(wanted, "token")
    if as_of:
        matched = matched.where("position <= cutoff")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean_length")))
    return matched.groupBy("query", "id").agg(F.round(F.sum(part), DIGITS).alias("score")).where(F.col("score") > 0)


def unit(vector: Column) -> Column:
    """A vector over its length; zero stays zero, a value that is not finite is an error."""
    v = vector.cast("array<double>")
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    bad = F.exists(v, lambda x: F.isnan(x) | x.isNull() | (F.abs(x) == math.inf))
    return F.when(bad, F.raise_error(F.lit("a vector holds a value that is not finite")).cast("array<double>")).when(length == 0, v).otherwise(F.transform(v, lambda x: x / length))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_scores(passages: DataFrame, queries: DataFrame, allowed: Column | None = None) -> DataFrame:
    """(query, id, score) of every allowed passage with every query. passages: id, vector; queries: query, vector.

    The queries are a stated set and meet every passage. They are broadcast up to BROADCAST_QUERIES; more are dealt in
    blocks, and each block meets all passages by the block's number.
    """
    p = passages if allowed is None else passages.where(allowed)
    left = p.select("id", unit(F.col("vector")).alias("pv"))
    right = queries.select("query", unit(F.col("vector")).alias("qv"))
    n = queries.count()
    if n <= BROADCAST_QUERIES:
        both = left.crossJoin(F.broadcast(right))
    else:
        blocks = -(-n // BROADCAST_QUERIES)
        right = right.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
        both = left.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(right, "block")
    return both.select("query", "id", F.round(dot(F.col("pv"), F.col("qv")), DIGITS).alias("score"))


def window_max(window_scores: DataFrame, parents: DataFrame) -> DataFrame:
    """(query, id, score): the best of a parent's windows, -1 for a parent without windows. window_scores: query, id, score."""
    best = window_scores.groupBy("query", "id").agg(F.max("score").alias("best"))
    all_ = window_scores.select("query").distinct().crossJoin(F.broadcast(parents.select("id").distinct()))
    return all_.join(best, ["query", "id"], "left").select("query", "id", F.coalesce("best", F.lit(-1.0)).alias("score"))


def rrf(rankings: Sequence[DataFrame], constant: int = 60, depth: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: (query, id, rank, score); ties by id. depth: ranks beyond it are left out of each ranking."""
    parts = [r.select("query", "id", "rank") if depth is None else r.where(F.col("rank") <= depth).select("query", "id", "rank") for r in rankings]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    score = F.round(F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))), 12)
    return ranked(union.groupBy("query", "id").agg(score.alias("score")), "id")


def hybrid_depth(k: int) -> int:
    return max(k, 100)


def rank_sum_consensus(first: DataFrame, second: DataFrame) -> DataFrame:
    """Order by rank sum, then worse rank, better rank, id, over the candidates of two rankings (which must be the same)."""
    a = first.select("query", "id", F.col("rank").alias("k"))
    b = second.select("query", "id", F.col("rank").alias("m"))
    both = a.join(b, ["query", "id"], "full")
    same = F.when(F.col("k").isNull() | F.col("m").isNull(), F.raise_error(F.lit("the two rankings hold different candidates")).cast("int")).otherwise(F.col("k") + F.col("m"))
    order = Window.partitionBy("query").orderBy("rank_sum", F.greatest("k", "m"), F.least("k", "m"), "id")
    return both.withColumn("rank_sum", same).withColumn("rank", F.row_number().over(order)).select("query", "id", "k", "m", "rank_sum", "rank")


def rerank_splice(ranking: DataFrame, scores: DataFrame, depth: int = 30) -> DataFrame:
    """The first `depth` in order of model score (then old rank, then id), the rest after them as before."""
    head = ranking.where(F.col("rank") <= depth).select("query", "id", F.col("rank").alias("old")).join(scores.select("query", "id", "score"), ["query", "id"], "left")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "old", "id")
    head = head.withColumn("rank", F.row_number().over(order)).select("query", "id", "rank")
    return head.unionByName(ranking.where(F.col("rank") > depth).select("query", "id", "rank"))


def mmr(candidates: DataFrame, k: int = 10, balance: float = 0.7, tolerance: float = 1e-9) -> DataFrame:
    """Maximal marginal relevance over each query's candidates (query, id, score = relevance, vector); score stays relevance.

    Greedy, so each query's candidates (a bounded top-n) are one group of a grouped pandas function.
    """

    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        rows = rows.sort_values("id", kind="stable").reset_index(drop=True)
        vectors, relevance = np.array(rows["vector"].tolist(), dtype=float), rows["score"].to_numpy()
        near, left, out = np.full(len(rows), -np.inf), list(range(len(rows))), []
        while left and len(out) < k:
            best, pick = -np.inf, None
            for i in left:  # in order of id: a later one must win by more than the tolerance
                value = balance * relevance[i] - ((1 - balance) * near[i] if out else 0.0)
                if value > best + tolerance:
                    best, pick = value, i
            out.append(pick)
            left.remove(pick)
            near = np.maximum(near, vectors @ vectors[pick])
        return pd.DataFrame({"query": key[0], "id": rows["id"].iloc[out].to_numpy(), "rank": range(1, len(out) + 1), "score": relevance[out]})

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    return candidates.select("query", "id", "score", "vector").groupBy("query").applyInPandas(choose, f"query {kinds['query']}, id {kinds['id']}, rank int, score double")


def deliver(passages: DataFrame, budget: int) -> DataFrame:
    """(query, id, place, delivered): passages once each at their first rank, the first `budget` delivered, the rest overflow."""
    once = passages.groupBy("query", "id").agg(F.min("rank").alias("first"))
    order = Window.partitionBy("query").orderBy("first", "id")
    return once.withColumn("place", F.row_number().over(order)).select("query", "id", "place", (F.col("place") <= budget).alias("delivered"))


def concatenate_routes(first: DataFrame, second: DataFrame, budget: int) -> DataFrame:
    """First route's ids, then the second's that are not among them, cut at the budget."""
    union = first.select("query", "id", F.lit(0).alias("route"), "rank").unionByName(second.select("query", "id", F.lit(1).alias("route"), "rank"))
    once = union.groupBy("query", "id").agg(F.min(F.struct("route", "rank")).alias("at"))
    order = Window.partitionBy("query").orderBy("at.route", "at.rank", "id")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= budget).select("query", "id", F.col("at.route").alias("route"), "place")


def pool_callbacks(ranking: DataFrame, excluded: DataFrame, per_query: int = 2, limit: int = 8) -> DataFrame:
    """(pool, query, id, place): each query's best ids that are not excluded, pooled in query order, first wins.

    ranking: pool, query (an integer order), id, rank; excluded: pool, id.
    """
    open_ = ranking.join(excluded, ["pool", "id"], "left_anti")
    top = open_.withColumn("place", F.row_number().over(Window.partitionBy("pool", "query").orderBy("rank"))).where(F.col("place") <= per_query)
    once = top.groupBy("pool", "id").agg(F.min(F.struct("query", "place")).alias("at"))
    order = Window.partitionBy("pool").orderBy("at.query", "at.place")
    return once.withColumn("order", F.row_number().over(order)).where(F.col("order") <= limit).select("pool", F.col("at.query").alias("query"), "id", F.col("order").alias("place"))


def top_candidates(ranking: DataFrame, depth: int = 30) -> DataFrame:
    """The ranking's prefix; a repeated candidate is an error."""
    head = ranking.where(F.col("rank") <= depth)
    counts = head.groupBy("query", "id").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.when(F.col("n") > 1, F.raise_error(F.lit("a candidate is repeated")).cast("int")).otherwise(F.col("rank"))).select("query", "id", "rank")
