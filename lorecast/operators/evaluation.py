"""Retrieval evaluation: multi-gold metrics, spoiler rates, rank diagnostics, transitions, macro means, statistics."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTHS = (1, 3, 5, 10)


def normalize_gold(probes: DataFrame) -> DataFrame:
    """(query, set_index, id) from query, gold (list of lists of ids). Empty sets, repeated ids and repeated sets are errors."""
    sets = probes.select("query", F.posexplode("gold").alias("set_index", "ids"))
    ids = F.array_sort("ids")
    checked = sets.withColumn("ids", F.when((F.size("ids") == 0) | (F.size(F.array_distinct("ids")) < F.size("ids")), F.raise_error(F.lit("a gold set is empty or repeats an id")).cast(sets.schema["ids"].dataType)).otherwise(ids))
    repeated = checked.groupBy("query", "ids").agg(F.min("set_index").alias("set_index"), F.count(F.lit(1)).alias("n"))
    at = F.when(F.col("n") > 1, F.raise_error(F.lit("a gold set is repeated")).cast("int")).otherwise(F.col("set_index"))
    return repeated.select("query", at.alias("set_index"), F.explode("ids").alias("id"))


def probe_metrics(gold: DataFrame, rankings: DataFrame, depths: Sequence[int] = DEPTHS) -> DataFrame:
    """Per query: hit@k and MRR on the union of its gold sets, recall@k of the best set, success@k if any set is complete.

    gold: query, set_index, id; rankings: query, id, rank. An id that is not ranked is never within any depth.
    """
    found = gold.join(rankings.select("query", "id", "rank"), ["query", "id"], "left")
    inside = {k: F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int") for k in depths}
    per_set = found.groupBy("query", "set_index").agg(F.min("rank").alias("best"), *(F.avg(inside[k]).alias(f"r{k}") for k in depths))
    return per_set.groupBy("query").agg(
        *(F.max((F.col(f"r{k}") > 0).cast("int")).cast("double").alias(f"hit_{k}") for k in depths),
        *(F.round(F.max(f"r{k}"), 9).alias(f"recall_{k}") for k in depths),
        *(F.max((F.col(f"r{k}") == 1).cast("int")).cast("double").alias(f"success_{k}") for k in depths),
        F.round(F.coalesce(1.0 / F.min("best"), F.lit(0.0)), 9).alias("mrr"),
    )


def macro_means(metrics: DataFrame, columns: Sequence[str], *groups: str) -> DataFrame:
    """Means over all queries and by each group column: (scope, value, n, columns)."""
    scope = F.lit("overall")
    value = F.lit(None).cast("string")
    for g in groups:
        scope = F.when(F.grouping(g) == 0, g).otherwise(scope)
        value = F.when(F.grouping(g) == 0, F.col(g).cast("string")).otherwise(value)
    view = metrics.select(*groups, *columns)
    keys = [F.col(g) for g in groups]
    return view.groupingSets([[], *([k] for k in keys)], *keys).agg(scope.alias("scope"), value.alias("value"), F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), 9).alias(c) for c in columns)).drop(*groups)


def spoilers(rankings: DataFrame, cutoffs: DataFrame, depth: int = 10) -> DataFrame:
    """Per query both definitions: whether any of the first `depth` lies beyond the cutoff, and which share does (0 of none)."""
    head = cutoffs.join(rankings.where(F.col("rank") <= depth).select("query", "position"), "query", "left")
    beyond = F.coalesce((F.col("position") > F.col("cutoff")).cast("int"), F.lit(0))
    return head.groupBy("query").agg(F.max(beyond).alias("any_beyond"), F.round(F.coalesce(F.avg(F.when(F.col("position").isNotNull(), beyond)), F.lit(0.0)), 9).alias("share_beyond"))


def completeness_curve(units: DataFrame, depths: Sequence[int]) -> DataFrame:
    """(k, recall, success): macro recall of required units and share of queries with all of them within k. units: query, rank."""
    per = units.crossJoin(F.broadcast(units.sparkSession.createDataFrame([(k,) for k in depths], "k int"))).withColumn("in", F.coalesce(F.col("rank") <= F.col("k"), F.lit(False)).cast("int"))
    per = per.groupBy("k", "query").agg(F.avg("in").alias("r"), F.min("in").alias("all"))
    return per.groupBy("k").agg(F.round(F.avg("r"), 9).alias("recall"), F.round(F.avg("all"), 9).alias("success"))


def rank_bucket(rank: Column, cuts: Sequence[tuple[int, str]] = ((10, "TOP_10"), (20, "NEAR_MISS"), (50, "MID_RANK")), beyond: str = "DEEP_RANK", missing: str = "MISSING") -> Column:
    """Name of the first cut that a rank does not exceed; null is missing, a rank below 1 an error."""
    out = F.lit(beyond)
    for cut, name in sorted(cuts, reverse=True):
        out = F.when(rank <= cut, name).otherwise(out)
    return F.when(rank.isNull(), missing).when(rank < 1, F.raise_error(F.lit("ranks begin at 1"))).otherwise(out)


def distribution(rows: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    """(key, n, fraction) for every declared key, 0 where there is none."""
    declared = rows.sparkSession.createDataFrame([(k,) for k in keys], "key string")
    counts = rows.groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("c"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return F.broadcast(declared).join(counts, "key", "left").crossJoin(total).select("key", F.coalesce("c", F.lit(0)).cast("long").alias("n"), F.round(F.coalesce("c", F.lit(0)) / F.greatest("total", F.lit(1)), 9).alias("fraction"))


def transition(before: Column, after: Column, k: int = 10) -> Column:
    """Where a unit moved with regard to the first k."""
    a, b = F.coalesce(before <= k, F.lit(False)), F.coalesce(after <= k, F.lit(False))
    return F.when(a & b, "STABLE_IN").when(a, "LOST").when(b, "GAINED").otherwise("STABLE_OUT")


def rank_shift(units: DataFrame, k: int = 10) -> DataFrame:
    """One row: improved, same, worse (of those ranked twice), crossings of k, medians. units: before, after."""
    b, a = F.col("before"), F.col("after")
    move = transition(b, a, k)
    return units.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(a < b).alias("improved"), F.count_if(a == b).alias("same"), F.count_if(a > b).alias("worse"),
        F.count_if(move == "GAINED").alias("gained"), F.count_if(move == "LOST").alias("lost"),
        F.round(F.median(b), 9).alias("median_before"), F.round(F.median(a), 9).alias("median_after"),
    )


def best_subquery(ranks: DataFrame) -> DataFrame:
    """(query, id, best_rank, best_index): least rank over sub-queries and the lowest index that has it. ranks: query, id, index, rank."""
    return ranks.groupBy("query", "id").agg(F.min(F.struct("rank", "index")).alias("b")).select("query", "id", F.col("b.rank").alias("best_rank"), F.col("b.index").alias("best_index"))


def worst_required(units: DataFrame) -> DataFrame:
    """(query, worst): the largest rank of the required units, null if any is absent."""
    return units.groupBy("query").agg(F.when(F.count("rank") == F.count(F.lit(1)), F.max("rank")).alias("worst"))


def top_changes(first: DataFrame, second: DataFrame, k: int = 10) -> DataFrame:
    """(query, introduced, jaccard, changed) between two rankings' first k."""
    sets = [r.where(F.col("rank") <= k).groupBy("query").agg(F.collect_set("id").alias(n)) for r, n in ((first, "a"), (second, "b"))]
    both = sets[0].join(sets[1], "query", "full").withColumn("a", F.coalesce("a", F.array())).withColumn("b", F.coalesce("b", F.array()))
    return both.select("query", F.size(F.array_except("b", "a")).alias("introduced"), F.round(F.size(F.array_intersect("a", "b")) / F.greatest(F.size(F.array_union("a", "b")), F.lit(1)), 9).alias("jaccard"), (F.size(F.array_except("b", "a")) + F.size(F.array_except("a", "b")) > 0).alias("changed"))


def mcnemar(pairs: DataFrame, first: str, second: str) -> DataFrame:
    """One row: only_first, only_second and the exact two-sided p of their split."""
    counts = pairs.agg(F.count_if((F.col(first) > 0) & ~(F.col(second) > 0)).alias("only_first"), F.count_if(~(F.col(first) > 0) & (F.col(second) > 0)).alias("only_second"))
    n, least = F.col("only_first") + F.col("only_second"), F.least("only_first", "only_second")

    def log_choose(k: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))), F.lit(0.0), lambda s, i: s + F.when(i <= k, F.log((n - k + i) / i)).otherwise(0.0))

    tail = F.aggregate(F.transform(F.sequence(F.lit(0).cast("long"), least), lambda k: F.exp(log_choose(k) - n * F.log(F.lit(2.0)))), F.lit(0.0), lambda s, x: s + x)
    return counts.withColumn("p", F.round(F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)), 9))


def sign_flip(pairs: DataFrame, first: str, second: str, digits: int = 4) -> DataFrame:
    """One row: n (non-zero differences) and the exact two-sided p over all their sign patterns.

    Differences are taken to `digits` decimals. The share of patterns whose flipped differences add up to each amount
    follows difference by difference from the shares before, so no pattern is ever listed. One task does it, from the
    differences counted by value.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        step = int(np.gcd.reduce(rows["unit"].to_numpy()))
        units = np.repeat(rows["unit"].to_numpy() // step, rows["times"].to_numpy())
        whole, seen = int(units.sum()), abs(int(rows["signed"].sum())) // step
        share = np.zeros(whole + 1)
        share[0] = 1.0
        for u in units.tolist():
            flipped = share / 2
            flipped[u:] += share[:-u] / 2
            share = flipped
        # with f flipped in all, the sum is whole - 2 f
        p = share.sum() if not seen else share[: (whole - seen) // 2 + 1].sum() + share[(whole + seen + 1) // 2 :].sum()
        return pd.DataFrame({"n": [len(units)], "p": [round(float(p), 9)]})

    d = pairs.select(F.round((F.col(second) - F.col(first)) * 10**digits).cast("long").alias("d")).where("d <> 0")
    by = d.groupBy(F.abs("d").alias("unit")).agg(F.count(F.lit(1)).alias("times"), F.sum("d").alias("signed"))
    none = pairs.sparkSession.createDataFrame([(0, 1.0)], "n long, p double")
    return by.groupBy().applyInPandas(run, "n long, p double").unionByName(none).orderBy(F.desc("n")).limit(1)


def paired_bootstrap(pairs: DataFrame, first: str, second: str, draws: int = 10_000, seed: int = 20260101) -> DataFrame:
    """One row: mean difference and the 2.5 and 97.5 percentiles of its resampled means (numpy's PCG64, seeded)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        d = (rows[second] - rows[first]).to_numpy()
        rng = np.random.default_rng(seed)
        means = np.array([d[rng.integers(0, len(d), len(d))].mean() for _ in range(draws)])
        lo, hi = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame({"mean_difference": [d.mean()], "low": [lo], "high": [hi]})

    probes = pairs.orderBy("query").select("query", first, second)
    return probes.groupBy().applyInPandas(lambda r: run(r.sort_values("query")), "mean_difference double, low double, high double")


def micro_and_macro(units: DataFrame, k: int = 10) -> DataFrame:
    """One row: any, all, recall (mean over queries), hit units and units at depth k. units: query, rank."""
    per = units.groupBy("query").agg(F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")).alias("r"), F.count_if(F.col("rank") <= k).alias("hits"), F.count(F.lit(1)).alias("units"))
    return per.agg(F.round(F.avg((F.col("r") > 0).cast("int")), 9).alias("any_rate"), F.round(F.avg((F.col("r") == 1).cast("int")), 9).alias("all_rate"), F.round(F.avg("r"), 9).alias("macro_recall"), F.sum("hits").alias("hit_units"), F.sum("units").alias("all_units"), F.round(F.sum("hits") / F.sum("units"), 9).alias("micro_recall"))


def upper_median(value: Column) -> Column:
    """The middle value, the upper of two."""
    held = F.array_sort(F.collect_list(value))
    return F.element_at(held, (F.floor(F.size(held) / 2) + 1).cast("int"))
