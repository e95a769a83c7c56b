"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import materialize, ship

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of total by weight, none above most times its size; what is cut off is shared again by weight."""
    targets, open_, left = [0.0] * len(sizes), list(range(len(sizes))), float(total)
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > most * sizes[i]]
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = float(most * sizes[i])
        left -= sum(targets[i] for i in over)
        closed = set(over)
        open_ = [i for i in open_ if i not in closed]
    return targets


def sainte_lague(weights: Sequence[float], seats: int) -> list[int]:
    """Integer quotas that give each next seat to the highest quotient weight / (2 k + 1); ties go to the first.

    It starts from the quotas that rounding at the mean divisor gives, which are what some number of such steps
    gives, and takes only the steps (or steps back) that are missing.
    """
    total = sum(weights)
    if seats <= 0 or total <= 0:
        return [0] * len(weights)
    out = [max(0, math.ceil(w * seats / total - 0.5)) for w in weights]
    missing = seats - sum(out)
    if missing > 0:
        heap = [(-w / (2 * k + 1), i) for i, (w, k) in enumerate(zip(weights, out, strict=True)) if w > 0]
        heapq.heapify(heap)
        for _ in range(missing):
            _, i = heap[0]
            out[i] += 1
            heapq.heapreplace(heap, (-weights[i] / (2 * out[i] + 1), i))
    elif missing < 0:
        heap = [(w / (2 * k - 1), -i) for i, (w, k) in enumerate(zip(weights, out, strict=True)) if k > 0]
        heapq.heapify(heap)
        for _ in range(-missing):
            _, i = heapq.heappop(heap)
            out[-i] -= 1
            if out[-i] > 0:
                heapq.heappush(heap, (weights[-i] / (2 * out[-i] - 1), i))
    return out


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (1, 2, 3),
    most: float = 3.0,
    block: int = 32,
    shard_tokens: int = 100_000,
    shards_most: int = 1 << 20,
    sources_most: int = 100_000,
    seed: int = 17,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken (words that the mix takes, repeats counted).

    Sources in code point order (null last) get the given weights in turn and share the words of all documents by
    weight, none beyond `most` times its own size. A source's documents are dealt by a seeded hash of the id over
    shards; blocks of `block` words are apportioned over the sources, and each source's over its shards, by
    Sainte-Laguë. In a shard the documents stand in seeded order as one run of words cut into blocks: a quota above
    the shard's words takes the whole run as often as it fits, and the rest goes to blocks that a seeded affine
    permutation of the block numbers picks; the last block may be shorter. So a hot source is spread over its shards.
    The driver holds one row per source (at most sources_most of them, an error beyond that: sources are weighed
    against each other), a task one row per shard of one source (at most shards_most; beyond that shards grow).

    Null texts have size 0, take nothing and stay. A null source is a source of its own, and so is an empty one. Rows
    that repeat an id are documents of their own; null ids stand together in one shard. An empty table gives an empty
    result. Equal seeds give equal results, whatever the partitioning. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    sizes = materialize(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "mix-sizes")
    found = sizes.groupBy("source").agg(F.sum("size").alias("size")).limit(sources_most + 1).collect()
    if len(found) > sources_most:
        raise ValueError(f"more than {sources_most} sources")
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    totals = [r["size"] for r in found]
    targets = capped_targets(totals, [weights[i % len(weights)] for i in range(len(found))], sum(totals), most)
    shards = [min(shards_most, max(1, -(-n // shard_tokens))) for n in totals]
    source_rows = [(r["source"], i, n, t, k) for i, (r, n, t, k) in enumerate(zip(found, totals, targets, shards, strict=True))]
    schema = T.StructType([T.StructField("source", docs.schema[source_col].dataType)]).add("number", "integer").add("source_size", "long").add("target", "double").add("shards", "long")
    by_source = F.broadcast(spark.createDataFrame(source_rows, schema).withColumnRenamed("source", "of_source"))
    dealt = sizes.join(by_source, F.col("source").eqNullSafe(F.col("of_source"))).withColumn("order", F.xxhash64(F.lit(seed), F.col("id"))).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("id")), F.col("shards")))

    quotas = enumerate(sainte_lague(targets, round(sum(targets) / block)))
    quotas = F.broadcast(spark.createDataFrame(list(quotas), "number int, quota long"))
    ship(spark)

    def over_shards(rows: pd.DataFrame) -> pd.DataFrame:
        """A source's quota over its shards: whole passes, and how many further blocks in which order."""
        rows = rows.sort_values("shard")
        rng, out = random.Random(f"{seed}:{rows['number'].iloc[0]}"), []
        for number, shard, n, q in zip(rows["number"], rows["shard"], rows["n"], sainte_lague(rows["n"].tolist(), int(rows["quota"].iloc[0])), strict=True):
            blocks = max(1, -(-n // block))
            passes = min(int(most), q * block // n) if n else 0
            extra = 0 if passes >= most or not n else min(blocks, round((q * block - passes * n) / block))
            step = rng.randrange(1, blocks + 1)
            while math.gcd(step, blocks) != 1:
                step = step % blocks + 1
            out.append((number, shard, passes, extra, blocks, step, rng.randrange(blocks)))
        return pd.DataFrame(out, columns=["q_number", "q_shard", "passes", "extra", "blocks", "step", "shift"])

    tokens = dealt.groupBy("number", "shard").agg(F.sum("size").alias("n")).join(quotas, "number")
    picks = tokens.groupBy("number").applyInPandas(over_shards, "q_number int, q_shard long, passes long, extra long, blocks long, step long, shift long")
    quota_rows = materialize(picks, "mix-quotas")
    if quota_rows.count() <= 200_000:  # about 10 MB; beyond that the join shuffles
        quota_rows = F.broadcast(quota_rows)
    run = Window.partitionBy("number", "shard").orderBy("order", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("stop", F.sum("size").over(run)).withColumn("start", F.col("stop") - F.col("size"))
    placed = placed.join(quota_rows, (F.col("number") == F.col("q_number")) & (F.col("shard") == F.col("q_shard")), "left")
    b = F.lit(block).cast("long")

    def share(acc: Column, k: Column) -> Column:
        picked = F.pmod(k * F.col("step") + F.col("shift"), F.col("blocks")) < F.col("extra")
        return acc + F.when(picked, F.least(F.col("stop"), (k + 1) * b) - F.greatest(F.col("start"), k * b)).otherwise(F.lit(0).cast("long"))

    reached = F.sequence(F.expr(f"start div {block}"), F.expr(f"(stop - 1) div {block}"))
    partly = F.when((F.col("size") > 0) & (F.col("extra") > 0), F.aggregate(reached, F.lit(0).cast("long"), share)).otherwise(F.lit(0).cast("long"))
    return placed.select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        (F.coalesce("passes", F.lit(0).cast("long")) * F.col("size") + partly).alias("taken"),
    )
