"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_path, new_path


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.select(F.col("u").alias("c"), F.col("v").alias("x")).unionByName(edges.select(F.col("v").alias("c"), F.col("u").alias("x")))
    else:
        both = edges.select(F.greatest("u", "v").alias("c"), F.least("u", "v").alias("x"))
    least = both.groupBy("c").agg(F.min("x").alias("m")).select(F.col("c").alias("mc"), F.least("c", "m").alias("m"))
    joined = both.join(least, F.col("c") == F.col("mc"))
    if large:
        out = joined.where(F.col("x") > F.col("c")).select(F.col("x").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("mc").alias("u"), F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node that it reaches. Edges: columns u and v.

    Every round is one large and one small star; a hub's edges meet its minimum in a join that adaptive execution
    splits, and nothing is gathered. Each round is written to the shared folder, which ends its lineage. Loops and
    repeated edges do no harm; without edges the result is empty. An error if something still changes after most_rounds.
    """
    spark = edges.sparkSession
    current = edges.select("u", "v").where(F.col("u") != F.col("v"))
    last_path, last_sign = "", None
    for _ in range(most_rounds):
        path = new_path(spark, "cc")
        _star(_star(current, True), False).write.parquet(path)
        current = spark.read.schema("u long, v long").parquet(path)
        sign = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if last_path:
            drop_path(spark, last_path)
        if sign == last_sign:
            break
        last_path, last_sign = path, sign
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
