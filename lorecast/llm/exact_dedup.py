"""Exact deduplication by skew-safe combining, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups that copies of one text are dealt over before they are combined.
SALTS = 16


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Copies are combined in three steps, and each groups by the digest and the full text together, so that texts
    with equal digests are still told apart: within a task (the map side of the first aggregation), per salt, and
    over the salts. A group of any size thus reaches a task as at most one row per task or salt. What is joined back
    to the rows is a digest and two numbers; that join is one that adaptive execution splits where a digest is hot.
    Two different texts with one SHA-256 end the job with an error.

    Null texts count as empty and equal each other; no text is normalised. The largest id stays. Rows that repeat an
    id with the same text all get the same answer. A null id stays only where its whole group has none. An empty
    table gives an empty result. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    digest = F.unhex(F.sha2(F.col("body"), 256))
    local = (
        rows.withColumn("digest", digest)
        .withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("byte"))
        .groupBy("digest", "salt", "body")
        .agg(F.max("id").alias("best"), F.count(F.lit(1)).alias("n"))
    )
    classes = local.groupBy("digest", "body").agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    per_digest = classes.groupBy("digest").agg(F.max("best").alias("best"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    copied = per_digest.where((F.col("n") > 1) | (F.col("texts") > 1)).select(
        F.col("digest").alias("copied_digest"),
        F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share one SHA-256 digest")).cast("long")).otherwise(F.col("best")).alias("best"),
        "n",
    )
    slim = rows.select("id", digest.alias("digest"))
    joined = slim.join(copied, slim["digest"] == copied["copied_digest"], "left")
    keep = F.when(F.col("copied_digest").isNull(), F.col("id")).otherwise(F.col("best"))
    return joined.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
