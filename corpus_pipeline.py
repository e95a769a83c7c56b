"""Corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, benchmark decontamination, mixing to target weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's result as Parquet into the
shared folder and hands the reread table to the next. All stages but the last return the columns of documents. Rows
with a null doc_id pass through the filtering stages unless their own text is rejected; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorecast.llm.decontaminate import find_leaks
from lorecast.llm.exact_dedup import exact_dedup
from lorecast.llm.jaccard_join import jaccard_components
from lorecast.llm.mixing import mix_sources
from lorecast.llm.shared import materialize, table
from lorecast.llm.toxicity import classify_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _digest() -> Column:
    """Of the text (null: empty), as exact_dedup has it: ids may be null or repeated, so they do not name a row."""
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, by the threshold of their language, go."""
    scored = classify_toxicity(docs, table(spark, sf_dir, "labels"), keep=("text", "lang", "source", "n_chars"))
    return scored.where(~F.col("rejected")).select(*COLUMNS)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays; a row that is there twice stays once.

    Rows are named by id and digest, a null id by a word that no id is; whole rows are shuffled once, by that name.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("name")
    kept = exact_dedup(docs).where("kept").select(name, F.col("text_sha256").alias("digest")).distinct()
    rows = docs.select("*", name, _digest().alias("digest"))
    return rows.join(kept, ["name", "digest"], "left_semi").dropDuplicates(["name", "digest"]).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest doc_id stays; rows without a doc_id all stay.

    Rows are named by a 64-bit hash of doc_id and the text's digest.
    """
    keyed = docs.where("doc_id is not null").withColumn("row_key", F.xxhash64("doc_id", _digest()))
    found = jaccard_components(keyed, id_col="row_key").select(F.col("row_key").alias("found_key"), "component_id").distinct()
    ids = keyed.select("doc_id", "row_key").join(found, F.col("row_key") == F.col("found_key"))
    kept = ids.groupBy("component_id").agg(F.min(F.struct("doc_id", "row_key")).alias("least")).select(F.col("least.row_key").alias("kept_key"))
    rest = keyed.join(kept, F.col("row_key") == F.col("kept_key"), "left_semi").select(*COLUMNS)
    return rest.unionByName(docs.where("doc_id is null").select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    keyed = docs.withColumn("digest", _digest())
    leaks = find_leaks(keyed, table(spark, sf_dir, "benchmark"), id_col="digest").select(F.col("digest").alias("leak")).distinct()
    return keyed.join(leaks, F.col("digest") == F.col("leak"), "left_anti").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document with its size, its source's size and target, and the words that the mix takes of it."""
    return mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", decontaminate),
    ("mixing", mix),
]

#: A trained classifier and a latent space are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
